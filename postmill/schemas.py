"""Table schemas, enumerations and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType,
)

_TYPES = {
    "string": StringType(), "timestamp": TimestampType(), "date": DateType(), "int": IntegerType(),
    "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()),
    "array<double>": ArrayType(DoubleType()),
}


def _table(columns: str) -> StructType:
    """``name type`` pairs, with ``!`` behind the type of a required column. Needs no session."""
    fields = []
    for column in columns.split(","):
        name, kind = column.split()
        fields.append(StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return StructType(fields)


MESSAGES = _table(
    "message_id string!, thread_id string, received_at timestamp!, sender string!, "
    "subject string, body string, labels array<string>!, is_unread boolean!"
)
STAGED = _table(
    "draft_id string, thread_id string, message_id string, created_at string, email_category string, "
    "sender_email string, subject string, draft_text string, order_id string, store string, "
    "primary_intent string, secondary_intent string, sentiment string, escalation_risk string, status string"
)
DRAFT_LOG = _table(
    "draft_id string!, thread_id string, message_id string, created_at timestamp!, "
    "email_category string, sender_email string, subject string, draft_text string, order_id string, store string, "
    "primary_intent string, secondary_intent string, sentiment string, escalation_risk string, status string"
)
SENT = _table("thread_id string, message_id string, subject string, body string, sent_at timestamp")
ACCURACY_LOG = _table(
    "draft_id string!, thread_id string, message_id string, reconciled_at timestamp!, "
    "final_sent string, edit_distance int, total_chars int, edit_pct double, accuracy_score double, "
    "result string, semantic_match boolean, agent_id string"
)
STATUS_EVENTS = _table("draft_id string!, event string!, event_ts timestamp!")
KB_ENTRIES = _table(
    "kb_id string!, filename string!, function_name string, canonical_question string!, "
    "canonical_answer string!, question_variants array<string>, embedding array<double>, "
    "intent_cluster string, category string, store string, embedding_model string!, "
    "content_hash string!, created_at timestamp!"
)
SHOP_ORDERS = _table(
    "store string, order_no string, created_at timestamp, fulfillment_status string, tracking_url string, "
    "carrier string, fulfilled_at timestamp, shipment_status string, estimated_delivery_date date, "
    "delivered_at timestamp"
)

# The states and bands other tables rely on.
STATUSES = ("PENDING", "RECONCILED", "ABANDONED")
RESULTS = ("PERFECT", "MINOR_EDIT", "MAJOR_EDIT", "REWRITE")
SENTIMENTS = ("POSITIVE", "NEUTRAL", "FRUSTRATED", "ANGRY", "URGENT")
RISKS = ("LOW", "MEDIUM", "HIGH")
INTENTS = (
    "replacement", "refund", "tracking_update", "cancellation", "address_change", "return_label",
    "status_update", "policy_question", "compatibility_question", "damage_report", "shipping_inquiry",
    "general_question",
)


def evolve(df: DataFrame, target: StructType) -> DataFrame:
    """Append the target's missing columns as typed nulls; existing columns stay as they are."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields if f.name not in have])


def conform(df: DataFrame, target: StructType) -> DataFrame:
    """``evolve`` and then exactly the target's columns, in its order and types."""
    return evolve(df, target).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])
