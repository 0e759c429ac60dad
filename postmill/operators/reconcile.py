"""Match prepared drafts to the replies that were finally sent, and score the edits.

Both sides are cut to one row per thread before the join (Spark limits the groups on the
map side first), so a thread with very many drafts or replies does not skew the join.
Draft status is never updated in place: reconciling yields status events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import ago, moment
from ..functions.scoring import score
from ..functions.text import text_or_empty

PENDING_COLUMNS = (
    "draft_id", "thread_id", "message_id", "created_at", "email_category", "sender_email", "subject",
    "draft_text", "store",
)


def pending_drafts(draft_log: DataFrame) -> DataFrame:
    have = [c for c in PENDING_COLUMNS if c in draft_log.columns]
    return draft_log.filter(F.col("status") == "PENDING").select(*have)


def with_thread(df: DataFrame) -> DataFrame:
    """Rows whose thread id is neither blank nor null."""
    return df.filter(F.col("thread_id") != "")


def _first(df: DataFrame, *order) -> DataFrame:
    window = Window.partitionBy("thread_id").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")


def latest_per_thread(drafts: DataFrame) -> DataFrame:
    return _first(with_thread(drafts), F.desc("created_at"), F.asc("draft_id"))


def first_sent_per_thread(sent: DataFrame) -> DataFrame:
    """One reply per thread, the newest, as the mail listing returns newest first."""
    return _first(with_thread(sent), F.desc("sent_at"), F.asc("message_id"))


def match(
    drafts: DataFrame,
    sent: DataFrame,
    strict_time: bool = False,
    consume_sent: bool = False,
    accuracy_log: DataFrame | None = None,
) -> DataFrame:
    """Pairs of the latest pending draft and the reply of each thread.

    By default the reply may be older than the draft and may already have served for another
    draft. ``strict_time`` takes the latest draft made no later than the reply;
    ``consume_sent`` leaves out replies already in ``accuracy_log``.
    """
    if consume_sent:
        if accuracy_log is None:
            raise ValueError("consume_sent needs accuracy_log")
        used = accuracy_log.select("message_id").filter(F.col("message_id").isNotNull()).distinct()
        sent = sent.join(used, "message_id", "left_anti")
    replies = first_sent_per_thread(sent).select(
        "thread_id", F.col("message_id").alias("sent_message_id"), F.col("sent_at"), F.col("body").alias("final_sent")
    )
    if strict_time:
        in_time = with_thread(drafts).join(replies.select("thread_id", "sent_at"), "thread_id").filter(
            F.col("created_at") <= F.col("sent_at")
        )
        latest = latest_per_thread(in_time.drop("sent_at"))
    else:
        latest = latest_per_thread(drafts)
    return latest.join(replies, "thread_id")


def deal(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread pairs evenly by draft id before scoring.

    Edit distances cost milliseconds per pair where moving one costs microseconds, while
    adaptive execution sizes partitions by bytes and would leave the work to few tasks.
    """
    conf = pairs.sparkSession.conf
    return pairs.repartition(partitions or int(conf.get("spark.sql.shuffle.partitions")), "draft_id")


def reconcile(
    drafts: DataFrame,
    sent: DataFrame,
    as_of,
    strict_time: bool = False,
    consume_sent: bool = False,
    accuracy_log: DataFrame | None = None,
    agent_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accuracy rows to append and RECONCILED status events, from the same matching.

    The events read no text, so reading them alone computes no distances.
    """
    pairs = match(drafts, sent, strict_time, consume_sent, accuracy_log)
    accuracy = score(deal(pairs).withColumn("final_sent", text_or_empty(F.col("final_sent")))).select(
        "draft_id", "thread_id", F.col("sent_message_id").alias("message_id"), moment(as_of).alias("reconciled_at"),
        "final_sent", "edit_distance", "total_chars", "edit_pct", "accuracy_score", "result",
        F.lit(False).alias("semantic_match"), F.lit(agent_id).cast("string").alias("agent_id"),
    )
    events = pairs.select("draft_id", F.lit("RECONCILED").alias("event"), moment(as_of).alias("event_ts"))
    return accuracy, events


def abandon(drafts: DataFrame, as_of, days: int = 14, reconciled: DataFrame | None = None) -> DataFrame:
    """ABANDONED events for drafts pending for strictly more than ``days``.

    Run after reconciling: drafts among the ``reconciled`` events are not swept.
    """
    old = drafts.filter(F.col("created_at") < ago(as_of, days=days))
    if "status" in drafts.columns:
        old = old.filter(F.col("status") == "PENDING")
    if reconciled is not None:
        old = old.join(reconciled.select("draft_id"), "draft_id", "left_anti")
    return old.select("draft_id", F.lit("ABANDONED").alias("event"), moment(as_of).alias("event_ts"))


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per draft; at one instant RECONCILED beats ABANDONED beats PENDING."""
    weight = (
        F.when(F.col("event") == "RECONCILED", 2).when(F.col("event") == "ABANDONED", 1).otherwise(0)
    )
    return events.groupBy("draft_id").agg(
        F.max_by("event", F.struct("event_ts", weight)).alias("status")
    )


def with_status(draft_log: DataFrame, events: DataFrame) -> DataFrame:
    """The draft log with the events applied; drafts without an event keep their status."""
    latest = current_status(events).withColumnRenamed("status", "_status")
    return (
        draft_log.join(latest, "draft_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )


def run_cycle(draft_log: DataFrame, sent: DataFrame, as_of, days: int = 14, **options) -> tuple[DataFrame, DataFrame]:
    """Reconcile, then sweep: (accuracy rows, draft log with its new status).

    The log meets the reconciled ids in one join; the sweep is a condition on what is left.
    """
    accuracy, done = reconcile(pending_drafts(draft_log), sent, as_of, **options)
    open_and_old = (F.col("status") == "PENDING") & (F.col("created_at") < ago(as_of, days=days))
    log = (
        draft_log.join(done.select("draft_id", F.lit(True).alias("_done")), "draft_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_done"), "RECONCILED").when(open_and_old, "ABANDONED").otherwise(F.col("status")),
        )
        .drop("_done")
    )
    return accuracy, log
