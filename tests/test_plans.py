"""What the plans must look like, whatever the size of the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postmill.operators import labels as L, orders as O
from postmill.sources import scans

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
NATIVE = [
    "triage", "prefilter", "rules_as_data", "reconcile", "accuracy_by_category", "route_orders", "fill_templates",
    "contact_index", "lint_drafts", "cue_features", "parse_kb", "chunks", "new_entries", "flush_staging", "label_batches",
]


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_cross_joins(spark, plan, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", NATIVE)
def test_core_operators_stay_in_the_jvm(spark, plan, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(node in text for node in ("Python", "Pandas"))


def test_scan_filters_and_columns_reach_the_files(spark, plan, tmp_path):
    df = spark.sql("""
        SELECT 'm' AS message_id, 't' AS thread_id, timestamp'2024-03-01' AS received_at, 's' AS sender, 'b' AS subject,
               'body' AS body, array('AI_PROCESSED', 'US_WISMO') AS labels, true AS is_unread, false AS is_processed,
               date'2024-03-01' AS received_date""")
    df.write.partitionBy("received_date").parquet(f"{tmp_path}/m")
    mail = spark.read.parquet(f"{tmp_path}/m")
    text = plan(scans.inbox_scan(mail, "2024-03-05 10:00:00").select("message_id"))
    assert "received_at" in text.split("PushedFilters")[1].split("]")[0]
    assert "is_processed" in text.split("PushedFilters")[1].split("]")[0]
    assert "received_date" in text.split("PartitionFilters")[1].split("]")[0]
    assert "body" not in text.split("ReadSchema")[1]
    for queue in (L.eligible(mail, "2024-03-05 10:00:00"), O.wismo_queue(mail, "2024-03-05 10:00:00")):
        assert "received_at" in plan(queue).split("PushedFilters")[1].split("]")[0]


def test_unmatched_keys_are_spread(spark):
    """Messages without an order number do not share one join key."""
    mail = spark.range(50).select(
        F.col("id").cast("string").alias("message_id"), F.lit("no number").alias("body"), F.lit("US_WISMO").alias("tag"))
    orders = QUERIES["shop_orders"](spark, SF)
    routed = O.route_orders(mail, orders, "2001-08-03")
    assert routed.filter("route = 'RETRIAGE'").count() == 50


def test_threads_of_a_hot_key_keep_only_the_wanted_rows_before_the_shuffle(spark, plan):
    for name in ("reconcile", "thread_context", "last_sender", "latest_pending", "first_sent"):
        text = plan(QUERIES[name](spark, SF))
        assert "WindowGroupLimit" in text, name
