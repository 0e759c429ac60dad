from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.functions import rule_words as W
from postmill.operators import labels as L, threads as T

NOW = datetime(2024, 3, 8, 12)
SCHEMA = "message_id string, thread_id string, received_at timestamp, sender string, labels array<string>, is_unread boolean"


def mail(spark, *rows):
    return spark.createDataFrame([(m, t, NOW - timedelta(hours=h), s, l.split(), u) for m, t, h, s, l, u in rows], SCHEMA)


def pairs(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def test_processing_state(spark):
    df = mail(spark, ("a", "t", 1, "x", "AI_PROCESSED US_WISMO", True), ("b", "t", 1, "x", "AI_PROCESSED", True),
              ("c", "t", 1, "x", "", True), ("d", "t", 1, "x", "AI_PROCESSED", False), ("e", "t", 1, "x", "US_WISMO", True))
    assert pairs(L.processing_state(df), "message_id", "state") == {"a": "skip", "b": "rerun", "c": "new", "d": "skip", "e": "new"}


def test_preflight(spark):
    df = mail(
        spark,
        ("form", "t1", 2, W.FORM_SENDER, "AI_PROCESSED US_WARRANTY", True),
        ("note", "t2", 2, "notifications@other.com", "AI_PROCESSED US_WISMO", True),
        ("solo", "t3", 2, "jane@x.com", "AI_PROCESSED", True),
        ("reply", "t4", 2, "jane@x.com", "AI_PROCESSED", True),
        ("fine", "t5", 2, "jane@x.com", "AI_PROCESSED US_RETURN", True),
        ("drafted", "t6", 2, "jane@x.com", "AI_PROCESSED US_RETURN REVIEW_DRAFT", True),
        ("read", "t7", 2, "jane@x.com", "AI_PROCESSED US_RETURN", False),
        ("old", "t8", 24 * 9, "jane@x.com", "AI_PROCESSED US_RETURN", True),
        ("blank", None, 2, "jane@x.com", "AI_PROCESSED", True),
    )
    thread = df.unionByName(mail(spark, ("first", "t4", 5, "jane@x.com", "", False)))
    checked = L.preflight(L.eligible(df, NOW), thread)
    assert pairs(checked, "message_id", "outcome") == {
        "form": "SKIP", "note": "MISLABELED", "solo": "RETRIAGE", "reply": "PROCEED", "fine": "PROCEED", "blank": "RETRIAGE"}
    fixed = pairs(L.correct_mislabeled(checked), "message_id", "labels")
    assert sorted(fixed["note"]) == ["AI_PROCESSED", "B2B_FILTERED"]
    assert sorted(fixed["form"]) == ["AI_PROCESSED", "US_WARRANTY"]


def test_cleanup(spark):
    df = mail(spark, ("a", "t1", 2, "jane@x.com", "REVIEW_DRAFT AI_PROCESSED", True), ("b", "t2", 2, "j@x.com", "REVIEW_DRAFT", False),
              ("c", "t3", 2, "j@x.com", "REVIEW_DRAFT", True), ("r", "t1", 1, "Team <cs@shop.example>", "", False))
    done = L.cleanup(df, "cs@shop.example")
    assert pairs(done, "message_id", "cleanup") == {"a": "replied", "b": "read", "c": "pending"}
    assert pairs(done, "message_id", "labels") == {"a": ["AI_PROCESSED"], "b": [], "c": ["REVIEW_DRAFT"]}


def test_merge_searches_keeps_each_message_once(spark):
    df = mail(spark, ("a", "t", 1, "x", "", True), ("b", "t", 1, "x", "", True))
    assert L.merge_searches(df, df.filter("message_id = 'a'")).count() == 2


def test_label_batches_keep_every_id(spark):
    df = spark.range(2500).select(
        F.col("id").cast("string").alias("message_id"), F.lit("B2B_FILTERED").alias("tag"),
        (F.lit(NOW) + F.make_dt_interval(mins=(F.col("id") % 300).cast("int"))).alias("received_at"))
    rows = L.label_batches(df, size=100).collect()
    assert all(len(r["message_ids"]) <= 100 for r in rows)
    assert sorted(i for r in rows for i in r["message_ids"]) == sorted(str(i) for i in range(2500))


def test_contact_numbers_over_slots(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("message_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("t").alias("thread_id"),
        (F.lit(NOW) + F.make_dt_interval(mins=(F.col("id") * 7 % 600).cast("int"))).alias("received_at"),
        (F.col("id") % 5 > 0).alias("customer"))
    got = T.contact_index(df, F.col("customer")).collect()
    rows = [r for r in df.collect() if r["customer"]]
    want = {}
    for thread in ("hot", "t"):
        ordered = sorted((r for r in rows if r["thread_id"] == thread), key=lambda r: (r["received_at"], r["message_id"]))
        want.update({r["message_id"]: i for i, r in enumerate(ordered, 1)})
    assert {r["message_id"]: r["contact_no"] for r in got} == want


def test_only_if_category(spark):
    df = mail(spark, ("a", "t", 1, "x", "", True))
    tagged = spark.createDataFrame([("US_WISMO",)], "tag string")
    assert L.only_if_category(df, tagged, ["US_WISMO"]).count() == 1
    assert L.only_if_category(df, tagged, ["US_OOS"]).count() == 0
