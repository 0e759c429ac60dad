from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.operators import reconcile as C

NOW = datetime(2024, 3, 1, 12)
DRAFT = "draft_id string, thread_id string, created_at timestamp, draft_text string, status string"
SENT = "thread_id string, message_id string, body string, sent_at timestamp"


def drafts(spark, *rows):
    return spark.createDataFrame([(d, t, NOW - timedelta(hours=h), text, s) for d, t, h, text, s in rows], DRAFT)


def sent(spark, *rows):
    return spark.createDataFrame([(t, m, b, NOW - timedelta(hours=h)) for t, m, b, h in rows], SENT)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_latest_draft_and_one_reply_per_thread(spark):
    d = drafts(spark, ("old", "t", 5, "a", "PENDING"), ("new", "t", 3, "a", "PENDING"), ("b", "u", 1, "x", "PENDING"),
               ("a", "u", 1, "x", "PENDING"), ("done", "v", 1, "x", "RECONCILED"), ("gone", "w", 1, "x", "ABANDONED"))
    s = sent(spark, ("t", "m1", "a", 2), ("t", "m2", "b", 1), ("u", "m3", "x", 0), ("v", "m4", "x", 0), ("w", "m5", "x", 0))
    accuracy, log = C.run_cycle(d, s, NOW)
    assert ids(accuracy, "draft_id", "message_id") == [("a", "m3"), ("new", "m2")]
    assert ids(log, "draft_id", "status") == [
        ("a", "RECONCILED"), ("b", "PENDING"), ("done", "RECONCILED"), ("gone", "ABANDONED"), ("new", "RECONCILED"),
        ("old", "PENDING")]


def test_blank_threads_never_match(spark):
    d = drafts(spark, ("a", "", 1, "x", "PENDING"), ("b", None, 1, "x", "PENDING"))
    s = sent(spark, ("", "m1", "x", 0), (None, "m2", "x", 0))
    assert C.match(d, s).count() == 0


def test_reply_before_draft(spark):
    d = drafts(spark, ("late", "t", 1, "x", "PENDING"), ("early", "t", 9, "x", "PENDING"))
    s = sent(spark, ("t", "m", "x", 5))
    assert ids(C.match(d, s), "draft_id") == [("late",)]
    assert ids(C.match(d, s, strict_time=True), "draft_id") == [("early",)]


def test_second_run(spark):
    d = drafts(spark, ("old", "t", 5, "x", "PENDING"), ("new", "t", 3, "x", "PENDING"))
    s = sent(spark, ("t", "m", "x", 1))
    first, log = C.run_cycle(d, s, NOW)
    again, _ = C.run_cycle(log, s, NOW)
    assert ids(again, "draft_id") == [("old",)]
    none, _ = C.run_cycle(log, s, NOW, consume_sent=True, accuracy_log=first)
    assert none.count() == 0


def test_abandon_boundary_and_order(spark):
    day = 24
    d = spark.createDataFrame(
        [("exact", "t1", NOW - timedelta(days=14), "x", "PENDING"), ("over", "t2", NOW - timedelta(days=14, seconds=1), "x", "PENDING"),
         ("sent", "t3", NOW - timedelta(days=14, seconds=1), "x", "PENDING")], DRAFT)
    s = sent(spark, ("t3", "m", "x", day))
    _, log = C.run_cycle(d, s, NOW)
    assert ids(log, "draft_id", "status") == [("exact", "PENDING"), ("over", "ABANDONED"), ("sent", "RECONCILED")]


def test_status_precedence(spark):
    rows = [("a", "PENDING", NOW), ("a", "ABANDONED", NOW), ("a", "RECONCILED", NOW), ("b", "PENDING", NOW),
            ("c", "RECONCILED", NOW - timedelta(hours=1)), ("c", "ABANDONED", NOW)]
    events = spark.createDataFrame(rows, "draft_id string, event string, event_ts timestamp")
    assert ids(C.current_status(events), "draft_id", "status") == [("a", "RECONCILED"), ("b", "PENDING"), ("c", "ABANDONED")]


def test_events_alone_compute_no_distance(spark, plan):
    d = drafts(spark, ("a", "t", 1, "x", "PENDING"))
    accuracy, events = C.reconcile(C.pending_drafts(d), sent(spark, ("t", "m", "x", 0)), NOW)
    assert "levenshtein" in plan(accuracy).lower()
    assert "levenshtein" not in plan(events).lower()


def test_hot_thread_is_cut_before_the_shuffle(spark, plan):
    """A third of all rows in one thread: ranks are limited on the map side and the join sees one row."""
    many = spark.range(3000).select(
        F.concat(F.lit("d"), F.col("id")).alias("draft_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("thread_id"),
        (F.lit(NOW) - F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created_at"),
        F.lit("x").alias("draft_text"), F.lit("PENDING").alias("status"))
    top = C.latest_per_thread(many)
    assert top.count() == 2001
    assert top.filter("thread_id = 'hot'").first()["draft_id"] == "d0"
    text = plan(top)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
