import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postmill.operators import rules as R
from postmill.session import work_path
from postmill.sources.draft_log import DraftLog
from postmill.streaming import streams as S
from postmill.streaming.matcher import DAY_US, settle

T0 = datetime(2024, 3, 1)
DRAFT = "draft_id string, thread_id string, created_at timestamp, draft_text string"
SENT = "thread_id string, message_id string, body string, sent_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Feed:
    """A folder of parquet files read as a stream; each ``add`` is one file."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).parquet(self.path)


def out(spark, root, stream):
    S.run_available(stream, f"{root}/out", f"{root}/progress")
    return spark.read.schema(stream.schema).parquet(f"{root}/out").collect()


def test_each_message_once_across_runs(spark, tmp_path):
    schema = "message_id string, received_at timestamp, sender string, subject string, body string"
    feed = Feed(spark, tmp_path / "in", schema)
    m1 = ("m1", T0, "mailer@shopify.com", "s", "b")
    feed.add(m1, m1, ("m2", T0, "x@y.com", "s", "webinar"))
    assert len(out(spark, tmp_path, S.stream_inbox(feed.stream()))) == 2
    feed.add(m1, ("m3", T0 + timedelta(days=1), "x@y.com", "s", "b"))
    rows = out(spark, tmp_path, S.stream_inbox(feed.stream()))
    assert sorted((r["message_id"], r["rule_id"]) for r in rows) == [("m1", "R0.1"), ("m2", "R2"), ("m3", "R4")]
    batch = R.triage(spark.read.schema(schema).parquet(feed.path).dropDuplicates(["message_id"]))
    assert sorted((r["message_id"], r["rule_id"]) for r in batch.collect()) == sorted((r["message_id"], r["rule_id"]) for r in rows)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_match_and_scores_over_several_runs(spark, tmp_path, rocksdb):
    """Newest draft first, one draft per reply, expiry by timers, state kept between runs, texts joined in the sink."""
    drafts, sent = Feed(spark, tmp_path / "d", DRAFT), Feed(spark, tmp_path / "s", SENT)
    drafts.add(("old", "t", T0, "hello"), ("new", "t", T0 + timedelta(hours=1), "hello"), ("lone", "u", T0, "x"), ("blank", "", T0, "x"))
    sent.add(("t", "m1", "hello", T0 + timedelta(hours=2)), ("", "m0", "x", T0 + timedelta(hours=2)))

    def run():
        events = S.stream_reconcile(S.match_events(drafts.stream(), sent.stream()))
        sink = S.match_sink(spark.read.parquet(drafts.path), spark.read.parquet(sent.path), f"{tmp_path}/out")
        S.run_batches(events, sink, f"{tmp_path}/progress")
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return sorted((r["draft_id"], r["status"], r["message_id"], r["result"]) for r in rows)

    assert run() == []  # the watermark has not passed the reply yet
    sent.add(("t", "m2", "jello", T0 + timedelta(hours=3)), ("t", "m3", "none left", T0 + timedelta(hours=4)))
    assert run() == [("new", "RECONCILED", "m1", "PERFECT"), ("old", "RECONCILED", "m2", "MAJOR_EDIT")]
    drafts.add(("later", "v", T0 + timedelta(days=20), "x"))
    assert run() == [("lone", "ABANDONED", None, None), ("new", "RECONCILED", "m1", "PERFECT"), ("old", "RECONCILED", "m2", "MAJOR_EDIT")]


def batch_match(events, days=14):
    """The match of one thread on a list of (kind, id, time): walk through time with all open drafts in a list."""
    out, open_ = {}, []
    for kind, i, when in sorted(events, key=lambda e: (e[2], e[0] != "d", e[1])):
        if kind == "d":
            open_.append((when, i))
            continue
        able = [d for d in open_ if d[0] + days * DAY_US >= when]
        if able:
            newest = max(d[0] for d in able)
            taken = min(d for d in able if d[0] == newest)
            open_.remove(taken)
            out[taken[1]] = i
    return out


def test_settling_in_any_steps_and_orders_gives_the_batch_rows():
    """Random threads, settled at random watermarks, with events that arrive in any order before theirs."""
    r = random.Random(2)
    for _ in range(400):
        events = [(r.choice("ds"), f"{k}", r.randrange(0, 30) * DAY_US // 2) for k in range(r.randrange(0, 14))]
        drafts, replies, got, gone = {}, {}, {}, set()
        marks = sorted(r.sample(range(40 * DAY_US), 3))
        waiting = r.sample(events, len(events))
        for mark in [*marks, 60 * DAY_US]:
            for event in [e for e in waiting if e[2] <= mark or r.random() < 0.5]:
                waiting.remove(event)
                (drafts if event[0] == "d" else replies)[event[1]] = event[2]
            now_d, now_r = ([(t, i) for i, t in x.items() if t <= mark] for x in (drafts, replies))
            done, _ = settle(now_d, now_r, mark, 14)
            for _, i in now_r:
                del replies[i]
            for d, m, status, when in done:
                assert when <= mark and drafts.pop(d) <= when
                if status == "RECONCILED":
                    got[d] = m
                else:
                    gone.add(d)
        assert got == batch_match(events)
        assert gone == {i for kind, i, _ in events if kind == "d"} - set(got) and not drafts


@pytest.mark.parametrize("cuts", [(), (1, 3, 4)])
def test_match_does_not_depend_on_order_or_batches(spark, tmp_path, rocksdb, cuts):
    """Events arrive up to the delay late, the reply before its draft and the later draft before the reply, in several batches."""
    day, minute = timedelta(days=1), timedelta(minutes=1)
    events = [
        ("d", "young", "t", T0 + 30 * minute), ("s", "m1", "t", T0), ("d", "b", "t", T0 - 10 * minute), ("d", "a", "t", T0 - 20 * minute),
        ("s", "m2", "t", T0 + 40 * minute), ("s", "late", "t", T0 + 20 * day), ("d", "c", "t", T0 + 21 * day), ("s", "m3", "t", T0 + 35 * day),
        ("d", "end", "z", T0 + 60 * day),
    ]
    drafts, sent = Feed(spark, tmp_path / "d", DRAFT), Feed(spark, tmp_path / "s", SENT)
    drafts.add(("none", "", T0, "x"))
    sent.add(("", "none", "x", T0))
    for start, end in zip((0, *cuts), (*cuts, len(events)), strict=True):
        if made := [(i, t, when, "x") for kind, i, t, when in events[start:end] if kind == "d"]:
            drafts.add(*made)
        if replies := [(t, i, "x", when) for kind, i, t, when in events[start:end] if kind == "s"]:
            sent.add(*replies)
        rows = out(spark, tmp_path, S.stream_reconcile(S.match_events(drafts.stream(), sent.stream())))
    got = sorted((r["draft_id"], r["status"], r["message_id"], r["event_ts"]) for r in rows)
    assert got == [
        ("a", "ABANDONED", None, T0 - 20 * minute + 14 * day), ("b", "RECONCILED", "m1", T0), ("c", "RECONCILED", "m3", T0 + 35 * day),
        ("young", "RECONCILED", "m2", T0 + 40 * minute),
    ]


def test_simple_match_gives_unanswered_drafts(spark, tmp_path):
    drafts, sent = Feed(spark, tmp_path / "d", DRAFT), Feed(spark, tmp_path / "s", SENT)
    drafts.add(("a", "t", T0, "x"), ("b", "u", T0, "x"))
    sent.add(("t", "m1", "x", T0 + timedelta(hours=1)))
    drafts.add(("late", "z", T0 + timedelta(days=20), "x"))
    sent.add(("z2", "m9", "x", T0 + timedelta(days=20)))
    rows = out(spark, tmp_path, S.stream_match_simple(drafts.stream(), sent.stream()))
    assert sorted((r["draft_id"], r["status"]) for r in rows) == [("a", "RECONCILED"), ("b", "ABANDONED")]


def test_staging_is_idempotent(spark, tmp_path):
    def line(i, when="2024-03-01T10:00:00Z"):
        return json.dumps({"draft_id": i, "created_at": when})

    (tmp_path / "in").mkdir()
    log = f"{tmp_path}/log"
    sink = S.staging_sink(log)

    def run(progress):
        S.run_batches(spark.readStream.text(f"{tmp_path}/in"), sink, f"{tmp_path}/{progress}")
        return sorted(r["draft_id"] for r in spark.read.parquet(log).collect())

    (tmp_path / "in" / "1").write_text("\n".join([line("a"), line("a"), "{bad", "", line("b", "2024-03-02T10:00:00Z")]))
    assert run("p") == ["a", "b"]
    (tmp_path / "in" / "2").write_text("\n".join([line("a"), line("c")]))
    assert run("p") == ["a", "b", "c"]
    assert run("lost-progress") == ["a", "b", "c"]


def test_staged_ids_are_unique_over_days_and_rejects_are_kept(spark, tmp_path):
    def line(i, when):
        return json.dumps({"draft_id": i, "created_at": when})

    (tmp_path / "in").mkdir()
    log = f"{tmp_path}/log"
    for k, lines in enumerate([[line("a", "2024-01-01T10:00:00Z"), "{bad"], [line("a", "2024-01-05T10:00:00Z"), line(None, "2024-01-05T10:00:00Z"), line("b", "?")]]):
        (tmp_path / "in" / str(k)).write_text("\n".join(lines))
        S.run_batches(spark.readStream.text(f"{tmp_path}/in"), S.staging_sink(log), f"{tmp_path}/p")
    assert [r["draft_id"] for r in spark.read.parquet(log).collect()] == ["a"]
    rejects = spark.read.parquet(f"{log}_rejected").collect()
    assert sorted((r["batch"], r["reason"]) for r in rejects) == [(0, "not a JSON object"), (1, "created_at unreadable"), (1, "draft_id missing")]


def drafts_of(spark, *ids, day="2024-03-01"):
    rows = [(i, datetime.fromisoformat(f"{day} 10:00:00"), "PENDING") for i in ids]
    return spark.createDataFrame(rows, "draft_id string, created_at timestamp, status string")


def test_index_of_ids_grows_and_is_read_in_part(spark, tmp_path):
    """Buckets are dealt anew when they get large, and a batch reads its own ones only."""
    path = f"{tmp_path}/log"
    log = DraftLog(spark, path, bucket_ids=20)
    log.add(drafts_of(spark, *[f"a{k}" for k in range(100)]))
    assert log.depth() == 3
    log.add(drafts_of(spark, "a1", "b1", "a99", day="2024-03-02"))
    stored = [r["draft_id"] for r in spark.read.parquet(path).collect()]
    assert sorted(stored) == sorted([*[f"a{k}" for k in range(100)], "b1"])
    few = drafts_of(spark, "a5", "a6")
    known, touched = log.known(few, 3)
    assert len(touched) <= 2 and known.count() < 60 and known.filter("draft_id in ('a5', 'a6')").count() == 2
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:40]


def test_a_cut_short_append_is_finished(spark, tmp_path):
    """Rows that were set down are added once, whether the log or the index had got them already."""
    path = f"{tmp_path}/log"
    DraftLog(spark, path).add(drafts_of(spark, "a"))
    pending = drafts_of(spark, "b", "c").withColumn("created_day", F.to_date("created_at"))
    pending.write.parquet(f"{path}_pending")
    pending.filter("draft_id = 'b'").write.mode("append").partitionBy("created_day").parquet(path)
    DraftLog(spark, path).add(drafts_of(spark, "c", "d", day="2024-03-09"))
    assert sorted(r["draft_id"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]
    DraftLog(spark, path).add(drafts_of(spark, "a", "b", "c", "d", day="2024-03-10"))
    assert spark.read.parquet(path).count() == 4


def test_kb_refresh_adds_only_new(spark, tmp_path):
    def doc(answer):
        return f"### Function 1: T\n**Approved Language:**\n> {answer}\n"

    feed = Feed(spark, tmp_path / "in", "filename string, text string").add(("CANONICAL_skill_a.md", doc("one")))
    sink = S.kb_sink(f"{tmp_path}/kb", T0)
    S.run_batches(feed.stream(), sink, f"{tmp_path}/p")
    feed.add(("CANONICAL_skill_a.md", doc("one")), ("CANONICAL_skill_b.md", doc("two")))
    S.run_batches(feed.stream(), sink, f"{tmp_path}/p")
    assert sorted(r["canonical_answer"] for r in spark.read.parquet(f"{tmp_path}/kb").collect()) == ["one", "two"]


def test_work_path_follows_the_cluster_setting():
    """The setting is fixed when a session starts, so a stand-in session is asked."""
    chosen = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=chosen.append)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://shared/"), sparkContext=context)
    assert work_path(session, "x").startswith("hdfs://shared/x-") and chosen == ["hdfs://shared/"]


def test_trend_closes_only_whole_days(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "reconciled_at timestamp, accuracy_score double")
    feed.add((T0, 50.0), (T0 + timedelta(hours=5), 100.0), (T0 + timedelta(days=1, hours=2), 10.0))
    rows = out(spark, tmp_path, S.stream_trend(feed.stream()))
    assert [(r["window_start"], r["reconciled"], r["avg_accuracy"]) for r in rows] == [(T0, 2, 75.0)]


def test_rolling_windows_come_from_daily_sums(spark, tmp_path):
    """Each event is expanded once, into its day; days without a score count, and add nothing to the mean."""
    feed = Feed(spark, tmp_path / "in", "reconciled_at timestamp, accuracy_score double")
    day = timedelta(days=1)
    feed.add((T0, 50.0), (T0 + day, 100.0), (T0 + 2 * day, None), (T0 + 8 * day, 10.0), (T0 + 20 * day, 1.0))
    rows = out(spark, tmp_path, S.stream_rolling(feed.stream()))
    got = {r["window_start"]: (r["reconciled"], r["avg_accuracy"]) for r in rows}
    assert got[T0 - 6 * day] == (1, 50.0) and got[T0] == (3, 75.0) and got[T0 + 2 * day] == (2, 10.0) and len(got) == 15


@pytest.mark.parametrize("one_file", [True, False])
def test_tables_of_one_file_and_of_many_are_streamed_whole(spark, tmp_path, one_file):
    from postmill.plans import views as V

    rows, made = spark.range(40).toDF("event_id"), tmp_path / ("made" if one_file else "events.parquet")
    rows.repartition(1 if one_file else 4).write.parquet(str(made))
    if one_file:
        next(made.glob("part-*")).rename(tmp_path / "events.parquet")
    spark.range(5).toDF("event_id").write.parquet(str(tmp_path / "events_other.parquet"))
    S.run_available(V.stream(spark, str(tmp_path), "events"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
