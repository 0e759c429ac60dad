"""The incremental forms: the same operators over streams of mail, drafts and replies.

Functions take and return streaming DataFrames; ``run_available`` drains a stream once, as a
scheduled poll would, with its progress kept in a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scoring import score
from ..operators.kb import build_kb
from ..operators.rules import triage
from ..sources.draft_log import BUCKET_IDS, DraftLog
from ..sources.files import exists
from ..sources.staging import flush_staging, parse_staging


def _drained(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived into parquet files at ``path`` and stop."""
    return _drained(
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """The same with a function per micro-batch."""
    return _drained(
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def once_per_message(messages: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each message once; repeats and messages later than ``lateness`` are dropped."""
    return messages.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["message_id"])


def stream_inbox(messages: DataFrame, lateness: str = "7 days") -> DataFrame:
    return triage(once_per_message(messages, lateness))


def stream_trend(accuracy: DataFrame, ts: str = "reconciled_at", delay: str = "1 hour") -> DataFrame:
    """Daily counts and average accuracy; a day appears once the watermark has passed its end."""
    return _trend(accuracy, F.window(ts, "1 day"), ts, delay)


def stream_rolling(accuracy: DataFrame, ts: str = "reconciled_at", delay: str = "1 hour", days: int = 7) -> DataFrame:
    """The same over ``days``-day windows that start every day, added up from the days' sums and not from copies of the rows."""
    daily = (
        accuracy.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("accuracy_score").alias("scored"), F.sum("accuracy_score").alias("total"))
    )
    rolled = daily.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day").alias("w")).agg(
        F.sum("n").alias("reconciled"), F.round(F.try_divide(F.sum("total"), F.sum("scored")), 1).alias("avg_accuracy")
    )
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "reconciled", "avg_accuracy")


def _trend(accuracy: DataFrame, window, ts: str, delay: str) -> DataFrame:
    return (
        accuracy.withWatermark(ts, delay).groupBy(window.alias("w"))
        .agg(F.count(F.lit(1)).alias("reconciled"), F.round(F.avg("accuracy_score"), 1).alias("avg_accuracy"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "reconciled", "avg_accuracy")
    )


def stream_bursts(messages: DataFrame, gap: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Runs of messages of a thread with less than ``gap`` between them, and their length."""
    return (
        messages.withWatermark("received_at", delay)
        .groupBy("thread_id", F.session_window("received_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("contacts"))
        .select("thread_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "contacts")
    )


def stream_match_simple(drafts: DataFrame, sent: DataFrame, delay: str = "1 hour", days: int = 14) -> DataFrame:
    """Every draft with every reply of its thread within ``days`` of it, by interval join.

    Drafts without any reply come out, with null reply columns, once they can get none: ABANDONED.
    """
    d = drafts.filter(F.col("thread_id") != "").withWatermark("created_at", delay).alias("d")
    s = sent.filter(F.col("thread_id") != "").withWatermark("sent_at", delay).alias("s")
    within = F.expr(
        f"d.thread_id = s.thread_id AND s.sent_at >= d.created_at AND s.sent_at <= d.created_at + INTERVAL {days} DAYS"
    )
    return d.join(s, within, "left_outer").select(
        "d.draft_id", "d.thread_id", "d.created_at", "d.draft_text",
        F.col("s.message_id").alias("message_id"), F.col("s.sent_at").alias("sent_at"),
        F.col("s.body").alias("final_sent"),
        F.when(F.col("s.message_id").isNull(), "ABANDONED").otherwise("RECONCILED").alias("status"),
    )


EVENT_COLUMNS = "thread_id string, event_ts timestamp, draft_id string, message_id string"
MATCH_COLUMNS = "thread_id string, draft_id string, message_id string, status string, event_ts timestamp"


def match_events(drafts: DataFrame, sent: DataFrame) -> DataFrame:
    """Drafts and replies as one stream of ids and times for ``stream_reconcile``; their texts stay in their tables."""
    none = F.lit(None).cast("string")
    made = drafts.select("thread_id", F.col("created_at").alias("event_ts"), "draft_id", none.alias("message_id"))
    left = sent.select("thread_id", F.col("sent_at").alias("event_ts"), none.alias("draft_id"), F.coalesce("message_id", F.lit("")).alias("message_id"))
    return made.unionByName(left).filter(F.col("thread_id") != "")


def stream_reconcile(events: DataFrame, delay: str = "1 hour", days: int = 14) -> DataFrame:
    """Each reply takes the latest draft of its thread that was open when it was sent; drafts open over ``days`` are abandoned.

    (thread_id, draft_id, message_id, status, event_ts), each once the watermark, ``delay`` behind the newest event, has
    passed it. Events within the delay may arrive in any order. State holds ids and times. Needs the RocksDB state store.
    """
    from .matcher import DraftMatcher

    return (
        events.withWatermark("event_ts", delay).groupBy("thread_id")
        .transformWithStateInPandas(
            statefulProcessor=DraftMatcher(days), outputStructType=MATCH_COLUMNS, outputMode="Append", timeMode="EventTime",
        )
    )


def score_matches(matches: DataFrame, drafts: DataFrame, sent: DataFrame) -> DataFrame:
    """Matches with their scores; the texts are joined from the draft log and the sent mail, and only those that matched."""
    texts = drafts.select("draft_id", "draft_text")
    bodies = sent.select("thread_id", F.coalesce("message_id", F.lit("")).alias("message_id"), F.col("body").alias("final_sent"))
    scored = score(matches.join(texts, "draft_id", "left").join(bodies, ["thread_id", "message_id"], "left"))
    done = F.col("status") == "RECONCILED"
    return scored.select(
        "thread_id", "draft_id", "message_id", "status", "event_ts",
        *[F.when(done, F.col(c)).alias(c) for c in ("edit_distance", "total_chars", "edit_pct", "accuracy_score", "result")],
    )


def match_sink(drafts: DataFrame, sent: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: the matches of ``stream_reconcile`` with scores, below ``path`` by batch; a replay replaces its batch.

    ``drafts`` and ``sent`` are the tables that hold the texts. A batch's matches are written before they are joined, as its
    state must be read once only; files partitioned by day are pruned by the days that the batch names.
    """
    root = path.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        found, spark = f"{root}_ids/batch={batch_id}", batch.sparkSession
        batch.write.mode("overwrite").parquet(found)
        matches = spark.read.schema(batch.schema).parquet(found)
        score_matches(matches, drafts, sent).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return handle


def staging_sink(log_path: str, rejects_path: str | None = None, bucket_ids: int = BUCKET_IDS) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: staged JSON lines into the draft log at ``log_path``, by day of creation.

    A draft id is added once, whatever day its repetitions carry. The ids of the log stand in an index beside it, of which a
    batch reads the buckets of its own ids only. A batch replayed after a failure adds nothing, and what a failure cut
    short is finished first. Lines that cannot be used are written to ``rejects_path`` (by default beside the log) as
    (line, reason), by batch; a replay replaces them.
    """
    rejects_path = rejects_path or f"{log_path.rstrip('/')}_rejected"

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows, broken = parse_staging(batch)
        fresh, without_id, _ = flush_staging(rows)
        DraftLog(batch.sparkSession, log_path, bucket_ids).add(fresh)
        unusable = without_id.select(F.to_json(F.struct(*[c for c in without_id.columns if c != "reason"])).alias("line"), "reason")
        rejects = broken.select(F.col("value").alias("line"), F.lit("not a JSON object").alias("reason")).unionByName(unusable)
        rejects.write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch={batch_id}")

    return handle


def kb_sink(kb_path: str, as_of, embed=None) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler: skill files (filename, text) into the knowledge base at ``kb_path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(kb_path) if exists(spark, kb_path) else None
        build_kb(batch, known, as_of, embed).write.mode("append").parquet(kb_path)

    return handle
