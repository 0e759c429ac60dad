"""The streaming forms, drained over the given tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_path
from ..streaming import streams as S
from . import views as V
from .catalog import query
from .knowledge_queries import BUILT, digest, skill_files
from .mail_queries import TRI
from .oracle import with_tables
from .report_queries import scored

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = work_path(spark, name)
    S.run_available(stream, f"{root}/out", f"{root}/progress")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return V.user_events(spark, d, V.stream).withColumnRenamed("received_at", "reconciled_at")


@query("""
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS reconciled, round(avg(value), 1) AS avg_accuracy
    FROM events GROUP BY 1
    HAVING CAST(date_trunc('day', min(ts)) AS TIMESTAMP) + INTERVAL 1 DAY
           <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = _drain(spark, S.stream_trend(_events(spark, d)), "trend")
    return rows.select("window_start", "reconciled", "avg_accuracy")


@query("""
    SELECT s AS window_start, count(*) AS reconciled, round(avg(value), 1) AS avg_accuracy
    FROM events, (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE) - 7, CAST(max(ts) AS DATE), INTERVAL 1 DAY))
                         AS TIMESTAMP) AS s FROM events) w
    WHERE ts >= s AND ts < s + INTERVAL 7 DAY
      AND s + INTERVAL 7 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)
    GROUP BY 1""")
def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = _drain(spark, S.stream_rolling(_events(spark, d)), "rolling")
    return rows.select("window_start", "reconciled", "avg_accuracy")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT 'U' || user_id AS thread_id, min(ts) AS burst_start, count(*) AS contacts FROM n GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_bursts(spark: SparkSession, d: str) -> DataFrame:
    rows = _drain(spark, S.stream_bursts(V.user_events(spark, d, V.stream)), "bursts")
    return rows.select("thread_id", "burst_start", "contacts")


@query(with_tables("SELECT message_id, rule_id, tag FROM tri", "inbox", extra=TRI))
def stream_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Every message arrives twice and is classified once."""
    mail = V.inbox(spark, d, V.stream)
    twice = mail.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return _drain(spark, S.stream_inbox(twice), "inbox").select("message_id", "rule_id", "tag")


MARK = "(SELECT least(max(d.created_at), max(s.sent_at)) - INTERVAL 1 HOUR FROM drafts d, (SELECT max(sent_at) AS sent_at FROM sent) s)"


@query(with_tables(f"""
    SELECT d.draft_id, s.message_id, CASE WHEN s.message_id IS NULL THEN 'ABANDONED' ELSE 'RECONCILED' END AS status
    FROM drafts d LEFT JOIN sent s ON s.thread_id = d.thread_id AND s.sent_at >= d.created_at
         AND s.sent_at <= d.created_at + INTERVAL 14 DAY
    WHERE s.message_id IS NOT NULL OR d.created_at + INTERVAL 14 DAY < {MARK}""", "sent"))
def stream_match_simple(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.stream_match_simple(V.drafts(spark, d, V.stream), V.sent(spark, d, V.stream))
    return _drain(spark, pairs, "match").select("draft_id", "message_id", "status")


LAST = "(SELECT max(t) - INTERVAL 1 HOUR FROM (SELECT max(created_at) AS t FROM drafts UNION ALL SELECT max(sent_at) FROM sent))"


@query(with_tables(f"""
    SELECT draft_id, message_id, 'RECONCILED' AS status, edit_distance, result FROM pairs
    UNION ALL SELECT draft_id, NULL, 'ABANDONED', NULL, NULL FROM drafts
    WHERE draft_id NOT IN (SELECT draft_id FROM pairs) AND created_at + INTERVAL 14 DAY <= {LAST}""",
    "sent", extra={"pairs": scored(
        f"SELECT draft_id, s.message_id, draft_text, body FROM drafts JOIN sent s USING (conv_id, turn) WHERE s.sent_at <= {LAST}")}))
def stream_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Matches of ids in event time; texts are joined and scored in the sink."""
    events = S.match_events(V.drafts(spark, d, V.stream), V.sent(spark, d, V.stream))
    root = work_path(spark, "reconcile")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        S.run_batches(S.stream_reconcile(events), S.match_sink(V.drafts(spark, d), V.sent(spark, d), f"{root}/out"), f"{root}/progress")
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{root}/out").select("draft_id", "message_id", "status", "edit_distance", "result")


@query(with_tables("""
    SELECT message_id AS draft_id, thread_id, received_at AS created_at, 'PENDING' AS status, CAST(NULL AS VARCHAR) AS reason, 1 AS lines
    FROM messages WHERE role <> 'system'
    UNION ALL SELECT NULL, thread_id, NULL, 'REJECTED', 'draft_id missing', 2 * count(*) FROM messages WHERE role = 'system' GROUP BY thread_id
    UNION ALL SELECT NULL, NULL, NULL, 'REJECTED', 'not a JSON object', count(*) FROM messages""", "messages"))
def stream_staging(spark: SparkSession, d: str) -> DataFrame:
    """Staged lines become draft-log rows; each line arrives twice, and with each a broken one."""
    record = F.struct(
        F.when(F.col("role") != "system", F.col("message_id")).alias("draft_id"), "thread_id",
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("body").alias("draft_text"))
    lines = V.messages(spark, d, V.stream).select(
        F.explode(F.array(F.to_json(record), F.to_json(record), F.lit("{broken"))).alias("value"))
    root = work_path(spark, "staging")
    S.run_batches(lines, S.staging_sink(f"{root}/log"), f"{root}/progress")
    log = spark.read.parquet(f"{root}/log").select("draft_id", "thread_id", "created_at", "status")
    rejects = spark.read.parquet(f"{root}/log_rejected").withColumn("thread_id", F.get_json_object("line", "$.thread_id"))
    none = F.lit(None).cast("string")
    counted = rejects.groupBy("thread_id", "reason").agg(F.count("*").alias("lines")).select(
        none.alias("draft_id"), "thread_id", F.lit(None).cast("timestamp").alias("created_at"), F.lit("REJECTED").alias("status"), "reason", "lines")
    return log.withColumns({"reason": none, "lines": F.lit(1).cast("long")}).unionByName(counted)


@query(BUILT)
def stream_kb(spark: SparkSession, d: str) -> DataFrame:
    root = work_path(spark, "kb")
    files = skill_files(spark, d, V.stream)
    S.run_batches(files, S.kb_sink(f"{root}/kb", V.MAIL_NOW), f"{root}/progress")
    return spark.read.parquet(f"{root}/kb").select("content_hash", "category", digest())
