"""Queries over drafts, replies and the accuracy log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scoring import score
from ..operators import dashboard as D, graduate as G, reconcile as C
from ..schemas import SENTIMENTS
from ..session import work_path, written
from ..sources.files import write_report
from . import views as V
from .catalog import query
from .oracle import one_byte, with_tables

TREND_NOW = "2001-10-30 12:00:00"


def scored(rows: str) -> str:
    """Scores of (draft_text, body) rows in SQL."""
    return f"""
        SELECT *, round(greatest(0, least(100, 100 - edit_pct)), 4) AS accuracy_score,
            CASE WHEN edit_pct = 0 THEN 'PERFECT' WHEN edit_pct < 5 THEN 'MINOR_EDIT' WHEN edit_pct <= 50 THEN 'MAJOR_EDIT'
                 ELSE 'REWRITE' END AS result
        FROM (SELECT *, CAST(length(draft_text) AS INTEGER) AS total_chars,
                CAST(levenshtein({one_byte('draft_text')}, {one_byte('body')}) AS INTEGER) AS edit_distance,
                CASE WHEN length(draft_text) > 0
                     THEN round(levenshtein({one_byte('draft_text')}, {one_byte('body')}) / length(draft_text) * 100, 4)
                     ELSE 0.0 END AS edit_pct
              FROM ({rows}))"""


LATEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, draft_id) AS n FROM drafts)
    WHERE n = 1"""
REPLIES = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY sent_at DESC, message_id) AS n FROM sent)
    WHERE n = 1"""
MATCHED = scored("""
    SELECT l.draft_id, l.thread_id, r.message_id, l.email_category, l.draft_text, r.body
    FROM latest l JOIN replies r USING (thread_id)""")
MATCH = {"latest": LATEST, "replies": REPLIES, "matched": MATCHED}
SCORE_COLUMNS = "edit_distance, total_chars, edit_pct, accuracy_score, result"


@query(with_tables(f"SELECT draft_id, {SCORE_COLUMNS} FROM pairs", "sent", extra={"pairs": scored("""
    SELECT draft_id, draft_text, body FROM drafts JOIN sent USING (conv_id, turn)""")}))
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    replies = V.sent(spark, d).select("conv_id", "turn", F.col("body").alias("final_sent"))
    pairs = V.drafts(spark, d).select("draft_id", "conv_id", "turn", "draft_text").join(replies, ["conv_id", "turn"])
    return score(C.deal(pairs), by_bits=True).select("draft_id", *SCORE_COLUMNS.split(", "))


@query(with_tables(f"SELECT draft_id, thread_id, message_id, {SCORE_COLUMNS}, false AS semantic_match FROM matched",
                   "sent", extra=MATCH))
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    accuracy, _ = C.reconcile(C.pending_drafts(V.drafts(spark, d)), V.sent(spark, d), V.MAIL_NOW)
    return accuracy.select("draft_id", "thread_id", "message_id", *SCORE_COLUMNS.split(", "), "semantic_match")


@query(with_tables("""
    SELECT draft_id, message_id FROM (
        SELECT d.draft_id, r.message_id, row_number() OVER (PARTITION BY d.thread_id ORDER BY d.created_at DESC, d.draft_id) AS k
        FROM drafts d JOIN replies r ON r.thread_id = d.thread_id AND d.created_at <= r.sent_at) WHERE k = 1""",
    "sent", extra={"replies": REPLIES}))
def reconcile_strict_time(spark: SparkSession, d: str) -> DataFrame:
    pairs = C.match(C.pending_drafts(V.drafts(spark, d)), V.sent(spark, d), strict_time=True)
    return pairs.select("draft_id", F.col("sent_message_id").alias("message_id"))


@query(with_tables("""
    SELECT l.draft_id, r.message_id FROM latest l JOIN (
        SELECT thread_id, arg_max(message_id, sent_at) AS message_id FROM sent
        WHERE message_id NOT IN (SELECT message_id FROM replies) GROUP BY 1) r USING (thread_id)""",
    "sent", extra={"latest": LATEST, "replies": REPLIES}))
def reconcile_consume_sent(spark: SparkSession, d: str) -> DataFrame:
    """A second run: replies that the first one used do not serve again."""
    drafts, sent = C.pending_drafts(V.drafts(spark, d)), V.sent(spark, d)
    log, _ = C.reconcile(drafts, sent, V.MAIL_NOW)
    pairs = C.match(drafts, sent, consume_sent=True, accuracy_log=log.select("message_id"))
    return pairs.select("draft_id", F.col("sent_message_id").alias("message_id"))


@query(with_tables("SELECT draft_id, thread_id, created_at FROM drafts", "drafts"))
def pending_drafts(spark: SparkSession, d: str) -> DataFrame:
    return C.pending_drafts(V.drafts(spark, d)).select("draft_id", "thread_id", "created_at").orderBy("created_at", "draft_id")


@query(with_tables("SELECT thread_id, draft_id FROM latest", "drafts", extra={"latest": LATEST}))
def latest_pending(spark: SparkSession, d: str) -> DataFrame:
    return C.latest_per_thread(C.pending_drafts(V.drafts(spark, d))).select("thread_id", "draft_id")


@query(with_tables("SELECT thread_id, message_id FROM replies", "sent", extra={"replies": REPLIES}))
def first_sent(spark: SparkSession, d: str) -> DataFrame:
    return C.first_sent_per_thread(V.sent(spark, d)).select("thread_id", "message_id")


@query(with_tables("""
    SELECT draft_id, 'ABANDONED' AS event FROM draft_log
    WHERE status = 'PENDING' AND created_at < TIMESTAMP '2001-10-16 12:00:00'""", "draft_log"))
def abandon(spark: SparkSession, d: str) -> DataFrame:
    return C.abandon(V.draft_log(spark, d), TREND_NOW).select("draft_id", "event")


@query(with_tables("""
    SELECT d.draft_id, CASE WHEN m.draft_id IS NOT NULL THEN 'RECONCILED'
        WHEN d.created_at < TIMESTAMP '2024-01-17' THEN 'ABANDONED' ELSE 'PENDING' END AS status
    FROM drafts d LEFT JOIN (SELECT l.draft_id FROM latest l JOIN replies USING (thread_id)) m USING (draft_id)""",
    "sent", extra={"latest": LATEST, "replies": REPLIES}))
def run_cycle(spark: SparkSession, d: str) -> DataFrame:
    _, log = C.run_cycle(V.drafts(spark, d), V.sent(spark, d), V.MAIL_NOW)
    return log.select("draft_id", "status")


@query(with_tables("""
    SELECT draft_id, arg_max(event, (event_ts, w)) AS status FROM (
        SELECT draft_id, 'PENDING' AS event, created_at AS event_ts, 0 AS w FROM draft_log
        UNION ALL SELECT draft_id, status, created_at, CASE status WHEN 'RECONCILED' THEN 2 WHEN 'ABANDONED' THEN 1 ELSE 0 END
        FROM draft_log)
    GROUP BY 1""", "draft_log"))
def current_status(spark: SparkSession, d: str) -> DataFrame:
    log = V.draft_log(spark, d)
    made = log.select("draft_id", F.lit("PENDING").alias("event"), F.col("created_at").alias("event_ts"))
    later = log.select("draft_id", F.col("status").alias("event"), F.col("created_at").alias("event_ts"))
    return C.current_status(made.unionByName(later))


COUNTS = ", ".join(
    f"count(*) FILTER (result = '{r}') AS {r.lower()}" for r in ("PERFECT", "MINOR_EDIT", "MAJOR_EDIT", "REWRITE"))
CLEAN = "count(*) FILTER (result IN ('PERFECT', 'MINOR_EDIT')) / count(*) * 100"
BY_CATEGORY = f"""
    SELECT email_category, count(*) AS total, {COUNTS}, round(avg(accuracy_score), 1) AS avg_accuracy,
           round({CLEAN}, 1) AS pct_clean
    FROM accuracy_log JOIN draft_log USING (draft_id) GROUP BY 1"""


@query(with_tables("""
    SELECT status, count(*) AS drafts FROM draft_log GROUP BY 1
    UNION ALL SELECT 'TOTAL', count(*) FROM draft_log""", "draft_log"))
def pipeline_health(spark: SparkSession, d: str) -> DataFrame:
    return D.pipeline_health(V.draft_log(spark, d)).orderBy("status")


@query(with_tables("""
    SELECT count(*) AS total, count(*) FILTER (status = 'RECONCILED') AS reconciled,
           count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'ABANDONED') AS abandoned,
           round(count(*) FILTER (status = 'RECONCILED') / count(*) * 100, 1) AS pct_reconciled
    FROM draft_log""", "draft_log"))
def reconciled_share(spark: SparkSession, d: str) -> DataFrame:
    return D.reconciled_share(V.draft_log(spark, d))


@query(with_tables(BY_CATEGORY, "accuracy_log", "draft_log"))
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return D.accuracy_by_category(V.accuracy_log(spark, d), V.draft_log(spark, d)).orderBy(F.desc("total"))


@query(with_tables(f"""
    SELECT email_category, count(*) AS total, {COUNTS}, round(avg(accuracy_score), 1) AS avg_accuracy,
           round({CLEAN}, 1) AS pct_clean
    FROM matched GROUP BY 1""", "sent", extra=MATCH))
def reconciled_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """From mail to report in one plan: match, score, aggregate."""
    drafts = V.drafts(spark, d)
    accuracy, _ = C.reconcile(C.pending_drafts(drafts), V.sent(spark, d), V.MAIL_NOW)
    return D.accuracy_by_category(accuracy, drafts)


@query(with_tables(f"""
    SELECT CAST(reconciled_at AS DATE) AS day, count(*) AS reconciled, round(avg(accuracy_score), 1) AS avg_accuracy, {COUNTS}
    FROM accuracy_log WHERE reconciled_at >= TIMESTAMP '2001-10-23 12:00:00' GROUP BY 1""", "accuracy_log"))
def daily_trend(spark: SparkSession, d: str) -> DataFrame:
    return D.daily_trend(V.accuracy_log(spark, d), TREND_NOW).orderBy("day")


GRADUATES = f"""
    SELECT email_category, count(*) AS total, round({CLEAN}, 1) AS pct_clean, round(avg(accuracy_score), 1) AS avg_accuracy
    FROM accuracy_log JOIN draft_log USING (draft_id) GROUP BY 1 HAVING count(*) >= %d AND {CLEAN} >= %s"""


@query(with_tables(GRADUATES % (100, 25.0), "accuracy_log", "draft_log"))
def graduation_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = D.graduation_candidates(V.accuracy_log(spark, d), V.draft_log(spark, d), min_pct=25.0)
    return rows.orderBy(F.desc("pct_clean"))


@query(with_tables(GRADUATES % (100, 95.0), "accuracy_log", "draft_log"))
def graduation_default(spark: SparkSession, d: str) -> DataFrame:
    return D.graduation_candidates(V.accuracy_log(spark, d), V.draft_log(spark, d))


@query(with_tables("SELECT email_category, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (sentiment = '{s}') AS {s.lower()}" for s in SENTIMENTS) + " FROM draft_log GROUP BY 1", "draft_log"))
def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return D.intent_distribution(V.draft_log(spark, d), "sentiment", SENTIMENTS)


def _distribution(column: str, values) -> str:
    counts = ", ".join(f"count(*) FILTER ({column} = '{v}') AS {v.lower()}" for v in values)
    return with_tables(f"SELECT email_category, count(*) AS total, {counts} FROM draft_log GROUP BY 1", "draft_log")


KNOWN_INTENTS, KNOWN_RISKS = [i for i in V.INTENTS if i], ("LOW", "MEDIUM", "HIGH")


@query(_distribution("primary_intent", KNOWN_INTENTS))
def intent_distribution(spark: SparkSession, d: str) -> DataFrame:
    return D.intent_distribution(V.draft_log(spark, d), "primary_intent", KNOWN_INTENTS)


@query(_distribution("escalation_risk", KNOWN_RISKS))
def escalation_distribution(spark: SparkSession, d: str) -> DataFrame:
    return D.intent_distribution(V.draft_log(spark, d), "escalation_risk", KNOWN_RISKS)


@query(with_tables("""
    SELECT left(coalesce(email_category, 'UNKNOWN'), 40) AS category, total, pct_clean,
           coalesce(pct_clean, 0) >= 24.5 AND total >= 100 AS starred
    FROM by_category""", "accuracy_log", "draft_log", extra={"by_category": BY_CATEGORY}))
def starred_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = D.accuracy_by_category(V.accuracy_log(spark, d), V.draft_log(spark, d))
    return D.star(rows, min_pct=24.5).select("category", "total", "pct_clean", "starred")


def _r(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {width}, ' ')"


def _d(expr: str, width: int) -> str:
    return f"lpad(printf('%.1f', {expr}), {width}, ' ')"


_RULE = "repeat('=', 60)"
_RESULTS = " || ' ' || ".join(_r(c, w) for c, w in (("perfect", 7), ("minor_edit", 6), ("major_edit", 6), ("rewrite", 7)))


def _head(section: int, title: str) -> str:
    return f"SELECT {section}, unnest([0, 1, 2, 3]), '', unnest(['', {_RULE}, '  {title}', {_RULE}])"


_HEAD = " || ' ' || ".join(f"lpad('{c}', {w}, ' ')" for c, w in (("PERFECT", 7), ("MINOR", 6), ("MAJOR", 6), ("REWRITE", 7)))
REPORT = f"""
    SELECT CAST(row_number() OVER (ORDER BY section, pos, name) AS INTEGER) AS line_no, line FROM (
    SELECT 0 AS section, CAST(unnest([0, 1]) AS DOUBLE) AS pos, '' AS name,
           unnest([{_RULE}, '  WEEKLY ACCURACY REPORT']) AS line
    UNION ALL SELECT 1, 0, '', '  Generated: 2001-10-30 12:00 UTC' UNION ALL SELECT 2, 0, '', {_RULE}
    UNION ALL {_head(10, '1. PIPELINE HEALTH  (draft_log all-time)')}
    UNION ALL SELECT 11, unnest([1, 2, 3, 4]), '', unnest(['  Total drafts created :  ' || count(*),
        '  Reconciled           :  ' || count(*) FILTER (status = 'RECONCILED') || '  (' ||
            printf('%.1f', round(count(*) FILTER (status = 'RECONCILED') / count(*) * 100, 1)) || '%)',
        '  Pending (unsent)     :  ' || count(*) FILTER (status = 'PENDING'),
        '  Abandoned (14d+)     :  ' || count(*) FILTER (status = 'ABANDONED')]) FROM draft_log
    UNION ALL {_head(20, '2. ACCURACY BY CATEGORY  (all time)')}
    UNION ALL SELECT 22, unnest([0, 1]), '', unnest(['  ' || rpad('Category', 40, ' ') || ' ' || lpad('Total', 6, ' ') ||
        ' ' || lpad('Avg', 6, ' ') || ' ' || lpad('Clean%', 7, ' ') || '  ' || {_HEAD}, '  ' || repeat('-', 92)])
    UNION ALL SELECT 23, -total, coalesce(email_category, 'UNKNOWN'), '  ' ||
        rpad(coalesce(email_category, 'UNKNOWN'), 40, ' ') || ' ' || {_r('total', 6)} || ' ' || {_d('avg_accuracy', 6)} ||
        ' ' || {_d('pct_clean', 7)} || '%  ' || {_RESULTS} || CASE WHEN pct_clean >= 25 AND total >= 100 THEN ' ★' ELSE '' END
        FROM by_category
    UNION ALL SELECT 24, unnest([0, 1]), '', unnest(['', '  ★ marks categories of at least 25% clean replies over 100 emails or more'])
    UNION ALL {_head(30, '3. LAST 7 DAYS  (daily trend)')}
    UNION ALL SELECT 32, unnest([0, 1]), '', unnest(['  ' || rpad('Date', 12, ' ') || ' ' || lpad('Reconciled', 11, ' ') ||
        ' ' || lpad('Avg Acc', 8, ' ') || '  ' || {_HEAD}, '  ' || repeat('-', 68)])
    UNION ALL SELECT 33, date_diff('day', DATE '1970-01-01', day), '', '  ' || rpad(CAST(day AS VARCHAR), 12, ' ') || ' ' ||
        {_r('reconciled', 11)} || ' ' || {_d('avg_accuracy', 8)} || '%  ' || {_RESULTS} FROM daily
    UNION ALL {_head(40, '4. GRADUATION CANDIDATES  (≥25% clean, ≥100 emails)')}
    UNION ALL SELECT 42, unnest([0, 1]), '', unnest(['  ' || rpad('Category', 40, ' ') || ' ' || lpad('Total', 6, ' ') ||
        ' ' || lpad('Clean%', 7, ' ') || ' ' || lpad('Avg Acc', 8, ' '), '  ' || repeat('-', 66)])
    UNION ALL SELECT 43, -pct_clean, coalesce(email_category, 'UNKNOWN'), '  ' ||
        rpad(coalesce(email_category, 'UNKNOWN'), 40, ' ') || ' ' || {_r('total', 6)} || ' ' || {_d('pct_clean', 7)} || '% ' ||
        {_d('avg_accuracy', 8)} || '%' FROM graduates
    UNION ALL SELECT 44, unnest([0, 1]), '', unnest(['', '  Read some replies of each before it is switched to automatic sending.'])
    UNION ALL SELECT 50, unnest([0, 1, 2, 3]), '', unnest(['', {_RULE}, '  END OF REPORT', {_RULE}]))"""
DAILY = f"""
    SELECT CAST(reconciled_at AS DATE) AS day, count(*) AS reconciled, round(avg(accuracy_score), 1) AS avg_accuracy, {COUNTS}
    FROM accuracy_log WHERE reconciled_at >= TIMESTAMP '2001-10-23 12:00:00' GROUP BY 1"""


@query(with_tables(REPORT, "accuracy_log", "draft_log", extra={
    "by_category": BY_CATEGORY, "daily": DAILY, "graduates": GRADUATES % (100, 25.0)}))
def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    log, accuracy = V.draft_log(spark, d), V.accuracy_log(spark, d)
    # One row for each status, category and day, written once; the page reads them several times.
    by_category = written(D.category_accuracy(accuracy, log), "by-category")
    return D.render_report(
        written(D.pipeline_health(log), "health"), by_category, written(D.daily_trend(accuracy, TREND_NOW), "daily"),
        D.graduates(by_category, min_pct=25.0), TREND_NOW, min_pct=25.0)


@query(with_tables(f"SELECT line FROM ({REPORT})", "accuracy_log", "draft_log", extra={
    "by_category": BY_CATEGORY, "daily": DAILY, "graduates": GRADUATES % (100, 25.0)}))
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """The report written as a dated and a latest page, and the latest read back."""
    path = work_path(spark, "reports")
    write_report(weekly_report(spark, d), path, TREND_NOW[:10])
    return spark.read.text(f"{path}/latest").withColumnRenamed("value", "line")


AUTONOMY = f"""
    SELECT d.draft_id, d.email_category, d.status = 'ABANDONED' OR sentiment = 'ANGRY' AS edge_case,
        CASE WHEN d.status = 'ABANDONED' OR sentiment = 'ANGRY' THEN 'REVIEW' WHEN g.email_category IS NOT NULL THEN 'AUTO'
             ELSE 'REVIEW' END AS route
    FROM draft_log d LEFT JOIN graduates g ON g.email_category = d.email_category"""
AUTO = {"graduates": GRADUATES % (100, 25.0), "auto": AUTONOMY}


def _auto(spark: SparkSession, d: str) -> DataFrame:
    log, accuracy = V.draft_log(spark, d), V.accuracy_log(spark, d)
    config = written(G.graduation_config(D.graduation_candidates(accuracy, log, min_pct=25.0)), "graduation")
    flagged = log.withColumn("lookup_failed", F.col("status") == "ABANDONED").withColumn(
        "low_confidence", F.col("sentiment") == "ANGRY")
    return G.route_by_graduation(flagged, config)


@query(with_tables("SELECT draft_id, edge_case, route FROM auto", "accuracy_log", "draft_log", extra=AUTO))
def route_by_graduation(spark: SparkSession, d: str) -> DataFrame:
    return _auto(spark, d).select("draft_id", "edge_case", "route")


@query(with_tables("""
    SELECT email_category, route, count(*) AS drafts, count(*) FILTER (edge_case) AS edge_cases FROM auto GROUP BY 1, 2""",
    "accuracy_log", "draft_log", extra=AUTO))
def autonomy_report(spark: SparkSession, d: str) -> DataFrame:
    return G.autonomy_report(_auto(spark, d))
