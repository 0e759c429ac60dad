"""JSON-lines staging of drafts, and the append to the draft log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import DRAFT_LOG, STAGED, conform
from ..functions.text import strip


def parse_staging(raw: DataFrame, schema=STAGED) -> tuple[DataFrame, DataFrame]:
    """Split text lines (column ``value``) into records and rejects.

    Blank lines are skipped. Absent keys become null. Lines that are no JSON object, arrays
    and numbers among them, are rejects.
    """
    with_bad = schema.simpleString()[len("struct<"):-1] + ",_bad:string"
    line = strip(F.col("value"))
    parsed = raw.filter(line != "").withColumn(
        "_row",
        F.from_json(line, f"struct<{with_bad}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}),
    )
    good = line.startswith("{") & F.col("_row").isNotNull() & F.col("_row._bad").isNull()
    rows = parsed.filter(good).select(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    rejects = parsed.filter(~good).select("value")
    return rows, rejects


def read_staging(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_staging(spark.read.text(path))


def flush_staging(staged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged rows as draft-log rows, the rejected rows with a reason, and one row of counts.

    ``created_at`` is read as a timestamp; the staged status is ignored, every new row is
    PENDING. Rows without a draft id or a readable time are rejected, the others continue.
    """
    timed = staged.withColumn("_created", F.try_to_timestamp("created_at"))
    reason = F.when(F.col("draft_id").isNull(), "draft_id missing").when(F.col("_created").isNull(), "created_at unreadable")
    judged = timed.withColumn("reason", reason)
    rows = conform(
        judged.filter(F.col("reason").isNull()).withColumn("created_at", F.col("_created"))
        .withColumn("status", F.lit("PENDING")),
        DRAFT_LOG,
    )
    rejects = judged.filter(F.col("reason").isNotNull()).drop("_created")
    stats = judged.agg(
        F.count_if(F.col("reason").isNull()).alias("appended"), F.count_if(F.col("reason").isNotNull()).alias("failed")
    )
    return rows, rejects, stats


def unseen(rows: DataFrame, draft_log: DataFrame) -> DataFrame:
    """Rows whose draft id the log does not hold yet, each id once: a repeated flush adds nothing."""
    return rows.dropDuplicates(["draft_id"]).join(draft_log.select("draft_id"), "draft_id", "left_anti")


def append(df: DataFrame, path: str) -> None:
    """One bulk append."""
    df.write.mode("append").parquet(path)
