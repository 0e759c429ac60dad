"""Scans of the mail and order tables and the choice between redundant sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import ago, moment
from ..functions.tags import AI_PROCESSED


def since_day(messages: DataFrame, as_of, days: int) -> DataFrame:
    """Messages since the start of the day ``days`` before ``as_of``.

    The bound is a constant on the bare column, so it reaches the parquet scan; a table
    partitioned by ``received_date`` is pruned by it as well.
    """
    first = F.date_sub(F.to_date(moment(as_of)), days)
    recent = messages.filter(F.col("received_at") >= first.cast("timestamp"))
    return recent.filter(F.col("received_date") >= first) if "received_date" in messages.columns else recent


def unprocessed(messages: DataFrame) -> Column:
    """Without the processed mark; a stored ``is_processed`` flag can be pushed down, the label array cannot."""
    if "is_processed" in messages.columns:
        return ~F.col("is_processed")
    return ~F.array_contains("labels", AI_PROCESSED)


def inbox_scan(messages: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Messages since the day ``days`` before ``as_of`` that are not processed; read ones included."""
    return since_day(messages, as_of, days).filter(unprocessed(messages))


def sent_scan(messages: DataFrame, as_of, minutes: int = 60, limit: int | None = None) -> DataFrame:
    """Sent mail since the start of the day on which the look-back window begins.

    ``limit`` keeps the newest rows, as a mail listing's page does; there is none by default.
    """
    since = F.date_trunc("day", ago(as_of, minutes=minutes))
    recent = messages.filter(F.col("sent_at") >= since)
    return recent if limit is None else recent.orderBy(F.desc("sent_at"), "message_id").limit(limit)


def header_value(headers: Column, name: str) -> Column:
    """Value of a header by lower-case name; the last of repeated headers counts."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]


def header_map(headers: Column) -> Column:
    """Header array as a map of lower-case names; the last of repeated headers counts."""
    names = F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"])))

    def last(name: Column) -> Column:
        return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]

    return F.map_from_arrays(names, F.transform(names, last))


def json_array_from_text(df: DataFrame, col: str, element: str) -> DataFrame:
    """Rows of the JSON array between the first ``[`` and the last ``]`` of a text.

    ``element`` is the DDL of one record. A text without a readable array yields no rows.
    """
    array = F.from_json(F.regexp_extract(F.col(col), r"(?s)\[.*\]", 0), f"array<struct<{element}>>")
    return df.select(*[c for c in df.columns if c != col], F.explode(array).alias("_r")).select("*", "_r.*").drop("_r")


def is_fresh(cached_at: Column, as_of, ttl_hours: int = 24) -> Column:
    """Strictly younger than the time to live."""
    return cached_at > ago(as_of, hours=ttl_hours)


def resolve_source(
    keys: DataFrame, candidates: DataFrame, as_of, ttl_hours: int = 24, key: str = "filename"
) -> DataFrame:
    """Content per key from the best available source, else source 'UNAVAILABLE'.

    ``candidates`` is (key, source, priority, content, cached_at). Rows with a ``cached_at``
    count only while fresh; null content does not count. The lowest priority wins.
    """
    usable = candidates.filter(
        F.col("content").isNotNull() & (F.col("cached_at").isNull() | is_fresh(F.col("cached_at"), as_of, ttl_hours))
    )
    best = usable.groupBy(key).agg(
        F.min_by(F.struct("source", "content"), F.struct("priority", "source")).alias("_best")
    )
    return (
        keys.select(key).distinct().join(best, key, "left")
        .select(
            key,
            F.coalesce(F.col("_best.source"), F.lit("UNAVAILABLE")).alias("source"),
            F.col("_best.content").alias("content"),
        )
    )


def label_snapshot(snapshots: DataFrame, as_of, ttl_hours: int = 24) -> DataFrame:
    """Label ids of the newest snapshot that is still fresh; none if all are stale.

    ``snapshots`` is (cached_at, label_name, label_id).
    """
    fresh = snapshots.filter(is_fresh(F.col("cached_at"), as_of, ttl_hours))
    newest = Window.partitionBy("label_name").orderBy(F.desc("cached_at"), "label_id")
    latest = fresh.agg(F.max("cached_at")).scalar()
    return (
        fresh.filter(F.col("cached_at") == latest)
        .withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1)
        .select("label_name", "label_id")
    )
