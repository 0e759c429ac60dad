"""Which drafts of proven categories may go out without review."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FAILURES = ("lookup_failed", "kb_unavailable", "low_confidence")


def graduation_config(candidates: DataFrame) -> DataFrame:
    """Candidates of the accuracy report as a switch table, to be stored as the configuration."""
    return candidates.select("email_category", F.lit(True).alias("graduated"))


def route_by_graduation(drafts: DataFrame, config: DataFrame, failures=FAILURES) -> DataFrame:
    """Add ``route`` and ``edge_case``: any failure means review, whatever the category earned."""
    present = [F.coalesce(F.col(c), F.lit(False)) for c in failures if c in drafts.columns]
    failed = F.lit(False)
    for flag in present:
        failed = failed | flag
    switches = config.groupBy("email_category").agg(F.bool_or("graduated").alias("_graduated"))
    return (
        drafts.join(switches, "email_category", "left")
        .withColumn("edge_case", failed)
        .withColumn(
            "route", F.when(F.col("edge_case"), "REVIEW").when(F.col("_graduated"), "AUTO").otherwise("REVIEW")
        )
        .drop("_graduated")
    )


def autonomy_report(routed: DataFrame) -> DataFrame:
    """Drafts per category and route, with the edge cases among them."""
    return routed.groupBy("email_category", "route").agg(
        F.count(F.lit(1)).alias("drafts"), F.count_if("edge_case").alias("edge_cases")
    )
