"""Knowledge-base files in, reports and retrieval context out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KB_GLOB = "CANONICAL_skill_*.md"


def read_kb(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """(filename, text) of every skill file, whole; ``ordered`` sorts by name, as a page over all files needs it."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=KB_GLOB).select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")
    )
    return files.orderBy("filename") if ordered else files


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.exists(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below ``path``; none if there is no such folder."""
    where, system = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another path, whose parent folder is made if there is none."""
    where, system = _file_system(spark, source)
    there = _file_system(spark, target)[0]
    system.mkdirs(there.getParent())
    system.rename(where, there)


def remove(spark: SparkSession, path: str) -> None:
    where, system = _file_system(spark, path)
    system.delete(where, True)


def write_report(report: DataFrame, path: str, date: str) -> None:
    """The report as a dated copy and as the latest copy; it is a page of lines, so one file each."""
    page = report.orderBy("line_no").select("line").coalesce(1)
    for name in (f"date={date}", "latest"):
        page.write.mode("overwrite").text(f"{path.rstrip('/')}/{name}")


def write_context(context: DataFrame, path: str) -> None:
    """Retrieval context, one JSON row per message."""
    context.write.mode("overwrite").json(path)


def append_kb(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(kb_id, model, vector) in a folder for each embedding model."""
    vectors.write.mode("append").partitionBy("model").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The same; a filter on the model reads its folder only."""
    return spark.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A log as a table bucketed and sorted by ``key``: later joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
