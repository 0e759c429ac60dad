"""What the operators of this folder share: table access, word splitting, hashing, ranks and components."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import CLEANUP, work_path, written_once as written

U64 = np.uint64
#: Odd multipliers for hashing sequences of words; any fixed odd numbers would do.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)
#: Rows one task ranks at a time.
RANK_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a working table that this run has made and read for the last time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class WorkTables:
    """Working tables of one run, each deleted when it is read for the last time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        table = written(df, name, path)
        self.made.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self.made if any(t is x for x in tables)]:
            remove(self.spark, path)
        self.made = [(t, p) for t, p in self.made if not any(t is x for x in tables)]


def trim() -> None:
    """Give memory that this worker has freed back to the system; workers live on after a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def remainder(doc_id: str = "doc_id", by: int = 5) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def pieces(batches, *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches; texts come as UTF-8 bytes without a detour over str, null as b""."""
    for batch in batches:
        yield from rows_of(batch, *columns)


def rows_of(batch, *columns: str) -> Iterator[tuple]:
    import pyarrow as pa

    found = []
    for name in columns:
        column = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            found.append([b"" if x is None else x for x in column.to_pylist()])
        else:
            found.append(column.to_pylist())
    return zip(*found, strict=True)


class WordHashes(dict):
    """64-bit hash of a word, kept for words met before; emptied when it has grown to ``most`` words."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; a shorter, not empty text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=U64)
    for k in range(width):
        out = mix(out * ODD[k % 5] + hashes[k : n - width + 1 + k])
    return out


def buckets_for(n: int, rows: int = RANK_ROWS) -> int:
    return max(1, -(-n // rows))


def ranked(df: DataFrame, keys: list[str], order: list[Column], n_rows: int, name: str = "rank") -> DataFrame:
    """Gapless rank from 0 within ``keys``, in an order by hash bucket and then ``order``.

    No task sorts a whole key: rows are dealt into buckets by the hash of ``order``, ranked
    inside them, and the buckets' counts are added up.
    """
    k = buckets_for(n_rows)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(k)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    same = functools.reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)],
        F.col("_bucket") == F.col("_b"),
    )
    return (
        inside.join(offsets, same, "left").withColumn(name, F.col("_in") + F.col("_before"))
        .drop("_bucket", "_in", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), by minima and pointer jumps.

    Every round is a written table; a hub's edges are never gathered, only their minimum is taken.
    ``start`` gives components known before, which ``edges`` may join further; its nodes stay.
    """
    ab = edges.select("a", "b")
    if start is not None:  # contract what is known: edges between components
        known = start.withColumnRenamed("component", "c")
        ab = (
            ab.join(known.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left")
            .join(known.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
    ab = ab.filter("a != b")
    links = written(ab.union(ab.select("b", "a")).distinct(), "links")
    if start is not None and links.limit(1).count() == 0:
        return start
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        offered = (
            links.join(labels.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node")).agg(F.min("component").alias("offer"))
        )
        lower = labels.join(offered, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = written(lower.join(jump, "component").select("node", "was", F.least("component", "next").alias("component")), "labels")
        labels = after.select("node", "component")
        if after.filter("was != component").limit(1).count() == 0:
            break
    if start is None:
        return labels
    root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
    known = start.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    fresh = labels.join(start.select("node"), "node", "left_anti")
    return written(known.unionByName(fresh), "components")


__all__ = [
    "CLEANUP", "ODD", "U64", "WordHashes", "WorkTables", "buckets_for", "components", "fresh", "mix", "pieces", "ranked", "remainder", "remove", "rows_of",
    "shingles", "table", "trim", "work_path", "written",
]
