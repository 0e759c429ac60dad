"""The draft log on files, with an index of its ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .files import exists, folders, remove

#: Ids of an index bucket, on average at most.
BUCKET_IDS = 500_000
#: Buckets double so often at a time.
GROWTH = 3


class DraftLog:
    """A log partitioned by day of creation, in which each draft id stands once.

    The index lies beside the log, in 2 ** depth folders by hash of the id. An append reads the folders of its own ids only.
    When these hold more than ``bucket_ids`` each, the index is dealt anew into more folders, whose size
    thus stays the same however long the log grows; as it grows by factors, an id is dealt a few times in all.

    Rows are set down as pending before log and index are touched. Where an append was cut short, the next one
    finds them there and finishes it: rows that the log lacks are added, then ids that the index lacks.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_ids: int = BUCKET_IDS):
        self.spark, self.path, self.bucket_ids = spark, path.rstrip("/"), bucket_ids
        self.index, self.pending = f"{self.path}_ids", f"{self.path}_pending"

    # ---- index

    def depth(self) -> int | None:
        """That of the newest complete index."""
        names = [n for n in folders(self.spark, self.index) if n.startswith("depth=")]
        whole = [int(n.removeprefix("depth=")) for n in names if exists(self.spark, f"{self.index}/{n}/_SUCCESS")]
        return max(whole, default=None)

    @staticmethod
    def bucket(depth: int) -> Column:
        return F.pmod(F.xxhash64("draft_id"), F.lit(1 << depth)).cast("int")

    def _deal(self, ids: DataFrame, depth: int, mode: str) -> None:
        placed = ids.select("draft_id", self.bucket(depth).alias("bucket"))
        n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed.repartition(n_parts, "bucket").write.mode(mode).partitionBy("bucket").parquet(f"{self.index}/depth={depth}")

    def _read(self, depth: int) -> DataFrame:
        return self.spark.read.schema("draft_id string, bucket int").parquet(f"{self.index}/depth={depth}")

    def known(self, ids: DataFrame, depth: int) -> tuple[DataFrame, list[int]]:
        """The index rows in the buckets of ``ids``, and these buckets; a bucket's number is all that reaches the driver."""
        touched = [r[0] for r in ids.select(self.bucket(depth)).distinct().collect()]
        return self._read(depth).filter(F.col("bucket").isin(touched)), touched

    def _grow(self, depth: int, touched: list[int], rows: int) -> None:
        if touched and rows > self.bucket_ids * len(touched):
            self._deal(self._read(depth), depth + GROWTH, "overwrite")
            remove(self.spark, f"{self.index}/depth={depth}")

    # ---- log

    def rows(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        """Append the rows whose id the log does not hold yet, each id once."""
        schema = rows.withColumn("created_day", F.to_date("created_at")).schema
        self._finish(schema)
        if self.depth() is None:
            old = self.rows(schema) if exists(self.spark, self.path) else rows.limit(0)
            self._deal(old, 0, "overwrite")
        depth = self.depth()
        fresh = rows.dropDuplicates(["draft_id"]).withColumn("created_day", F.to_date("created_at"))
        known, touched = self.known(fresh, depth)
        fresh.join(known.select("draft_id"), "draft_id", "left_anti").select(*schema.names).write.mode("overwrite").parquet(self.pending)
        self._finish(schema, resumed=False)
        self._grow(depth, touched, self._read(depth).filter(F.col("bucket").isin(touched)).count())

    def _finish(self, schema, resumed: bool = True) -> None:
        """Bring the pending rows into log and index; ``resumed`` if some of them may be there already."""
        if not exists(self.spark, f"{self.pending}/_SUCCESS"):
            return
        pending = self.spark.read.schema(schema).parquet(self.pending)
        rows, ids = pending, pending.select("draft_id")
        if resumed and exists(self.spark, self.path):
            days = [r[0] for r in pending.select("created_day").distinct().collect()]
            there = self.rows(schema).filter(F.col("created_day").isin(days)).select("draft_id")
            rows = pending.join(there, "draft_id", "left_anti").select(*schema.names)
        rows.write.mode("append").partitionBy("created_day").parquet(self.path)
        depth = self.depth()
        if resumed:
            ids = ids.join(self.known(ids, depth)[0].select("draft_id"), "draft_id", "left_anti")
        self._deal(ids, depth, "append")
        remove(self.spark, self.pending)
