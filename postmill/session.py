"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "postmill", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where nothing is set, as in
    tests on one machine, a fresh temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="postmill-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (to ``path`` there, if given) and read back: short lineage, known size, no recomputation."""
    path = work_path(df.sparkSession, name) if path is None else path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``written``; the shuffle files of ``df``, which nothing reads again, are deleted at once.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name, path)
    finally:
        if was is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, was)


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``per_key``, which has one row for each key, where one key may hold most rows.

    The small side is written first. Both sides then come straight from a scan, so that it is broadcast if its
    true size allows, and otherwise adaptive execution can split a large key; above an aggregate it could not.
    """
    return rows.join(written(per_key, "per-key"), key, how)
