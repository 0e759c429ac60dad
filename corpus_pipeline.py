"""From raw documents to a sharded training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the
shared folder and hands what it reads back to the next. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import table, written
from postmill.llm.decontaminate import decontaminate_stage
from postmill.llm.minhash import dedup_stage
from postmill.llm.mixing import mixing_stage
from postmill.llm.quality import quality_stage
from postmill.llm.sharding import sharding_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned scores, signatures and iterated solutions are not to be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
