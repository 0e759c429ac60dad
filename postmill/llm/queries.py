"""All queries of this folder and their check queries."""

from __future__ import annotations

import corpus_pipeline

from . import (  # noqa: F401
    chat, decontaminate, minhash, mixing, passages, pitman_yor, quality, regions, resampling, rules, sharding, survival, tokenfile,
)
from .registry import QUERIES, SQL


def load() -> tuple[dict, dict]:
    sql = dict(SQL)
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**QUERIES, "pipeline": corpus_pipeline.run}, sql
