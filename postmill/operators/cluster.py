"""Similarity clusters and their canonical entry.

Two entries of a category belong together when a chain of pairs with cosine at or above
the threshold links them. A work unit compares two bounded blocks and returns, for each
row that has a partner, one link to the least id of its part of the unit: a spanning
forest, so the links stay linear even where thousands of near copies meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.vectors import cosine
from ..functions.text import explode_terms, terms, text_or_empty
from ..session import spread_join, written
from . import blocks

BLOCK_ROWS = 2048


def _least_labels(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least label reachable in a two-sided graph, by propagation until nothing changes."""
    top = np.iinfo(np.int64).max
    while True:
        r = np.minimum(right, np.where(near, left[:, None], top).min(axis=0))
        l = np.minimum(left, np.where(near, r[None, :], top).min(axis=1))
        if (l == left).all() and (r == right).all():
            return l, r
        left, right = l, r


# Scores are rounded; near 1 that moves an angle by up to the square root of twice the rounding.
ANGLE_SLACK = 2 * math.sqrt(2 * 10.0**-blocks.DIGITS)


def similarity_links(kb: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(kb_id, linked): links whose connected parts are those of the full similarity graph.

    Equal vectors are linked to the least id among them first, so copies, however many, take
    part once. What is left of a category is cut into cells, of which a category of one block
    has one, and cells too far apart are not compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = kb.select("kb_id", "category", "vector").filter(F.exists("vector", lambda x: x != 0))
    id_type = rows.schema["kb_id"].dataType
    schema = StructType([StructField("kb_id", id_type), StructField("linked", id_type)])
    heads = written(
        rows.groupBy("category", "vector").agg(F.min("kb_id").alias("kb_id"), F.count(F.lit(1)).alias("_copies")), "heads"
    )
    copied = heads.filter(F.col("_copies") > 1).select("category", "vector", F.col("kb_id").alias("linked"))
    heads = heads.drop("_copies")

    def unit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"kb_id": [], "linked": []})
        if left.empty or right.empty:
            return empty
        near = np.round(blocks.cosine_matrix(left, right), blocks.DIGITS) >= threshold
        l_ids, r_ids = left["kb_id"].to_numpy(), right["kb_id"].to_numpy()
        near &= l_ids[:, None] != r_ids[None, :]
        if not near.any():
            return empty
        ids, code = np.unique(np.concatenate([l_ids, r_ids]), return_inverse=True)
        if len(ids) < len(code):
            # Both sides are the same block: one label per id.
            near |= l_ids[:, None] == r_ids[None, :]
        l, r = _least_labels(near, code[: len(l_ids)], code[len(l_ids) :])
        found = pd.DataFrame({"kb_id": np.concatenate([l_ids, r_ids]), "linked": ids[np.concatenate([l, r])]})
        return found[found["kb_id"] != found["linked"]].drop_duplicates()

    celled, units = _cells(heads, threshold, block_rows)
    keys = ["category", "_cell", "_block", "_other", "_other_block"]
    left = celled.join(units, ["category", "_cell", "_block"])
    again = celled.toDF("kb_id", "category", "vector", "_other", "_other_block")
    right = again.join(units.toDF(*units.columns), ["category", "_other", "_other_block"])
    links = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(unit, schema)
    copies = rows.join(written(copied, "copied"), ["category", "vector"]).filter(F.col("kb_id") != F.col("linked"))
    return links.unionByName(copies.select("kb_id", "linked"))


def _cells(heads: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_cell`` and ``_block``, and the pairs of blocks that have to be compared.

    A cell holds the rows nearest to one of some rows of the category, its pivots, whose number
    grows with the square root of the category's blocks. Angles obey the triangle inequality: rows of
    two cells can only reach the threshold if their pivots are no further apart than its
    angle and both cells' radii together. A cell over the block size has several blocks.
    """
    n_pivots = F.ceil(8 * F.sqrt(F.ceil(F.count(F.lit(1)) / block_rows))) - 7
    sizes = written(heads.groupBy("category").agg(n_pivots.cast("int").alias("_pivots")), "sizes")
    by_hash = Window.partitionBy("category").orderBy(F.xxhash64("kb_id"), "kb_id")
    most = sizes.agg(F.max("_pivots")).first()[0] or 1
    pivots = written(
        # the constant bound lets Spark keep only the first ranks on the map side
        heads.withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= most)
        .join(sizes, "category").filter(F.col("_n") <= F.col("_pivots")).drop("_n", "_pivots"), "pivots"
    )
    nearest = blocks.block_top_k(
        heads.withColumnRenamed("kb_id", "query_id"), pivots, blocks.cosine_matrix, 1, left_rows=block_rows, right_rows=block_rows
    )
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score"))))
    placed = written(
        heads.join(nearest.select(F.col("query_id").alias("kb_id"), F.col("kb_id").alias("_cell"), angle.alias("_angle")), "kb_id")
        .select("kb_id", "category", "vector", "_cell", "_angle"), "placed",
    )
    stats = written(
        placed.groupBy("category", "_cell").agg(
            F.max("_angle").alias("_radius"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")
        ).join(pivots.select(F.col("kb_id").alias("_cell"), "vector"), "_cell"), "cells",
    )
    celled = placed.join(stats.select("category", "_cell", "_blocks"), ["category", "_cell"]).select(
        "kb_id", "category", "vector", "_cell", F.pmod(F.xxhash64("kb_id"), F.col("_blocks")).cast("int").alias("_block")
    )
    other = stats.select(
        "category", F.col("_cell").alias("_other"), F.col("_radius").alias("_other_radius"),
        F.col("_blocks").alias("_other_blocks"), F.col("vector").alias("_other_vector"),
    )
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("vector"), F.col("_other_vector")))))
    reach = math.acos(threshold) + F.col("_radius") + F.col("_other_radius") + 3 * ANGLE_SLACK
    units = (
        stats.join(other, "category").filter((F.col("_cell") <= F.col("_other")) & (apart <= reach))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_other_block", F.explode(F.sequence(F.lit(0), F.col("_other_blocks") - 1)))
        .filter((F.col("_cell") < F.col("_other")) | (F.col("_block") <= F.col("_other_block")))
        .select("category", "_cell", "_block", "_other", "_other_block")
    )
    return celled, units


def connected_components(links: DataFrame, a: str = "kb_id", b: str = "linked") -> DataFrame:
    """(node, component) with the least node as component, by alternating large and small stars.

    Each round joins every edge with the least neighbour of its end, an aggregate, so no
    neighbour list is ever collected, and a hub's edges are split over tasks. Rounds grow with the logarithm of the size; each ends
    in a table in the shared folder.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u") != F.col("v")).distinct(), "links",
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(
            spread_join(both, least, "u", "inner").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v")).distinct(), "large",
        )
        joined = spread_join(large, large.groupBy("u").agg(F.min("v").alias("m")), "u", "inner")
        edges = written(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v")).distinct(), "links",
        )
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)


def cluster(kb: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``cluster``: the least id of the entry's connected part; entries alone form their own."""
    parts = connected_components(similarity_links(kb, threshold, block_rows))
    return (
        kb.join(parts.withColumnRenamed("node", "kb_id"), "kb_id", "left")
        .withColumn("cluster", F.coalesce("component", "kb_id")).drop("component")
    )


def term_profile(clustered: DataFrame, text_col: str = "text") -> DataFrame:
    """Per cluster: number of words, entropy in bits of its word distribution, and the dominant word."""
    counts = (
        explode_terms(clustered, ["cluster"], F.col(text_col))
        .groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    # H = log2(N) - sum(n log2 n) / N needs one pass and no join with the totals. The dominant
    # word is the most frequent one, the first in the alphabet among equals.
    total = F.sum("n")
    return counts.groupBy("cluster").agg(
        total.alias("words"),
        F.round(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total, 6).alias("entropy"),
        F.min(F.struct((-F.col("n")).alias("neg"), "term"))["term"].alias("dominant"),
    )


def canonicalise(clustered: DataFrame, text_col: str = "text") -> DataFrame:
    """One entry per cluster: the one using the dominant word most, the least id among equals.

    ``clustered`` is read twice and should be a written table.
    """
    profile = term_profile(clustered, text_col)
    used = F.size(F.filter(terms(text_or_empty(F.col(text_col))), lambda t: t == F.col("dominant")))
    return (
        spread_join(clustered, profile, "cluster", "inner")
        .withColumn("_uses", used)
        .groupBy("cluster")
        .agg(
            F.min(F.struct((-F.col("_uses")).alias("neg"), "kb_id"))["kb_id"].alias("canonical_id"),
            F.count(F.lit(1)).alias("members"),
            F.first("dominant").alias("dominant"), F.first("entropy").alias("entropy"),
        )
    )


def variants(clustered: DataFrame, canonical: DataFrame, question_col: str) -> DataFrame:
    """The other ways to ask, one row per cluster and distinct wording."""
    return (
        clustered.join(canonical.select(F.col("canonical_id").alias("kb_id")), "kb_id", "left_anti")
        .select("cluster", F.col(question_col).alias("variant")).distinct()
    )


def variant_arrays(variant_rows: DataFrame, size: int = 1000) -> DataFrame:
    """Variants as arrays of about ``size``; a cluster with more is spread over several parts."""
    parts = variant_rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    return (
        variant_rows.join(parts, "cluster")
        .withColumn("part", F.pmod(F.xxhash64("variant"), F.col("_parts")).cast("int"))
        .groupBy("cluster", "part")
        .agg(F.sort_array(F.collect_list("variant")).alias("question_variants"))
    )
