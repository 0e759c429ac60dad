"""Balanced label propagation: shards that keep linked documents together and have even sizes.

Linked documents start dealt out evenly. In each round a Spark join brings every linked document
the shards of its group's members, as one count for each shard; the document asks to move to
the shard that holds most of them. Requests for a shard are accepted from the largest gain downwards while
its quota has room, by sums over a bounded table of classes of requests, so no task sees all requests of a
shard. Documents without links then fill every shard exactly up to its quota (law ``rows``:
counts at most one apart). Slots are gapless from 0 in each shard.

A large group, even one of a third of all rows, fills whole shards up to their quota and goes on
in others; its members are never gathered, only counted.

Behaviour: documents of equal text are linked, and so are empty texts; null texts are linked with nothing and
have size 8 and crc 0. Repeated rows are rows of their own with slots of their own. With fewer
rows than shards some shards are empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import ranked, table, written
from .registry import query

SHARDS = 24
ROUNDS = 12
CLASSES, GROUPS, PARTS = 16, 64, 32  # classes of gains, of groups and of documents, in which requests are accepted


def quota(total: int, shards: int, shard: int) -> int:
    return total // shards + (shard < total % shards)


def propagate(links: DataFrame, state: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) for linked rows. ``links`` (row, group) may give a row several groups; ``state`` (row, shard) is the start."""
    for _ in range(rounds):
        held = dict(state.groupBy("shard").agg(F.count("*")).collect())  # a row for each shard
        room = [quota(total, shards, s) - held.get(s, 0) for s in range(shards)]
        votes = written(
            links.join(state, "row").groupBy("group").agg(*[F.count(F.when(F.col("shard") == s, 1)).alias(f"v{s}") for s in range(shards)]),
            "votes",
        )
        seen = (
            links.join(votes, "group").groupBy("row")
            .agg(*[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)], F.min("group").alias("group"))
            .join(state, "row").withColumn("votes", F.array(*[F.col(f"v{s}") for s in range(shards)]))
        )
        # ties go by an order of the shards that is the group's own, so its members agree
        turn = F.pmod(F.xxhash64("group"), F.lit(shards)).cast("int")
        place = lambda s: F.pmod(s + turn, F.lit(shards))
        open_ = F.array(*[F.lit(r > 0) for r in room])
        choice = F.array_max(F.transform(
            F.col("votes"),
            lambda v, s: F.when(F.get(open_, s), F.struct(v.alias("votes"), (-place(s)).alias("order"), s.alias("to"))),
        ))
        asked = seen.select("row", "group", "shard", F.get("votes", F.col("shard")).alias("here"), choice.alias("best")).filter(
            (F.col("best.to") != F.col("shard"))
            & ((F.col("best.votes") > F.col("here")) | ((F.col("best.votes") == F.col("here")) & (place(F.col("best.to")) < place(F.col("shard")))))
        ).select(
            "row", F.col("best.to").alias("to"),
            F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.col("best.votes") - F.col("here") + 1))).cast("int").alias("gain"),
            F.pmod(F.xxhash64("group", F.lit(1)), F.lit(GROUPS)).cast("int").alias("g"),
            F.pmod(F.xxhash64("row", F.lit(2)), F.lit(PARTS)).cast("int").alias("p"),
        )
        asked = written(asked, "requests")
        upto = Window.partitionBy("to").orderBy(F.col("gain").desc(), "g", "p")
        free = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("to") + 1)
        granted = (
            asked.groupBy("to", "gain", "g", "p").agg(F.count("*").alias("n"))  # at most CLASSES * GROUPS * PARTS rows for a shard
            .withColumn("sum", F.sum("n").over(upto)).filter(F.col("sum") <= free).select("to", "gain", "g", "p")
        )
        moved = written(asked.join(written(granted, "granted"), ["to", "gain", "g", "p"], "left_semi").select("row", "to"), "moves")
        if moved.limit(1).count() == 0:
            break
        state = written(state.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "shards")
    return state


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.sha2(F.col("text"), 256)).alias("group"),
    ), "sizes")
    several = rows.filter("group is not null").groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    several = written(several, "groups")
    links = written(rows.join(several, "group").select("row", "group"), "links")
    total, linked = rows.count(), links.count()
    dealt = ranked(links.select("row"), [], [F.col("row")], linked, "at")
    start = written(dealt.select("row", (F.col("at") % shards).cast("int").alias("shard")), "shards")
    state = propagate(links, start, total, shards)

    held = dict(state.groupBy("shard").agg(F.count("*")).collect())  # a row for each shard
    held = [held.get(s, 0) for s in range(shards)]
    gaps = [quota(total, shards, s) - held[s] for s in range(shards)]
    begins = [sum(gaps[:s]) for s in range(shards)]
    joined = ranked(rows.join(state, "row"), ["shard"], [F.col("row")], linked, "slot")
    alone = ranked(rows.join(state, "row", "left_anti"), [], [F.col("row")], total - linked, "at")
    ends = F.array(*[F.lit(b + g) for b, g in zip(begins, gaps, strict=True)])
    alone = alone.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("at")))).withColumn(
        "slot", F.col("at") + F.element_at(F.array(*[F.lit(h - b) for h, b in zip(held, begins, strict=True)]), F.col("shard") + 1)
    )
    columns = ["doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")]
    return joined.select(*columns).unionByName(alone.select(*columns))


def laid_out(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(table(spark, sf_dir, "documents"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; repeated rows share a shard as far as quotas allow."""
    return laid_out(docs)
