"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = min(most, exp(lambda * size / mean size of its source)): the rates
closest to one, by relative entropy over documents, whose words reach the source's target, with a
bound on each rate. The multipliers solve the convex dual. Each Newton iteration is a Spark job
over the counts of documents by (source, size), an exact summary of all that the dual depends on;
steps are on the logarithm of the words taken and are held inside a bracket. Rates become whole
copies by rounding the running sum over sizes, so that the error of a source is a few documents,
and what is left is then settled with copies of fitting size. Which documents of a size get one
copy more follows a hash of the id, so reruns agree.

Behaviour: null and empty texts have size 0; they keep one copy and take no words. The null source
is a source like others and comes last. Repeated rows are counted and mixed row by row. A source
whose target is at least ``most`` times its size is taken ``most`` times whole. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import fresh, ranked, table, written
from .registry import query

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
TOLERANCE = 1e-9
ITERATIONS = 40


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, at most ``most`` times a source's size.

    Sources in the order of code points, null last, weigh ``weights`` in turn. Filled up like basins: in the order of
    cap / weight, a source is full if the rate of what is left over reaches its cap. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = (
        sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        .withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    )
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_rate", F.col("_left") / F.col("_weights"))
        .withColumn("_full", F.col("cap") <= F.col("_rate") * F.col("weight"))
        .withColumn("_final", F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("weight"), F.col("_rate")))).over(whole)["_rate"])
    )
    target = F.when(F.col("_full"), F.col("cap")).otherwise(F.least("cap", F.col("_final") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def tilted(rate: str = "lam", most: float = MOST) -> Column:
    return F.when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), F.exp(F.col(rate) * F.col("size") / F.col("mean"))))


def solve(sizes: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """(source, mean, full, lam): the dual solution for every source with words."""
    means = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = written(
        wanted.join(means, wanted["source"].eqNullSafe(means["source"])).drop(means["source"])
        .filter("source_size > 0")
        .select(
            "source", "target", "mean", (F.col("target") >= float(most) * F.col("source_size") * (1 - 1e-12)).alias("full"),
            F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"),
        ),
        "dual",
    )
    for _ in range(ITERATIONS):
        words = F.col("n") * F.col("size") * tilted(most=most)
        moving = F.exp(F.col("lam") * F.col("size") / F.col("mean")) < float(most)
        sums = (
            sizes.join(state.withColumnRenamed("source", "_s"), sizes["source"].eqNullSafe(F.col("_s")))
            .groupBy("_s").agg(F.sum(words).alias("taken"), F.sum(F.when(moving, words * F.col("size") / F.col("mean"))).alias("slope"))
        )
        low, high = F.col("taken") < F.col("target"), F.col("taken") > F.col("target")
        joined = (
            state.join(sums, state["source"].eqNullSafe(sums["_s"])).drop("_s")
            .withColumn("done", F.col("full") | (F.abs(F.col("taken") - F.col("target")) <= TOLERANCE * F.col("target")))
            .withColumn("lo", F.when(low, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(high, F.col("lam")).otherwise(F.col("hi")))
            .withColumn("_newton", F.col("lam") + F.log(F.col("target") / F.col("taken")) * F.col("taken") / F.col("slope"))
        )
        inside = (F.col("_newton") > F.coalesce("lo", F.lit(float("-inf")))) & (F.col("_newton") < F.coalesce("hi", F.lit(float("inf"))))
        held = (
            F.when(F.col("done"), F.col("lam")).when(inside, F.col("_newton"))
            .when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2)
            .when(F.col("lo").isNotNull(), F.col("lo") * 2 + 1).otherwise(F.col("hi") * 2 - 1)
        )
        state = written(joined.select("source", "target", "mean", "full", held.alias("lam"), "lo", "hi", "done"), "dual")
        if state.filter("not done").limit(1).count() == 0:
            break
    return state.select("source", "mean", "full", "lam")


def rounded(sizes: DataFrame, wanted: DataFrame, solution: DataFrame, most: int = MOST, settle: int = 6) -> DataFrame:
    """(source, size, n, copies): whole copies of all documents of a size together."""
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    s = solution.withColumnRenamed("source", "_s")
    rated = sizes.join(s, sizes["source"].eqNullSafe(s["_s"]), "left").drop("_s")
    rated = rated.withColumn("_due", F.col("n") * F.when(F.col("size") == 0, 1.0).otherwise(tilted(most=most)))
    upto = F.floor(F.sum("_due").over(by_size) + 0.5)
    rated = rated.withColumn("_upto", upto)
    copies = F.col("_upto") - F.coalesce(F.lag("_upto").over(by_size), F.lit(0))
    plan = rated.select("source", "size", "n", F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(copies, most * F.col("n"))).cast("long").alias("copies"))
    plan = written(plan, "copies")
    t = wanted.select(F.col("source").alias("_s"), "target")
    for _ in range(settle):
        off = (
            plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("_taken"))
            .join(t, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.round(F.col("target") - F.col("_taken")).cast("long").alias("_off"))
        )
        near = plan.join(off, F.col("source").eqNullSafe(F.col("_s")))
        room = F.when(F.col("_off") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = near.filter((F.col("size") > 0) & (F.col("size") <= F.abs("_off"))).withColumn("_room", room).filter("_room > 0")
        best = fits.groupBy("_s").agg(F.max(F.struct("size", "_room", "_off")).alias("x")).select(
            "_s", F.col("x.size").alias("_size"),
            (F.signum("x._off") * F.least(F.col("x._room"), F.floor(F.abs("x._off") / F.col("x.size")))).cast("long").alias("_more"),
        )
        joined = plan.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
        plan = written(joined.select("source", "size", "n", (F.col("copies") + F.coalesce("_more", F.lit(0))).alias("copies")), "copies")
    return plan


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, also: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``, with the columns ``also``, which break ties of ids."""
    rows = written(docs.select("doc_id", "source", n_words().alias("size"), *also), "sizes")
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    wanted = written(targets(sizes, weights, share, most), "targets")
    plan = rounded(sizes, wanted, solve(sizes, wanted, most), most)
    per = plan.join(wanted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target",
        F.floor(F.col("copies") / F.col("n")).alias("_each"), (F.col("copies") % F.col("n")).alias("_extra"),
    )
    per = written(per, "mix")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    placed = ranked(rows, ["source", "size"], [F.col("doc_id"), *map(F.col, also)], total, "_rank")
    # a size may hold a third of all rows: both sides come straight from a shuffle, so a large key is split
    return placed.join(per, placed["source"].eqNullSafe(per["_source"]) & (placed["size"] == per["_size"])).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_each") + (F.col("_rank") < F.col("_extra")).cast("long")).alias("copies"), *also
    )


@query()
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its copies say; rows that are equal in all columns are one row with the sum of their copies."""
    row, copies, copy = (fresh(docs, name) for name in ("row_key", "n_copies", "copy"))
    whole = [F.struct(F.col(c).isNull(), F.col(c)) for c in docs.columns]
    keyed = docs.withColumn(row, F.struct(F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)))
    mixed = mix_documents(keyed, also=(row,)).groupBy(row).agg(F.sum("copies").cast("int").alias(copies))
    mixed = written(mixed.filter(F.col(copies) > 0), "mixed")
    taken = keyed.dropDuplicates([row]).join(mixed, row)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
