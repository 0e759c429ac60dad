"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets counts (words, symbols, repeated lines, words in repeated runs, ...) and from
them shares in whole steps. For every language and source a quantile sketch of each share is kept: a
histogram over the steps, with a bounded number of buckets, which merges by adding counts, first in
the map tasks, then over sources to languages and to the whole. A document is an outlier if a share
lies beyond ``FENCE`` times the spread between the quartiles of its own language and source; groups of under
``LEAST_ROWS`` documents use their language's merged sketch, or that of all. The thresholds are
joined back to the documents.

The fixed rules of the base (too few words, too much repetition) hold besides.

Behaviour: null and empty texts have no words and fail the base rules; a null language or source is a
group like others; repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import table, written
from .registry import query

BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shares in whole steps and the least spread that is assumed for each; a share beyond TOP steps counts as TOP.
TOP = 2000
SPREAD = {"symbols": 20, "capitals": 40, "dup_lines": 150, "repeats": 150, "word_length": 8}
BOTH_SIDES = ("word_length",)
FENCE = 3
LEAST_ROWS = 100


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, n_lines, n_capitals)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate("_t", chars, ""))
    base = docs.select("doc_id", "lang", "source", text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    one = base.select(
        "doc_id", "lang", "source", without(BLANKS).alias("word_chars"), F.length("_t").alias("_chars"),
        without(SYMBOLS).alias("_no_symbols"), without(CAPITALS).alias("_no_capitals"),
        # behind a generator, so that each array is made once
        F.inline(F.array(F.struct(F.array_remove(F.split("_t", BLANK + "+"), "").alias("_w"), lines.alias("_lines")))),
    )
    triple = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    runs = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: triple(i))).otherwise(F.array().cast("array<bigint>"))
    two = one.select("*", F.inline(F.array(F.struct(runs.alias("_runs")))))
    placed = F.when(
        F.size(F.array_distinct("_runs")) < F.size("_runs"),
        F.sort_array(F.transform("_runs", lambda x, i: F.struct(x.alias("h"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<h: bigint, at: int>>"))
    three = two.select("*", F.inline(F.array(F.struct(placed.alias("_s")))))
    same = lambda x, i: F.get(F.col("_s"), i)["h"] == x["h"]
    again = F.filter("_s", lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | F.coalesce(same(x, i - 1), F.lit(False)))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["at"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
    )["n"]
    long = lambda c: c.cast("long")
    return three.select(
        "doc_id", "lang", "source", long(F.size("_w")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"),
        long(F.col("_chars") - F.col("_no_symbols")).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"), long(F.size("_lines")).alias("n_lines"),
        long(F.col("_chars") - F.col("_no_capitals")).alias("n_capitals"),
    )


def shares() -> dict[str, Column]:
    part = lambda n, of: F.least(F.lit(TOP), F.floor(F.col(n) * 1000 / F.greatest(F.col(of), F.lit(1)))).cast("int")
    return {
        "symbols": part("n_symbols", "word_chars"), "capitals": part("n_capitals", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "word_length": F.least(F.lit(TOP), F.floor(F.col("word_chars") * 10 / F.greatest(F.col("n_words"), F.lit(1)))).cast("int"),
    }


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, step, n): at most TOP + 1 rows for a group and metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("step")) for m, c in shares().items()])
    return counted.filter("n_words > 0").select("lang", "source", F.inline(pairs)).groupBy("lang", "source", "metric", "step").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, low, high) from the sketch of the group, or of its language, or of all."""
    null = F.lit(None).cast("string")
    levels = [
        sketch.select(F.lit(0).alias("level"), "lang", "source", "metric", "step", "n"),
        sketch.groupBy("lang", "metric", "step").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", null.alias("source"), "metric", "step", "n"),
        sketch.groupBy("metric", "step").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"), "metric", "step", "n"),
    ]
    stacked = levels[0].unionByName(levels[1]).unionByName(levels[2])
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = stacked.withColumn("upto", F.sum("n").over(group.orderBy("step"))).withColumn("total", F.sum("n").over(group))
    quantile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("step")))
    fences = ranked.groupBy("level", "lang", "source", "metric").agg(quantile(1).alias("q1"), quantile(3).alias("q3"), F.max("total").alias("rows"))
    least = F.create_map(*[F.lit(x) for m in SPREAD.items() for x in m])
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")])
    fences = fences.withColumn("high", F.col("q3") + spread).withColumn("low", F.when(F.col("metric").isin(*BOTH_SIDES), F.col("q1") - spread).otherwise(-1))
    fences = written(fences, "fences")
    own, lang, whole = [
        fences.filter(F.col("level") == k).select(*[F.col(c).alias(f"{c}_{k}") for c in ("lang", "source", "metric", "rows", "low", "high")]) for k in range(3)
    ]
    joined = own.join(lang, F.col("lang_0").eqNullSafe(F.col("lang_1")) & (F.col("metric_0") == F.col("metric_1"))).join(whole, F.col("metric_0") == F.col("metric_2"))
    pick = lambda c: F.when(F.col("rows_0") >= LEAST_ROWS, F.col(f"{c}_0")).when(F.col("rows_1") >= LEAST_ROWS, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    return joined.select(F.col("lang_0").alias("lang"), F.col("source_0").alias("source"), F.col("metric_0").alias("metric"), pick("low").alias("low"), pick("high").alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """The counts of each document, base_failed, outlier and kept."""
    counted = written(measured(docs), "counts")
    limits = thresholds(written(sketches(counted), "sketches")).groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}") for m in SPREAD for side in ("low", "high")]
    )
    limits = written(limits.withColumnsRenamed({"lang": "_lang", "source": "_source"}), "limits")
    joined = counted.join(limits, counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")
    outlier = F.lit(False)
    for m, share in shares().items():
        outlier = outlier | F.coalesce((share > F.col(f"{m}_high")) | (share < F.col(f"{m}_low")), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("outlier", outlier).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


OP4_SQL = r"""
with d as (
  select doc_id, lang, source, coalesce(text, '') as t, row_number() over () as r,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (
  select r, i, count(*) over (partition by r, a) as n
  from (select r, i, array_to_string(w[i:i + 2], ' ') as a from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3))),
rep as (select r, count(distinct i + k) as n_repeat_words from g, (select unnest([0, 1, 2]) as k) where n > 1 group by r),
c as (
  select doc_id, lang, source, r, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, len(l) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals
  from d left join rep using (r)),
s as (
  select r, lang, source, n_words, unnest([
    {'metric': 'symbols', 'spread': 20, 'step': least(TOP, n_symbols * 1000 // greatest(word_chars, 1))},
    {'metric': 'capitals', 'spread': 40, 'step': least(TOP, n_capitals * 1000 // greatest(word_chars, 1))},
    {'metric': 'dup_lines', 'spread': 150, 'step': least(TOP, n_dup_lines * 1000 // greatest(n_lines, 1))},
    {'metric': 'repeats', 'spread': 150, 'step': least(TOP, n_repeat_words * 1000 // greatest(n_words, 1))},
    {'metric': 'word_length', 'spread': 8, 'step': least(TOP, word_chars * 10 // greatest(n_words, 1))}], recursive := true) from c),
q as (
  select lang, source, metric, spread, grouping(lang) as no_lang, grouping(source) as no_source, count(*) as n,
    quantile_disc(step, 0.25) as q1, quantile_disc(step, 0.75) as q3
  from s where n_words > 0 group by grouping sets ((lang, source, metric, spread), (lang, metric, spread), (metric, spread))),
f as (
  select *, q3 + 3 * greatest(q3 - q1, spread) as high, case when metric = 'word_length' then q1 - 3 * greatest(q3 - q1, spread) else -1 end as low from q),
o as (
  select s.r, bool_or(s.step > coalesce(f0.high, f1.high, f2.high) or s.step < coalesce(f0.low, f1.low, f2.low)) as outlier
  from s
  left join f f0 on f0.no_lang = 0 and f0.no_source = 0 and f0.n >= 100 and f0.metric = s.metric and f0.lang is not distinct from s.lang and f0.source is not distinct from s.source
  left join f f1 on f1.no_lang = 0 and f1.no_source = 1 and f1.n >= 100 and f1.metric = s.metric and f1.lang is not distinct from s.lang
  left join f f2 on f2.no_lang = 1 and f2.no_source = 1 and f2.metric = s.metric
  group by s.r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(outlier, false) as kept
from c left join o using (r)
""".replace("TOP", str(TOP))


@query(OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
