"""Audit of how filters interact: what each order of them removes, from survivors of all their subsets.

A document fails some of the five filters. Its truth table is one 32-bit word: bit s is set if it survives
the subset s of filters, that is, if it fails none of them. Summing these words by bit position gives the
survivors of all 32 subsets at once. The sums are made by carry-save adders: three words become a word
of sums and a word of carries, which counts twice, until hardly any words are left, so each
word costs a few bit operations and not 32 additions. Counts are kept for each part and for all, good and toxic
documents, in every map task, and added up by part. All orders of the filters follow from the 32 counts:
what a step removes is the survivors before it less those after it.

Filters: A under 50 words; B under 65% distinct words; C over 5% capitals; D special characters; E a text
that a smaller doc_id has too, wherever it stands and whether it is removed or not.

Behaviour: a null text is empty; a null part is the empty string; a null doc_id has no label, does not fail E
and makes no other row fail it; rows are counted one by one, repeated ones too (the same id does not fail E);
a document is good or toxic if any of its label rows says so; without documents there are no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread_join
from .common import pieces, table, written
from .registry import query

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
CAPITALS = bytes(range(65, 91))
FOLLOWERS = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that do not begin a character
SPECIAL = re.compile(rb"[#$%&*|]")
KINDS = ("all", "good", "toxic")
FLUSH_ROWS = 1 << 20


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()  # bytes.split parts at space and \t to \r, as the filters define it
    short = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    n_capitals = len(text) - len(text.translate(None, CAPITALS))
    loud = n_capitals > 0 and 100 * n_capitals > MAX_CAPITALS * len(text.translate(None, FOLLOWERS))
    return short | repeated << 1 | loud << 2 | (SPECIAL.search(text) is not None) << 3


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, print, spread): the failures of A to D and a 128-bit print of the text.

    ``spread`` deals rows without an id, which meet no label, over all tasks of a join.
    """

    def run(batches):
        for batch in batches:
            found = [(failures(t), xxhash.xxh3_128_digest(t)) for (t,) in pieces([batch], "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())],
                ["doc_id", "part", "fails", "print"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1)
    return rows.mapInArrow(run, "doc_id long, part string, fails int, print binary").withColumn("spread", spread)


def copied(rows: DataFrame) -> DataFrame:
    """Bit 4 is added to ``fails`` of rows whose text a smaller doc_id has."""
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    joined = spread_join(rows, firsts.filter("first < last").select("print", "first"), "print")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.withColumn("fails", F.col("fails").bitwiseOR(F.when(later, 16).otherwise(0))).drop("first", "print")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """good and toxic are added."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    per_id = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    joined = rows.join(written(per_id.withColumn("spread", F.lit(-1)), "labels"), ["doc_id", "spread"], "left")
    return joined.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def truth_tables(n: int) -> np.ndarray:
    """For every set of failed filters the word whose bit s says whether such a document survives the subset s."""
    return np.array([sum(1 << s for s in range(1 << n) if s & f == 0) for f in range(1 << n)], dtype=np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save adders."""
    counts, weight = np.zeros(32, dtype=np.int64), 1
    while len(words):
        carries = [words[:0]]
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        for word in words.tolist():  # two at most
            counts += weight * ((word >> np.arange(32)) & 1)
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """(part, kind, subset, n): documents of a part that survive a subset of the filters; kind is all, good or toxic."""
    table_of = truth_tables(len(FILTERS))

    def counted(held):
        batch = pa.Table.from_batches(held)
        encoded = batch.column("part").combine_chunks().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        words = table_of[batch.column("fails").to_numpy()]
        flags = [np.ones(len(words), dtype=bool), *[batch.column(k).to_numpy().astype(bool) for k in KINDS[1:]]]
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(encoded.dictionary)))
        parts, kinds, subsets, sums = [], [], [], []
        for code, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            mine = order[start:end]
            for kind, flag in zip(KINDS, flags, strict=True):
                counts = positional_popcount(words[mine[flag[mine]]])
                some = np.flatnonzero(counts)
                parts += [code] * len(some)
                kinds += [kind] * len(some)
                subsets += some.tolist()
                sums += counts[some].tolist()
        return pa.RecordBatch.from_arrays(
            [encoded.dictionary.take(pa.array(parts, pa.int32())), pa.array(kinds, pa.string()), pa.array(subsets, pa.int32()), pa.array(sums, pa.int64())],
            ["part", "kind", "subset", "n"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= FLUSH_ROWS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return rows.mapInArrow(run, "part string, kind string, subset int, n long").groupBy("part", "kind", "subset").agg(F.sum("n").alias("n"))


OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def by_order(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its survivors of all subsets; a row of ``counts`` for each part."""
    n = len(FILTERS)
    orders = list(itertools.permutations(range(n)))
    every = (1 << n) - 1
    names = ["".join(FILTERS[i] for i in order) for order in orders for _ in range(n)]
    steps = np.array([k + 1 for _ in orders for k in range(n)], dtype=np.int32)
    which = np.array(orders).reshape(-1)
    before = np.array([sum(1 << i for i in order[:k]) for order in orders for k in range(n)])
    after = before | (1 << which)

    def run(batches):
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = {k: np.zeros(1 << n, dtype=np.int64) for k in KINDS}
                for cell in found:
                    left[cell["kind"]][cell["subset"]] = cell["n"]
                lost = {k: left[k][before] - left[k][after] for k in KINDS}
                fails = left["all"][0] - left["all"][1 << which]
                alone = left["all"][every ^ (1 << which)] - left["all"][every]
                shapley = np.bincount(which, weights=lost["all"], minlength=n).astype(np.int64)[which]
                columns = [left["all"][after], lost["all"], fails - lost["all"], alone, lost["good"], lost["toxic"], shapley]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(names)), pa.array(names), pa.array(steps), *[pa.array(c, pa.int64()) for c in columns]],
                    [c.split()[0] for c in OUT.split(", ")],
                )

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("kind", "subset", "n")).alias("cells"))  # 96 at most
    return cells.mapInArrow(run, OUT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = copied(written(judged(docs), "judged"))
    return by_order(survivors(labelled(rows, labels)))


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
firsts as (select t, min(doc_id) as first from d group by t),
lab as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [
    len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] as fails
  from d join firsts using (t) left join lab on lab.doc_id = d.doc_id),
sums as (
  select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by part, fails),
orders as (
  select a.x || b.x || c.x || e.x || g.x as filter_order
  from (select unnest(['A', 'B', 'C', 'D', 'E']) as x) a, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) b, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) c,
    (select unnest(['A', 'B', 'C', 'D', 'E']) as x) e, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) g
  where len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps as (
  select filter_order, cast(step as int) as step, substr(filter_order, step, 1) as letter,
    list_transform(range(1, step), lambda i: strpos('ABCDE', substr(filter_order, i, 1))) as earlier, strpos('ABCDE', substr(filter_order, step, 1)) as mine
  from orders, (select unnest(range(1, 6)) as step)),
rows as (
  select part, filter_order, step, letter, n, good, toxic, list_bool_or(list_transform(earlier, lambda i: fails[i])) as gone, fails[mine] as failing,
    len(list_filter(fails, lambda x: x)) = 1 and fails[mine] as alone
  from sums, steps),
o as (
  select part, filter_order, step, letter, coalesce(sum(n) filter (where not coalesce(gone, false) and not failing), 0) as kept,
    coalesce(sum(n) filter (where not coalesce(gone, false) and failing), 0) as removed,
    coalesce(sum(n) filter (where coalesce(gone, false) and failing), 0) as redundant, coalesce(sum(n) filter (where alone), 0) as unique_fails,
    coalesce(sum(good) filter (where not coalesce(gone, false) and failing), 0) as good_lost,
    coalesce(sum(toxic) filter (where not coalesce(gone, false) and failing), 0) as toxic_lost
  from rows group by part, filter_order, step, letter)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from o
"""


@query(OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
