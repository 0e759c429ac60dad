"""Importance resampling of documents towards a target set, on hashed n-grams.

A batch of texts is taken apart by Arrow kernels: ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode`` give the words as indices into the batch's dictionary. Longer
n-grams come from the indices, shifted by one: each distinct pair of a shorter n-gram and its next
word gets a number of its own, and its CRC goes on from the CRC of the shorter one, so every distinct
feature is hashed once a batch. Features fall into ``buckets`` by their CRC.

All documents and all target texts are counted by bucket, in the map tasks first. The gains of the
buckets, a table of fixed length, go to the second pass, in which each document takes the
gains of its features and adds them up by segments. Gumbel noise from a hash of the id makes the
highest scores a draw without replacement, the same in every run.

The ranks need no task that sorts everything: scores are dealt out by ranges, placed within their
range and moved by the sizes of the ranges before.

Behaviour: null and empty texts have no features and the weight 0; a null doc_id counts as the
empty text in the hash and comes last among ties; rows with the same id are drawn row by row, in any
order; an empty table or target gives gains by the counts of the other alone. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import table, written
from .registry import query

#: Words lie between these: all of ASCII but digits and letters, of which A-Z are lower-cased before.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
SLICE_BYTES = 4 << 20  # text that is taken apart at a time, beyond a single row
RANGE_ROWS = 2_000_000


def slices(texts: pa.Array) -> list[pa.Array]:
    """The texts in runs of bounded size, each copied: ``ascii_lower`` garbles slices that were cast and hold no null."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.take(pa.array(np.arange(a, b))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def features(texts: pa.Array, length: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for n-grams of 1, 2, ... words the bucket and the text of each, in order of texts."""
    rows = len(texts)
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), BREAK)
    encoded = pc.list_flatten(lists).dictionary_encode()
    indices = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    owner = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = np.fromiter((len(w) > 0 for w in words), dtype=bool, count=len(words))[indices]
    indices, owner = indices[filled], owner[filled]
    crcs = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
    found = [(crcs.take(indices) % buckets, owner)]
    runs, run_crcs = indices, crcs
    for k in range(2, length + 1):
        whole = owner[: len(owner) - k + 1] == owner[k - 1 :] if len(owner) >= k else np.zeros(0, dtype=bool)
        pairs = runs[: len(whole)] * len(words) + indices[k - 1 :][: len(whole)]
        distinct, runs = np.unique(pairs, return_inverse=True)
        run_crcs = np.fromiter(
            (zlib.crc32(b" " + words[p % len(words)], int(run_crcs[p // len(words)])) for p in distinct.tolist()),
            dtype=np.int64, count=len(distinct),
        )
        found.append((run_crcs.take(runs[whole]) % buckets, owner[: len(whole)][whole]))
    return np.bincount(owner, minlength=rows), found


def bucket_counts(df: DataFrame, length: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for bucket, _ in features(texts, length, buckets)[1]:
                    counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["bucket", "n"])

    counted = df.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.collect():  # one row for each bucket at most
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed target share to the smoothed share in all documents."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + buckets)) / ((raw + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, length: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for texts in slices(batch.column(1)):
                count, found = features(texts, length, buckets)
                total, sums = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
                for bucket, owner in found:
                    if len(owner) == 0:
                        continue
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    sums[owner[starts]] += np.add.reduceat(gain.take(bucket), starts)
                    total += np.bincount(owner, minlength=len(texts))
                n_words.append(count)
                n_features.append(total)
                weight.append(sums)
            if weight:
                arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n_words, n_features, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def placed(df: DataFrame, order: list[Column], rows: int, name: str) -> DataFrame:
    """``df`` with its gapless place from 1 in ``order``, whose columns must tell all rows apart."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    at = F.monotonically_increasing_id()
    ranges = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    ranges = ranges.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(sizes, "_part").withColumn(name, place).drop("_at", "_part", "_before")


def resampled(
    docs: DataFrame, target: DataFrame, length: int = 2, buckets: int = BUCKETS, seed: int = SEED,
    percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn."""
    gain = gains(bucket_counts(docs, length, buckets), bucket_counts(target, length, buckets))
    scored = weighted(docs, gain, length).withColumn("score", F.col("weight") + noise(seed))
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    large = F.col("n_words") >= min_words
    eligible = scored.filter(large)
    rows = eligible.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ranked = placed(eligible, order, rows, "rank")
    drawn = F.when(F.col("rank") <= percent * rows // 100, F.col("rank"))
    rest = scored.filter(~large).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).unionByName(rest).drop("_row")


OP13_SQL = r"""
with crc_table as (  -- the 256 remainders of the reflected polynomial 0xEDB88320
  select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by n) as t
  from (select unnest(range(256)) as n)),
texts as (
  select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
words as (
  select kind, id, row_number() over () as r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
flat as (select kind, id, r, unnest(w) as word from words),
hashed as (
  select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct word from flat), crc_table),
counts as (
  select bucket, count(*) filter (where kind = 0) as s, count(*) filter (where kind = 1) as t from flat join hashed using (word) group by bucket),
totals as (select coalesce(sum(s), 0)::double as s_all, coalesce(sum(t), 0)::double as t_all from counts),
gain as (
  select bucket, floor(1000 * ln(((t + 1)::double * (s_all + 10000)) / ((s + 1)::double * (t_all + 10000))))::bigint as g from counts, totals),
weights as (select r, sum(g) as weight from flat join hashed using (word) join gain using (bucket) where kind = 0 group by r),
scored as (
  select id as doc_id, r, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296))))::bigint as score
  from words left join weights using (r) where kind = 0),
ranked as (
  select r, row_number() over (order by score desc, doc_id nulls last, r) as rank, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from scored left join ranked using (r)
"""


@query(OP13_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, items, length=1).select("doc_id", "n_features", "weight", "score", "rank")
