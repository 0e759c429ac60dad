"""Benchmark decontamination over a positional inverted index.

The training documents are indexed once, in blocks: for each term (by a 64-bit hash) the block's
list of positions, stored as a table. Positions run through the whole block, with the documents'
lengths beside them, so lists of one block can be intersected on their own and a frequent term is
spread over all blocks. A window of a test item is looked up from its rarest term (by its count over all
documents): the term's list, less the term's offset, gives the possible starts, and the other
terms' lists, rarest first, are intersected with them. What is left are exact occurrences.
``slop`` also reports proximity matches: places where the window's three rarest terms stand
within so many words of where they should.

Test items are taken in blocks of ``ITEMS_PER_PASS`` items, so their dictionary on each executor
is bounded however many items there are; every block of items meets every block of documents in the
stored index, and the hits of a document are united over the passes.

Behaviour: null and empty texts have no words and are not contaminated; an item without words
has no window; items of equal text each count; repeated rows are judged row by row; a null
item_id is never named, though its windows count as hits. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import U64, fresh, rows_of, table, written
from .registry import query

WINDOW = 13
#: Words are runs of letters and digits of ASCII, after A-Z were lower-cased, and of all characters beyond ASCII.
BREAKS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
BLOCK_WORDS = 2_000_000
ITEMS_PER_PASS = 20_000
ITEM_WORDS = 2_000_000  # words of the items of one pass at most, beyond a single item


def words_of(text: bytes) -> list[bytes]:
    return text.translate(BREAKS).split()


class Items:
    """Windows of some test items, as numbers in a dictionary of their terms."""

    def __init__(self, items: list[tuple]):
        terms: dict[int, int] = {}
        self.windows: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            at = [terms.setdefault(xxhash.xxh64_intdigest(w), len(terms)) for w in words_of(text)]
            for i in range(max(1, len(at) - WINDOW + 1) if at else 0):
                self.windows.setdefault(tuple(at[i : i + WINDOW]), set()).add(item_id)
        self.hashes = np.fromiter(terms, dtype=U64, count=len(terms))


def passes(benchmark: DataFrame):
    """The items in blocks of bounded size."""
    block, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        data = (text or "").encode()
        n = len(words_of(data))
        if block and (len(block) >= ITEMS_PER_PASS or size + n > ITEM_WORDS):
            yield Items(block)
            block, size = [], 0
        block.append((item_id, data))
        size += n
    yield Items(block)


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


INDEX = "block long, doc_ids array<long>, lengths binary, terms binary, counts binary, postings binary"


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def index(docs: DataFrame) -> DataFrame:
    """A row for each block: its documents, their lengths, and all terms' position lists, one after another."""

    def flush(block, ids, lengths, found, terms):
        tokens = np.concatenate(found)
        places = np.argsort(tokens, kind="stable").astype(np.int32)
        counts = np.bincount(tokens, minlength=len(terms)).astype(np.int32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, terms), dtype=U64, count=len(terms))
        parts = [pack(np.array(lengths, np.int64)), pack(hashes), pack(counts), pack(np.diff(places, prepend=np.int32(0)).astype(np.int32))]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in parts]],
            ["block", "doc_ids", "lengths", "terms", "counts", "postings"],
        )

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, lengths, found, terms, size = [], [], [], Numbers(), 0
        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                words = words_of(text)
                if ids and size + len(words) > BLOCK_WORDS:
                    yield flush(block, ids, lengths, found, terms)
                    block += 1
                    ids, lengths, found, terms, size = [], [], [], Numbers(), 0
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(np.fromiter(map(terms.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(words)
        if ids:
            yield flush(block, ids, lengths, found, terms)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def term_counts(indexed: DataFrame, items: Items) -> dict[int, int]:
    """How often each term of the items occurs in all documents: at most one row for each term of the pass."""
    order = np.argsort(items.hashes)
    known = items.hashes[order]

    def run(batches):
        for batch in batches:
            for terms, counts in zip(*(batch.column(c) for c in ("terms", "counts")), strict=True):
                hashes, n = unpack(terms.as_py(), U64), unpack(counts.as_py(), np.int32)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                same = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                yield pa.RecordBatch.from_arrays([pa.array(order[at[same]], pa.int64()), pa.array(n[same].astype(np.int64), pa.int64())], ["term", "n"])

    counted = indexed.select("terms", "counts").mapInArrow(run, "term long, n long")
    return {t: n for t, n in counted.groupBy("term").agg(F.sum("n")).collect()}


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of sorted ``a`` that are in sorted ``b``."""
    if not len(a) or not len(b):
        return a[:0]
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return a[b[at] == a]


def near(a: np.ndarray, b: np.ndarray, slop: int) -> np.ndarray:
    """Members of sorted ``a`` that have a member of sorted ``b`` within ``slop``."""
    return a[np.searchsorted(b, a + slop, "right") > np.searchsorted(b, a - slop, "left")]


def matches(indexed: DataFrame, items: Items, slop: int = 0) -> DataFrame:
    """For every indexed document (block, row, doc_id, n_words, spans, item_ids, n_near); spans are [start, end) in words."""
    counts = term_counts(indexed, items)
    plans = []  # windows all of whose terms occur somewhere: their terms' places, rarest first, and their items
    for terms, ids in items.windows.items():
        if all(counts.get(t) for t in terms):
            order = sorted(range(len(terms)), key=lambda k: (counts[terms[k]], k))
            plans.append((terms, order, sorted(x for x in ids if x is not None)))
    known = {int(h): t for t, h in enumerate(items.hashes)}

    def block_matches(row):
        lengths = unpack(row["lengths"], np.int64)
        ends = np.cumsum(lengths)
        places = np.cumsum(unpack(row["postings"], np.int32), dtype=np.int32)
        sizes = unpack(row["counts"], np.int32).astype(np.int64)
        stops = np.cumsum(sizes)
        lists = {}
        for k, h in enumerate(unpack(row["terms"], U64).tolist()):
            if h in known:
                lists[known[h]] = places[stops[k] - sizes[k] : stops[k]]
        n = len(lengths)
        found: list[tuple[int, int]] = []
        named: dict[int, set] = {}
        close = np.zeros(n, dtype=np.int64)
        for terms, order, ids in plans:
            if any(terms[k] not in lists for k in order[:3]):
                continue
            starts = lists[terms[order[0]]] - order[0]
            if slop:
                where = starts
                for k in order[1:3]:
                    where = near(where, lists[terms[k]] - k, slop)
                where = where[(where >= 0) & (where < ends[-1])]
                np.add.at(close, np.searchsorted(ends, where, "right"), 1)
            for k in order[1:]:
                starts = meet(starts, lists[terms[k]] - k) if terms[k] in lists else starts[:0]
            starts = starts[starts >= 0]
            doc = np.searchsorted(ends, starts, "right")
            for start, d in zip(starts.tolist(), doc.tolist(), strict=True):
                if start + len(terms) <= ends[d]:  # a window does not run into the next document
                    found.append((start, start + len(terms)))
                    named.setdefault(d, set()).update(ids)
        spans: list[list] = [[] for _ in range(n)]
        for start, end in sorted(found):
            d = int(np.searchsorted(ends, start, "right"))
            base = int(ends[d] - lengths[d])
            if spans[d] and start - base <= spans[d][-1]["end"]:
                spans[d][-1]["end"] = max(spans[d][-1]["end"], end - base)
            else:
                spans[d].append({"start": start - base, "end": end - base})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(spans, kind),
                pa.array([sorted(named.get(d, ())) for d in range(n)], pa.list_(pa.int64())), pa.array(close, pa.int64()),
            ],
            ["block", "row", "doc_id", "n_words", "spans", "item_ids", "n_near"],
        )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield block_matches(batch.slice(i, 1).to_pylist()[0])

    return indexed.mapInArrow(
        run,
        "block long, row int, doc_id long, n_words long, spans array<struct<start: long, end: long>>, item_ids array<long>, n_near long",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, n_near, contaminated) for every row of ``docs``.

    ``n_hit`` counts the document's words inside any occurrence of a window, ``item_ids`` are the items with
    occurring windows, ``n_near`` the proximity matches. At least 5% of words hit is contamination.
    """
    indexed = written(index(docs), "postings")
    found = None
    for items in passes(benchmark):
        part = matches(indexed, items, slop)
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.sum("n_near").alias("n_near"),
    )
    hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("at")),
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["at"]))).alias("hit"),
            F.greatest(a["at"], x["end"]).alias("at"),
        ),
    )["hit"]
    return united.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", "n_near").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


OP8_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, len(w[i:i + 12]) as n, array_to_string(w[i:i + 12], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), lens where i + n - 1 <= len(w)),
h as (select doc_id, i, dw.n as n, item_id from dw join bw using (g) where dw.n = bw.n),
p as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from (select distinct doc_id, i, n from h)) group by 1),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from h group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p using (doc_id) left join it using (doc_id)
"""


@query(OP8_SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated",
    )


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by the benchmark items."""
    # a verdict depends on the text alone; ids may be null or repeated
    found = contamination(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = written(found.filter("contaminated").select(F.col("doc_id").alias(other := fresh(docs, "other_id"))).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(docs["text"]) == F.col(other), "left_anti")
