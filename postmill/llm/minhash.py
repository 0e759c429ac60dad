"""Near-duplicate documents: one-permutation hashing with optimal densification.

One hash orders a document's shingles; its top bits name the bin, and each bin keeps its
smallest shingle. An empty bin borrows from the first filled bin of a random order of its own.
Bands of bins are buckets. Inside a bucket only a star is drawn, from one hub to the other
members, so candidate pairs grow with the bucket's size and not with its square. Candidates are
confirmed on the full shingle sets. What a hub cannot link may still be linked beside it: members of
buckets that hold several components after that are keyed again by many finer keys of twice
as many bins, which most near copies share with few others, and stars are drawn in these buckets.
In the buckets that hold several components even then, all pairs of different components are
compared, block against block, so stars lose no link.

Equal sets are one node from the start: a group of copies enters the search once.

Behaviour: null and empty texts have no shingle, are linked with nothing and are kept. Rows of
one doc_id count as one document: they share a component. A null doc_id joins no group, has a
null component and is kept. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ODD, U64, WordHashes, components, fresh, mix, rows_of, shingles, table, written
from .registry import query

BIN_BITS = 8
ROWS = 6  # bins of a band
BANDS = (1 << BIN_BITS) // ROWS
FIRST_BANDS = 3  # a first round over so many bands joins most copies, so that later rounds compare little
FINE_ROWS, FINE_BANDS = 12, 256
PER_PART = 256  # members of a hub that one copy of its set serves
BLOCK, BLOCK_SHINGLES = 256, 500_000  # about so many members, or shingles of members, are a block
SLICES = 4  # of the units, whose sets are on disk at a time
WIDE = 4096  # shingles that are counted at a time
MAP_BITS = 24  # bits, as a power of 2, of the map of documents whose sets are needed


def donor_orders(seed: int = 5) -> np.ndarray:
    """For each bin the order in which it asks other bins when it is empty."""
    random = np.random.default_rng(seed)
    n = 1 << BIN_BITS
    return np.stack([random.permutation(n) for _ in range(n)])


DONORS = donor_orders()
FINE = np.stack([x[:FINE_ROWS] for x in donor_orders(6)])[:FINE_BANDS]  # the bins of each finer key


def shingle_set(text: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z are lower-cased, words are cut at ASCII white space."""
    return np.unique(shingles(hashes.of(text.lower().split()), size))


def signature(found: np.ndarray) -> np.ndarray:
    """The bins' smallest shingles; ``found`` is sorted and not empty."""
    at, first = np.unique((found >> U64(64 - BIN_BITS)).astype(np.int64), return_index=True)
    bins = np.zeros(1 << BIN_BITS, dtype=U64)
    filled = np.zeros(1 << BIN_BITS, dtype=bool)
    bins[at], filled[at] = found[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        orders = DONORS[empty]
        donor = orders[np.arange(len(empty)), filled[orders].argmax(axis=1)]
        bins[empty] = bins[donor]
    return bins


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = signature(found)[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=U64) * ODD[4]
    for k in range(ROWS):
        out = mix(out * ODD[k % 5] + rows[:, k])
    return out.view(np.int64)


def described(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, print, bands) for each row: set size, fingerprint of the set, keys of its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                found = shingle_set(text, hashes, size)
                n = len(found)
                out.append((doc_id, n, xxhash.xxh3_128_digest(found.tobytes()) if n else None, band_keys(found) if n else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, bands array<long>")


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and a few others: whole texts are not dealt out only to be dropped by a join.

    Hashes of ``ids`` set bits in a map of ``2 ** MAP_BITS``, which has at most 2 MB at any number of ids.
    """
    def place(of):
        return F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS)).alias(of)

    marks = ids.select(place("at")).groupBy(F.bitmap_bucket_number("at").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn("_at", place("_at")).withColumn("_part", F.bitmap_bucket_number("_at")).join(F.broadcast(written(marks, "marks")), "_part")
    return marked.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(docs.columns)


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, n, set) of the documents that are in some candidate pair."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            nodes, sizes, sets = [], [], []
            for node, text in rows_of(batch, "doc_id", "text"):
                found = shingle_set(text, hashes, size)
                nodes.append(node)
                sizes.append(len(found))
                sets.append(found.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["node", "n", "set"]
                )

    ids = nodes.select(F.col("node").alias("doc_id"))
    # a doc_id with several texts is one document: one of them stands for it
    wanted = likely(docs.select("doc_id", "text"), ids).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return wanted.mapInArrow(run, "node long, n long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, on the full sets.

    ``a`` is a hub: its set is sent once for every ``PER_PART`` of its members.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_PART).cast("int").alias("parts"))
    dealt = (  # parts before sets: the sets of members are dealt out by b and by hub, and not once more
        pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        .join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b")), "b")
    )
    hubs = (
        sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a")).join(degree, "a")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            if keep:
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    near = dealt.join(hubs, ["a", "part"]).filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def open_buckets(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members (band, key, node, n, c) of the buckets that hold more than one component; c is the node's component."""
    labelled = written(members.join(known.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node")), "labelled")
    several = labelled.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("band", "key")
    return labelled.join(written(several, "several"), ["band", "key"])


def stars(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): in each bucket its smallest member with each member of another component whose size allows a link."""
    members = written(members, "left")
    hubs = members.groupBy("band", "key").agg(F.min(F.struct("node", "n", "c")).alias("hub"))
    return (
        members.join(written(hubs, "hubs"), ["band", "key"]).filter("c != hub.c")
        .filter(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
        .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    )


def finer(sets: DataFrame) -> DataFrame:
    """(band, key, node, n) for keys of ``FINE_ROWS`` bins, of which there are ``FINE_BANDS``: unlike texts hardly ever share one."""

    def run(batches):
        for batch in batches:
            keys = []
            for found in batch.column("set"):
                bins, out = signature(np.frombuffer(found.as_buffer(), U64)), np.arange(FINE_BANDS, dtype=U64)
                for k in range(FINE_ROWS):
                    out = mix(out * ODD[k % 5] + bins[FINE[:, k]])
                keys.append(out.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "keys"])

    keyed = sets.select("node", "n", "set").mapInArrow(run, "node long, n long, keys array<long>")
    rows = keyed.select("node", "n", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1").select("band", "key")
    return written(rows, "fine").join(written(shared, "fine-shared"), ["band", "key"]).select("band", "key", "node", "n")


def block_pairs(members: DataFrame) -> DataFrame:
    """(unit, node, c, side): each pair of different components in a bucket of ``members`` meets in some unit.

    A bucket is dealt into blocks, a component that fills a block has its own; a unit is two blocks, or one against itself. Buckets
    with equal members give one unit. ``side`` is 1 in the first block, 2 in the second and 3 if both are the same.
    """
    whole = written(members.groupBy("band", "key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n")), "held")
    bulk = (F.col("m") >= BLOCK) | (F.col("n") >= BLOCK_SHINGLES)
    own = F.when(bulk, F.col("c"))  # null: a block of several small components
    per = whole.withColumn("own", own).groupBy("band", "key", "own").agg(
        F.ceil(F.greatest(F.sum("m") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    per = written(per, "parts")
    lot = whole.select("band", "key", "c", own.alias("own")).withColumnRenamed("c", "_c")
    lot = lot.join(per.select(F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("own").alias("_own"), "parts"),
                   (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("_own"))).drop("_band", "_key", "_own")
    lot = written(lot, "lots").select(F.col("band").alias("_band"), F.col("key").alias("_key"), "_c", "own", "parts")
    block = F.struct("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    dealt = written(
        members.join(lot, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")) & (F.col("c") == F.col("_c")))
        .select("band", "key", "node", "c", block.alias("block")), "dealt")
    blocks = written(dealt.select("band", "key", "block").distinct(), "blocks")
    other = blocks.withColumnRenamed("block", "with")
    units = blocks.join(other, ["band", "key"]).filter("block <= with and not coalesce(block.own = with.own, false)")
    units = written(units.withColumn("unit", F.monotonically_increasing_id()), "block-pairs")
    sides = units.filter("block = with").select("band", "key", "block", "unit", F.lit(3).alias("side")).unionByName(
        units.filter("block != with").select("band", "key", "block", "unit", F.lit(1).alias("side"))).unionByName(
        units.filter("block != with").select("band", "key", F.col("with").alias("block"), "unit", F.lit(2).alias("side")))
    keyed = F.xxhash64("band", "key", "block")
    meet = dealt.withColumn("at", keyed).join(
        sides.withColumn("at", keyed).select("at", F.col("band").alias("_band"), F.col("key").alias("_key"), F.col("block").alias("_block"), "unit", "side"), "at"
    ).filter((F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key")) & F.col("block").eqNullSafe(F.col("_block")))
    held = meet.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("side", "node", "c"))).alias("rows"))
    once = written(held.select("rows").distinct().withColumn("unit", F.monotonically_increasing_id()), "units")
    return once.select("unit", F.explode("rows").alias("x")).select("unit", "x.node", "x.c", "x.side")


def shared_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set of ``first`` with each of ``second``."""
    sizes = [len(x) for x in first + second]
    row = np.repeat(np.arange(len(sizes)), sizes)
    column, m = np.unique(np.concatenate(first + second), return_inverse=True, return_counts=True)[1:]
    several = m > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(first), len(second)), np.float64)
    for lo in range(0, int(several.sum()), WIDE):
        i, j = np.searchsorted(column, [lo, lo + WIDE])
        x = np.zeros((len(sizes), WIDE), np.float32)
        x[row[i:j], column[i:j] - lo] = 1
        out += x[: len(first)] @ x[len(first) :].T
    return out.astype(np.int64)


def compared(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of a unit as all its confirmed pairs do."""

    def run(group: pa.Table) -> pa.Table:
        node, c, n, side = (group.column(x).to_numpy() for x in ("node", "c", "n", "side"))
        found = [np.frombuffer(x.as_buffer(), U64) for x in group.column("set")]
        x, y = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        fits = (c[x][:, None] != c[y]) & (100 * np.minimum(n[x][:, None], n[y]) >= percent * np.maximum(n[x][:, None], n[y]))
        if side[0] == 3:
            fits = np.triu(fits)
        links = []
        if fits.any():
            both = shared_counts([found[i] for i in x], [found[i] for i in y])
            near = fits & (100 * both >= percent * (n[x][:, None] + n[y] - both))
            up = {k: k for k in c.tolist()}

            def root(k):
                while up[k] != k:
                    up[k] = k = up[up[k]]
                return k

            for i, j in np.argwhere(near):
                a, b = root(int(c[x[i]])), root(int(c[y[j]]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    links.append((node[x[i]], node[y[j]]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = None
    for k in range(SLICES):  # the sets of one slice of units are dealt out at a time, and their shuffle files deleted
        some = units.filter(F.pmod(F.xxhash64("unit"), F.lit(SLICES)) == k)
        held = likely(sets.withColumnRenamed("node", "doc_id"), some.select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", "node")
        found = written(some.join(held.select("node", "n", "set"), "node").groupBy("unit").applyInArrow(run, "a long, b long"), "compared")
        links = found if links is None else links.unionByName(found)
    return links


def link(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = written(described(docs, size), "described")
    # one node for each set: its smallest document; hot groups of copies shrink before they are dealt
    first = rows.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "n", "bands")).alias("x"))
    nodes = written(first.select("print", F.col("x.doc_id").alias("node"), F.col("x.n").alias("n"), F.col("x.bands").alias("bands")), "nodes")
    # one doc_id with several texts is one document
    same = rows.filter("print is not null and doc_id is not null").join(nodes.select("print", "node"), "print").filter("doc_id != node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    several = nodes.select("node").join(same.select(F.col("a").alias("node")), "node", "left_semi").distinct()
    twice = same.join(several.select(F.col("node").alias("a")), "a", "left_semi").distinct()

    # a key names its band too; counted alone, keys are dealt out without their members. A node of several texts may count twice
    keys = nodes.select(F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    members = written(members.join(shared.select("key"), "key").select("band", "key", "node", "n").distinct(), "members")
    sets = written(full_sets(docs, written(members.select("node").distinct(), "candidates"), size), "sets")

    known = components(written(twice, "twice"))
    tested = None
    for step in ("first bands", "all bands", "finer keys"):
        some = members.filter(F.col("band") < FIRST_BANDS) if step == "first bands" else members
        if step == "finer keys":
            some = finer(sets.join(written(open_buckets(members, known).select("node").distinct(), "open"), "node"))
        pairs = stars(open_buckets(some, known), percent)
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if pairs.limit(1).count():
            known = components(written(confirmed(pairs, sets, percent), "confirmed"), known)
    # the star of two members was their only pair
    rest = written(open_buckets(members.join(written(shared.filter("m > 2").select("key"), "larger"), "key").select(members.columns), known), "rest")
    if rest.limit(1).count():
        known = components(compared(written(block_pairs(rest), "met"), sets, percent), known)
    owner = written(
        nodes.select("print", "node").join(known, "node", "left").select("print", F.coalesce("component", "node").alias("component")), "owner"
    )
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "print").join(owner, "print", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one kept document, the smallest id, in every group of near copies."""
    linked = link(docs, size, percent)
    return linked.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP2_SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as other from documents union select r.node, e.b from r join e on e.a = r.other),
m as (select node, min(other) as component_id from r group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d join m on m.node = d.doc_id left join n on n.doc_id = d.doc_id
"""


@query(OP2_SQL)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies, of the smallest id; texts of a repeated id are judged one by one, rows without an id stay."""
    row = fresh(docs, "row_key")
    # (doc_id, text) is a document here
    named = docs.filter("doc_id is not null").withColumn(row, F.xxhash64("doc_id", "text"))
    linked = written(link(named.select(F.col(row).alias("doc_id"), "text"), 5, 80).distinct(), "linked")
    ids = named.select("doc_id", F.col(row).alias("_row")).distinct().join(linked.withColumnRenamed("doc_id", "_linked"), F.col("_row") == F.col("_linked"))
    ids = written(ids.select("doc_id", "_row", "n_shingles", "component_id"), "ids")
    first = ids.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("x")).select(F.col("x._row").alias(row))
    kept = written(first.unionByName(ids.filter("n_shingles = 0").select(F.col("_row").alias(row))), "kept")
    return named.join(kept, row, "left_semi").dropDuplicates([row, "doc_id"]).select(docs.columns).unionByName(docs.filter("doc_id is null"))
