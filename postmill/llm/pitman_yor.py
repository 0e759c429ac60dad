"""Language-model scores by a hierarchical Pitman-Yor process.

Each word is a context, and its restaurant seats the words that followed it in training; all
these restaurants share one parent, the restaurant of single words, whose base is uniform. A restaurant's
tables are the parent's customers. Given all else, the number of tables of a dish among c customers has a
closed conditional, with generalised Stirling numbers S(c, t); Gibbs sweeps draw it for all dishes, by its cumulative weights. S
comes from its recursion up to ``EXACT`` customers, and beyond from its alternating sum where that loses
no digits, else from the saddle point of its generating function. After a burn-in, sweeps are samples, and
a word's probability is the average of the samples' predictive probabilities. Discounts come from
the counts of single and double customers, the concentrations from the likeliest of a grid in each sweep.

How it is spread: words have numbers in ``side`` slices; a cell (i, j) holds the pairs with the context in slice i
and the word in slice j, so a frequent context or word is shared by ``side`` cells, and a frequent pair arrives as
one count for each block of documents. A sweep updates all cells side by side and then adds up tables by context
and by word; cells see the sums of the sweep before. Scoring asks the cells, block by block, for each block's distinct pairs.

Behaviour: null and empty texts are the end token alone. Rows of one doc_id are scored row by row; a null doc_id
is hashed as the empty text. Unknown words share one place beside the known ones, V + 1 in all. Without training rows
all probabilities are one. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import U64, remainder, remove, rows_of, table, trim, work_path
from .registry import query

BLOCK_TOKENS = 1_500_000
CELL_TOKENS = 1_500_000
PART_WORDS = 1_000_000
BURN_IN, SAMPLES = 1, 2
EXACT = 1024  # customers up to which Stirling numbers are tabled
POINTS = 64  # numbers of tables that are weighed for a larger dish, evenly over where nearly all weight is
GRID = tuple(10.0 ** (k / 3) for k in range(-3, 19))
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line break

ROW = "to long, kind string, part long, a binary, b binary, c binary, x array<double>"
FIELDS = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("x", pa.list_(pa.float64()))])


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (to, kind, part, a, b, c, x), cut off at the right where the rest is null."""
    full = [tuple(r) + (None,) * (7 - len(r)) for r in rows]
    columns = list(zip(*full, strict=True)) if full else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.types, strict=True)], schema=FIELDS)


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows)])


def pack_pairs(u: np.ndarray, w: np.ndarray) -> bytes:
    """Pairs in the order of u."""
    return zstandard.compress(np.diff(u, prepend=0).astype("<i4").tobytes() + w.astype("<i4").tobytes(), 1)


def unpack_pairs(data: bytes) -> np.ndarray:
    both = unpack(data, "<i4").reshape(2, -1)
    return (np.cumsum(both[0], dtype=np.int64) << 32) | both[1].astype(np.int64)


# ---- blocks of documents -------------------------------------------------------------------------------------------


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


BLOCK = "block long, doc_ids array<long>, held binary, lengths binary, words binary, tokens binary, n long"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents: their tokens as numbers in the block's sorted word hashes."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, held, lengths, tokens, known, n = [], [], [], [], Numbers(), 0
        known[None] = 0  # the end

        def flush():
            hashes = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in known), dtype=U64, count=len(known))
            words, place = np.unique(hashes, return_inverse=True)
            numbers = place.astype(np.int32)[np.concatenate(tokens)]
            values = [block, ids, pack(np.array(held, np.uint8)), pack(np.array(lengths, np.int64)), pack(words), pack(numbers), n]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text, out in rows_of(batch, "doc_id", "text", "held"):
                words = text.lower().split()
                found = np.empty(len(words) + 1, np.int32)
                found[:-1] = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
                found[-1] = 0
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(found))
                tokens.append(found)
                n += len(found)
                if n >= BLOCK_TOKENS:
                    yield flush()
                    trim()
                    block += 1
                    ids, held, lengths, tokens, known, n = [], [], [], [], Numbers(), 0
                    known[None] = 0
        if ids:
            yield flush()
        trim()

    return docs.select("doc_id", "text", (remainder() == 1).alias("held")).mapInArrow(run, BLOCK)


def word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """Numbers and training counts for each block's words (kind r) and for each part of the words (kind w)."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, tokens = unpack(row["words"], U64), unpack(row["tokens"], np.int32)
                train = np.repeat(unpack(row["held"], np.uint8) == 0, unpack(row["lengths"], np.int64))
                counts = np.bincount(tokens[train], minlength=len(words)).astype(np.int64)
                part = (words % U64(parts)).astype(np.int64)
                yield batch_of([(p, "v", row["block"], pack(words[part == p]), pack(counts[part == p])) for p in np.unique(part).tolist()])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        asked = [unpack(r["a"], U64) for r in rows]
        words, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, place, np.concatenate([unpack(r["b"], np.int64) for r in rows]))
        p, out, at = rows[0]["to"], [], 0
        for r, a in zip(rows, asked, strict=True):
            mine = place[at : at + len(a)]
            at += len(a)
            out.append((r["part"], "r", p, pack(mine.astype(np.int32)), pack(counts[mine])))
        out.append((0, "w", p, None, pack(counts), None, [float(len(words)), float((counts > 0).sum()), float(counts.sum())]))
        return table_of(out)

    return blocks.mapInArrow(ask, ROW).groupBy("to").applyInArrow(answer, ROW)


NUMBERED = "block long, doc_ids array<long>, held binary, lengths binary, tokens binary, slices binary, ids binary, counts binary, end int"


def numbered(blocks: DataFrame, words: DataFrame, parts: int, side: int, offsets: list[int]) -> DataFrame:
    """Blocks whose words stand in the order of (slice, number), with their slices, numbers and training counts."""
    replies = words.filter("kind = 'r'").groupBy(F.col("to").alias("_block")).agg(F.collect_list(F.struct("part", "a", "b")).alias("replies"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words, tokens = unpack(row["words"], U64), unpack(row["tokens"], np.int32)
                part = (words % U64(parts)).astype(np.int64)
                ids, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
                for r in row["replies"]:
                    mine = part == r["part"]
                    ids[mine] = unpack(r["a"], np.int32) + offsets[r["part"]]
                    counts[mine] = unpack(r["b"], np.int64)
                slices = part % side
                order = np.lexsort((ids, slices))
                place = np.empty(len(words), np.int32)
                place[order] = np.arange(len(words), dtype=np.int32)
                end = int(place[np.searchsorted(words, U64(END))])
                values = [row["block"], row["doc_ids"], row["held"], row["lengths"], pack(place[tokens]), pack(slices[order].astype(np.int32)), pack(ids[order].astype(np.int32)), pack(counts[order]), end]
                types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in NUMBERED.split(", ")])

    return blocks.join(replies, blocks["block"] == replies["_block"]).select(
        "block", "doc_ids", "held", "lengths", "words", "tokens", "replies").mapInArrow(run, NUMBERED)


class Pairs:
    """The distinct (context, word) pairs of a block in the order of their cells."""

    def __init__(self, row: dict, side: int):
        self.tokens, self.lengths = unpack(row["tokens"], np.int32), unpack(row["lengths"], np.int64)
        self.held = unpack(row["held"], np.uint8) > 0
        slices, ids = unpack(row["slices"], np.int32).astype(np.int64), unpack(row["ids"], np.int32)
        n = len(ids)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = row["end"]  # a document starts after an end
        keys, self.place = np.unique(before * n + self.tokens, return_inverse=True)
        u, w = keys // n, keys % n
        cell = slices[u] * side + slices[w]
        self.order = np.argsort(cell.astype(np.uint16) if side <= 255 else cell, kind="stable")
        self.u, self.w = ids[u[self.order]], ids[w[self.order]]
        self.cells, self.starts = np.unique(cell[self.order], return_index=True)
        self.ends = np.append(self.starts[1:], len(keys))

    def train_counts(self) -> np.ndarray:
        train = np.repeat(~self.held, self.lengths)
        return np.bincount(self.place[train], minlength=len(self.order))[self.order]


def requests(blocks: DataFrame, side: int, training: bool) -> DataFrame:
    """For each block and cell its pairs (kind q); in training with their counts, and only pairs that occur in training rows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pairs = Pairs(row, side)
                counts = pairs.train_counts() if training else None
                rows = []
                for cell, s, e in zip(pairs.cells.tolist(), pairs.starts.tolist(), pairs.ends.tolist(), strict=True):
                    u, w = pairs.u[s:e], pairs.w[s:e]
                    if training:
                        seen = counts[s:e] > 0
                        if seen.any():
                            rows.append((cell, "q", row["block"], pack_pairs(u[seen], w[seen]), pack(counts[s:e][seen].astype(np.uint32))))
                    else:
                        rows.append((cell, "q", row["block"], pack_pairs(u, w)))
                out = batch_of(rows)
                del pairs, counts, rows
                trim()
                yield out

    return blocks.mapInArrow(run, ROW)


# ---- restaurants ---------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting up to 8; x > 0."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


@functools.lru_cache(maxsize=2)
def log_stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), c and t up to EXACT: S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    table_ = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table_[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(EXACT):
            t = np.arange(1, c + 2)
            stay = np.log(np.maximum(c - t * discount, 0)) + table_[c, 1 : c + 2]
            table_[c + 1, 1 : c + 2] = np.logaddexp(table_[c, 0 : c + 1], stay)
    return table_


def far_stirling(c: np.ndarray, t: np.ndarray, d: float, terms: int = 80) -> np.ndarray:
    """log S(c, t) for many customers, 1 <= t <= c.

    t! d^t S(c, t) is the sum over j of (-1)^j binom(t, j) G(c - j d) / G(-j d), G being the gamma function, and c! times the
    coefficient of z^c in (1 - (1 - z)^d)^t. The sum is taken where it converges without cancellation, which is where t is
    small beside c^d; elsewhere t is large and the coefficient is that of the saddle point, with its first correction.
    """
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    scale = log_gamma(t + 1) + t * math.log(d)
    # the sum, over log G(c)
    base, first = log_gamma(c), log_gamma(t + 1)
    total, most, last = np.zeros_like(c), np.zeros_like(c), np.full_like(c, np.inf)
    going = np.ones(len(c), bool)
    for j in range(1, terms + 1):
        at = np.flatnonzero(going & (j <= t))
        if len(at) == 0:
            break
        size = first[at] - log_gamma(np.full(1, j + 1.0)) - log_gamma(t[at] - j + 1) + log_gamma(c[at] - j * d) - base[at] + log_gamma(np.full(1, 1 + j * d))
        size = np.exp(np.minimum(size, 600))
        total[at] += (1 if j % 2 else -1) * math.sin(math.pi * j * d) / math.pi * size
        most[at] = np.maximum(most[at], size)
        last[at] = size
        going[at] = (size > 1e-14 * most[at]) & (most[at] < 1e7 * np.abs(total[at]) + 1e-300)
    last[t <= terms] = 0  # the sum has ended
    good = (total > 0) & (most < 1e7 * total) & ((last <= 1e-9 * total) | (last <= 1e-14 * most))
    with np.errstate(divide="ignore", invalid="ignore"):
        by_sum = np.log(total) + base - scale
    out = np.where(good, by_sum, 0.0)
    far = np.flatnonzero(~good & (t < c))
    if len(far):
        # u = log(1 - z); the logarithmic derivative of 1 - (1 - z)^d falls in u from infinity to 1: Newton steps within a bracket
        mean = np.log(c[far] / t[far])
        low, high, u = np.full(len(far), -700.0), np.full(len(far), -1e-12), np.full(len(far), -1.0)
        for _ in range(100):
            z = -np.expm1(u)
            slope = np.log(z) + math.log(d) + (d - 1) * u - np.log(-np.expm1(d * u))
            above = slope > mean
            low, high = np.where(above, u, low), np.where(above, high, u)
            odds = z / np.exp(u)
            new = u + (slope - mean) * odds / (1 + (1 - d) * odds - np.exp(slope))
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            done = np.abs(new - u) <= 1e-12 * np.abs(u)
            u = new
            if done.all():
                break
        z, f = -np.expm1(u), -np.expm1(d * u)
        # cumulants of log f by log z
        ratio = z / np.exp(u)
        k1 = np.exp(mean)
        r = 1 + (1 - d) * ratio - k1
        k2 = k1 * r
        dr = (1 - d) * ratio * (1 + ratio) - k2
        k3 = k2 * r + k1 * dr
        ddr = (1 - d) * (ratio * (1 + ratio) * (1 + 2 * ratio)) - k3
        k4 = k3 * r + 2 * k2 * dr + k1 * ddr
        tt = t[far]
        correction = (k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)) / tt
        value = log_gamma(c[far] + 1) + tt * np.log(f) - c[far] * np.log(z) - 0.5 * np.log(2 * math.pi * tt * k2) + np.log1p(np.clip(correction, -0.5, 0.5))
        out[far] = value - scale[far]
    return out


def log_weight(c: np.ndarray, t: np.ndarray, open_: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """log of the weight of t tables, for many customers; ``open_`` is strength / discount plus the other tables."""
    return far_stirling(c, t, d) + t * np.log(parent * d) + log_gamma(open_ + t) - log_gamma(open_)


def draw_far(c: np.ndarray, open_: np.ndarray, parent: np.ndarray, d: float, random) -> np.ndarray:
    """Tables of dishes with many customers: the numbers of tables around the likeliest are weighed, or ``POINTS`` of them."""
    weight = lambda t: log_weight(c, t, open_, parent, d)
    low, high = np.ones(len(c)), c.astype(np.float64)
    while (high > low).any():  # the weights rise to one peak and fall
        middle = np.floor((low + high) / 2)
        rising = (middle < high) & (weight(np.minimum(middle + 1, c)) > weight(middle))
        low, high = np.where(rising, middle + 1, low), np.where(rising, high, middle)
    peak = low
    # from the peak out to where the weight has fallen by a factor of e^25 on both sides
    top = weight(peak)
    ends = []
    for sign in (-1, 1):
        limit = np.where(sign < 0, peak - 1, c - peak)
        step = np.minimum(1.0, limit)
        while True:
            going = (step < limit) & (weight(np.clip(peak + sign * step, 1, c)) > top - 25)
            if not going.any():
                break
            step = np.where(going, np.minimum(1.4 * step + 1, limit), step)
        ends.append(np.floor(step))
    first, last = peak - ends[0], peak + ends[1]
    width = np.minimum(last - first + 1, POINTS).astype(np.int64)
    owner = np.repeat(np.arange(len(c)), width)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)
    gap = np.where(width > 1, (last - first) / np.maximum(width - 1, 1), 1.0)
    points = np.rint(first[owner] + place * gap[owner])
    logs = log_weight(c[owner], points, open_[owner], parent[owner], d)
    starts = np.cumsum(width) - width
    sums = np.cumsum(np.exp(logs - np.maximum.reduceat(logs, starts)[owner]))
    before = np.concatenate([[0.0], sums])[starts]
    target = before + random.random(len(c)) * (sums[starts + width - 1] - before)
    found = points[np.clip(np.searchsorted(sums, target, "right"), starts, starts + width - 1)]
    spread = np.floor((random.random(len(c)) - 0.5) * gap + 0.5)  # between two points that are not neighbours
    return np.clip(np.where(gap > 1, found + spread, found), 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, random) -> np.ndarray:
    """Tables of dishes with ``c`` customers, given the restaurant's ``others`` tables and the dish's ``parent`` probability.

    One law for all sizes: t tables weigh S(c, t) times the product over i < t of (strength + discount (others + i)) parent.
    """
    t = np.minimum(c, 1).astype(np.int64)
    stirling = log_stirling(discount)
    order = np.argsort(c, kind="stable")
    sizes, starts = np.unique(c[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    for n, first, end in zip(sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if not 2 <= n <= EXACT:
            continue
        step = max(1, 4_000_000 // n)
        for start in range(first, end, step):
            at = order[start : min(start + step, end)]
            steps = np.log(strength + discount * (others[at, None] + np.arange(n))) + np.log(parent[at, None])
            weight = np.cumsum(steps, axis=1) + stirling[n, 1 : n + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[at] = 1 + (weight < random.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    for start in range(0, len(many), 500):
        at = many[start : start + 500]
        t[at] = draw_far(c[at], strength / discount + others[at].astype(np.float64), parent[at], discount, random)
    return t


class Settings:
    def __init__(self, side: int, lengths: list[int], vocabulary: int):
        self.side, self.lengths, self.base = side, lengths, 1 / (vocabulary + 1)
        self.discount, self.strength = 0.8, 1.0
        self.top_discount, self.top_strength, self.customers, self.tables = 0.8, 1.0, 0, 0

    def word_probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        rest = (self.top_strength + self.top_discount * self.tables) * self.base
        return (customers - self.top_discount * tables + rest) / (self.top_strength + self.customers)


def sums_of(cell: int, side: int, lengths: list[int], keys: np.ndarray, t: np.ndarray) -> list[tuple]:
    """A cell's tables by context (for slice i) and by word (for slice side + j)."""
    i, j = divmod(cell, side)
    by_u = np.bincount(keys >> 32, weights=t, minlength=lengths[i]).astype(np.int32)
    by_w = np.bincount(keys & 0xFFFFFFFF, weights=t, minlength=lengths[j]).astype(np.int32)
    return [(i, "u", cell, pack(by_u)), (side + j, "k", cell, pack(by_w))]


def seated(asked: DataFrame, side: int, lengths: list[int]) -> DataFrame:
    """The cells' restaurants (kind s) with one table for each dish, and their sums."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys, place = np.unique(np.concatenate([unpack_pairs(r["a"]) for r in rows]), return_inverse=True)
        c = np.zeros(len(keys), np.int64)
        np.add.at(c, place, np.concatenate([unpack(r["b"], np.uint32) for r in rows]).astype(np.int64))
        cell = rows[0]["to"]
        t = np.ones(len(keys), np.int64)
        state = (cell, "s", 0, pack_pairs(keys >> 32, keys & 0xFFFFFFFF), pack(c.astype(np.uint32)), pack(t.astype(np.uint32)), [float((c == 1).sum()), float((c == 2).sum())])
        return table_of([state, *sums_of(cell, side, lengths, keys, t)])

    return asked.groupBy("to").applyInArrow(run, ROW)


def added(sums: DataFrame, counts: DataFrame, settings: Settings, seed: int) -> DataFrame:
    """By slice: tables and training counts of contexts (kind U), customers and tables of the parent restaurant's dishes (kind K).

    ``x`` has for contexts the log likelihood of the seating for each concentration of the grid, and for words the sums
    of customers, tables, single and double customers.
    """
    side = settings.side

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        to = rows[0]["to"]
        total = np.zeros(settings.lengths[to % side], np.int64)
        c = np.zeros(len(total), np.int64)
        for r in rows:
            if r["kind"] == "c":
                found = unpack(r["b"], np.int64)
                c[r["part"] : r["part"] + len(found)] = found
            else:
                total += unpack(r["a"], np.int32)
        if to < side:
            used, n = total[total > 0].astype(np.float64), c[total > 0].astype(np.float64)
            d, x = settings.discount, []
            for s in GRID:
                opened = (used - 1) * math.log(d) + log_gamma(s / d + used) - log_gamma(np.full(1, s / d + 1))
                x.append(float((opened - log_gamma(s + n) + log_gamma(np.full(1, s + 1))).sum()))
            return table_of([(to, "U", to, pack(total), pack(c), None, x)])
        random = np.random.default_rng([seed, to])
        others = np.full(len(total), max(settings.tables - 1, 0))
        t = draw_tables(total, others, np.full(len(total), settings.base), settings.top_discount, settings.top_strength, random)
        return table_of([(to, "K", to - side, pack(total), pack(t), None, [float(total.sum()), float(t.sum()), float((total == 1).sum()), float((total == 2).sum())])])

    return sums.filter("kind in ('u', 'k')").unionByName(counts).groupBy("to").applyInArrow(run, ROW)


def to_cells(slices: DataFrame, side: int, tag: str) -> DataFrame:
    """Every slice of contexts to its row of cells, every slice of words to its column."""
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")))
    spread = slices.withColumn("_o", others)
    cell = F.when(F.col("kind") == "U", F.col("part") * side + F.col("_o")).otherwise(F.col("_o") * side + F.col("part"))
    return spread.select(cell.alias("to"), F.concat("kind", F.lit(tag)).alias("kind"), "part", "a", "b", "c", "x")


def swept(state: DataFrame, slices: DataFrame, settings: Settings, seed: int, keep: bool) -> DataFrame:
    """A Gibbs sweep over all cells; with ``keep`` the draw is kept as a sample beside the earlier ones."""

    def run(group: pa.Table) -> pa.Table:
        rows = {r["kind"]: r for r in group.to_pylist()}
        if "s" not in rows:
            return table_of([])
        s = rows["s"]
        keys, c = unpack_pairs(s["a"]), unpack(s["b"], np.uint32).astype(np.int64)
        t = unpack(s["c"], np.uint32).reshape(-1, len(keys)) if len(keys) else np.empty((1, 0), np.uint32)
        by_u = unpack(rows["U"]["a"], np.int64)
        parent = settings.word_probability(unpack(rows["K"]["a"], np.int64), unpack(rows["K"]["b"], np.int64))
        u, w = keys >> 32, keys & 0xFFFFFFFF
        random = np.random.default_rng([seed, s["to"]])
        new = np.ones(len(keys), np.int64)
        several = np.flatnonzero(c > 1)
        others = np.maximum(by_u[u[several]] - t[0][several], 0)
        new[several] = draw_tables(c[several], others, parent[w[several]], settings.discount, settings.strength, random)
        drawn = np.stack([new.astype(np.uint32), *([new.astype(np.uint32)] if keep else []), *t[1:]])
        return table_of([(s["to"], "s", 0, s["a"], s["b"], pack(drawn)), *sums_of(s["to"], settings.side, settings.lengths, keys, new)])

    inputs = state.filter("kind = 's'").unionByName(to_cells(slices, settings.side, ""))
    return inputs.groupBy("to").applyInArrow(run, ROW)


def answered(asked: DataFrame, state: DataFrame, samples: list[tuple[DataFrame, Settings]], side: int) -> DataFrame:
    """log10 of the averaged predictive probability for each asked pair, back to the blocks (kind p)."""
    inputs = asked.unionByName(state.filter("kind = 's'"))
    for k, (slices, _) in enumerate(samples):
        inputs = inputs.unionByName(to_cells(slices, side, str(k)))
    settings = [s for _, s in samples]

    def run(group: pa.Table) -> pa.Table:
        if not any(k == "q" for k in group.column("kind").to_pylist()):
            return table_of([])
        rows, asked_rows = {}, []
        for r in group.to_pylist():
            if r["kind"] == "q":
                asked_rows.append(r)
            else:
                rows[r["kind"]] = r
        if "s" in rows:
            keys, c = unpack_pairs(rows["s"]["a"]), unpack(rows["s"]["b"], np.uint32).astype(np.float64)
            t = unpack(rows["s"]["c"], np.uint32).reshape(-1, len(keys))[1:]
        else:
            keys, c, t = np.empty(0, np.int64), np.empty(0), np.empty((len(settings), 0), np.uint32)
        # the last sample kept comes first
        by = [(unpack(rows[f"U{k}"]["a"], np.int64), unpack(rows[f"U{k}"]["b"], np.int64), s.word_probability(unpack(rows[f"K{k}"]["a"], np.int64), unpack(rows[f"K{k}"]["b"], np.int64))) for k, s in enumerate(settings)]
        out = []
        for r in asked_rows:
            q = unpack_pairs(r["a"])
            u, w = q >> 32, q & 0xFFFFFFFF
            at = np.searchsorted(keys, q)
            at[at == len(keys)] = 0
            seen = keys[at] == q if len(keys) else np.zeros(len(q), bool)
            total = np.zeros(len(q))
            for k, (tables, customers, parent) in enumerate(by):
                s = settings[k]
                own = np.where(seen, c[at] - s.discount * t[len(settings) - 1 - k][at], 0.0) if len(keys) else 0.0
                total += (own + (s.strength + s.discount * tables[u]) * parent[w]) / (s.strength + customers[u])
            out.append((r["part"], "p", r["to"], pack(np.log10(total / len(by)).astype(np.float32))))
        return table_of(out)

    return inputs.groupBy("to").applyInArrow(run, ROW)


def summed(blocks: DataFrame, replies: DataFrame, side: int, tokens: int, vocabulary: int) -> DataFrame:
    """A row for each document, from its block's answers."""
    given = replies.groupBy(F.col("to").alias("_block")).agg(F.collect_list(F.struct("part", "a")).alias("replies"))
    base = tokens + 0.5 * (vocabulary + 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pairs = Pairs(row, side)
                answers = {r["part"]: r["a"] for r in row["replies"]}
                by_cell = np.concatenate([unpack(answers[c], np.float32) for c in pairs.cells.tolist()])
                logs = np.empty(len(by_cell))
                logs[pairs.order] = by_cell
                counts = unpack(row["counts"], np.int64)[pairs.tokens]
                starts = np.cumsum(pairs.lengths) - pairs.lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(pairs.held), pa.array(pairs.lengths),
                        pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), tokens, np.int64)),
                        pa.array(np.add.reduceat(np.log10((counts + 0.5) / base), starts)), pa.array(np.add.reduceat(logs[pairs.place], starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    joined = blocks.join(given, blocks["block"] == given["_block"]).drop("_block")
    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(docs: DataFrame, sweeps: int = BURN_IN + SAMPLES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learned from the rows that are not held out."""
    spark = docs.sparkSession
    paths: list[str] = []

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, name)
        df.write.option("compression", "none").parquet(path)  # its columns are compressed already
        paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(*names: str) -> None:
        for path in [p for p in paths if p.rpartition("/")[2].rpartition("-")[0] in names]:
            paths.remove(path)
            remove(spark, path)

    raw = stored(blocks_of(docs), "lm_raw")
    total = raw.agg(F.sum("n")).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(total / CELL_TOKENS)))
    parts = side * max(1, math.ceil(total / 10 / PART_WORDS / side))
    words = stored(word_counts(raw, parts), "lm_words")
    # one row for each part
    sizes = {p: x for p, x in words.filter("kind = 'w'").select("part", "x").collect()}
    offsets, lengths = [0] * parts, [0] * side
    for p in range(parts):
        offsets[p] = lengths[p % side]
        lengths[p % side] += int(sizes[p][0]) if p in sizes else 0
    vocabulary, tokens = (int(sum(x[k] for x in sizes.values())) for k in (1, 2))
    blocks = stored(numbered(raw, words, parts, side, offsets), "lm_blocks")
    drop("lm_raw")
    place = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), (F.col("part") + 1).cast("int"))
    counts = words.filter("kind = 'w'").select((F.col("part") % side).alias("to"), F.lit("c").alias("kind"), place.alias("part"), "a", "b", "c", "x")

    settings = Settings(side, lengths, vocabulary)
    state = stored(seated(requests(blocks, side, True), side, lengths), "lm_state")
    first = state.filter("kind = 's'").agg(F.sum(F.get("x", F.lit(0))), F.sum(F.get("x", F.lit(1)))).first()
    settings.discount = estimated(*first)
    samples = []
    for k in range(sweeps + 1):
        if k:
            state = stored(swept(state, slices, settings, 2 * k, k > BURN_IN), f"lm_state{k}")
            drop("lm_state" if k == 1 else f"lm_state{k - 1}")
        now = Settings(side, lengths, vocabulary)
        now.__dict__.update(settings.__dict__)
        slices = stored(added(state, counts, now, 2 * k + 1), f"lm_slices{k}")
        # two rows for each slice: its sums
        found = slices.select("kind", "x").collect()
        likelihood = np.sum([x for kind, x in found if kind == "U"] or [[0.0] * len(GRID)], axis=0)
        customers, tables, ones, twos = np.sum([x for kind, x in found if kind == "K"] or [[0.0] * 4], axis=0)
        now.strength = GRID[int(np.argmax(likelihood))]
        now.customers, now.tables, now.top_discount = int(customers), int(tables), estimated(ones, twos)
        if tables > 1:
            d = now.top_discount
            now.top_strength = max(GRID, key=lambda s: float((tables - 1) * math.log(d) + math.lgamma(s / d + tables) - math.lgamma(s / d + 1) - math.lgamma(s + customers) + math.lgamma(s + 1)))
        settings = now
        if k > BURN_IN:
            samples.append((slices, settings))
    replies = answered(requests(blocks, side, False), state, samples, side)
    return summed(blocks, stored(replies, "lm_answers"), side, tokens, vocabulary)


def estimated(ones: float | None, twos: float | None) -> float:
    """The usual estimate of a discount, kept away from 0 and 1."""
    ones, twos = ones or 0.0, twos or 0.0
    return min(0.98, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


@query()
def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
