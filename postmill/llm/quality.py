"""Quality classifier: supervised subword embeddings.

A text's features are its words, the words' character n-grams (3 and 4 bytes) and its word pairs, hashed into
a table of vectors; a text is the mean of its vectors, and a softmax layer gives the classes.
Vectors and output layer are learned by stochastic gradient descent in numpy on a bounded,
balanced sample of labelled rows. For scoring, vectors and layer are multiplied out to one
number per class and bucket, and texts are hashed as whole arrays of bytes.

Behaviour: null and empty texts have no features and score by the softmax of zeros (an even
chance); every row is scored by itself, so repeated rows get equal scores; several labels of
one id count as the lowest; without labels of both classes all scores are even. Columns other than the id
and the text are neither read nor returned.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ODD, U64, mix, remainder, rows_of, table, trim
from .registry import query

BUCKET_BITS = 18
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
#: Training rows of each class at most, and bytes of their texts in all at most.
SAMPLE_ROWS = 2_500
SAMPLE_BYTES = 48_000_000
THRESHOLD = 0.3
REPEATED = 0  # the bucket of a word pair that is one word twice


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
CHUNK = 1 << 20
POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]  # of BASE and of its inverse, as far as they were needed


def powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(2 * n, base, dtype=U64)
            row[0] = 1
            POWERS[k] = np.cumprod(row, dtype=U64)
    return POWERS


def chunks(text: bytes):
    """The text in pieces of about a megabyte, cut at white space only."""
    start = 0
    while start < len(text):
        end = start + CHUNK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's words, their character n-grams (framed by a blank) and its word pairs, piece by piece."""
    last = np.empty(0, dtype=U64)
    for piece in chunks(text):
        raw = np.frombuffer(b" " + piece + b" ", dtype=np.uint8)
        blank = SPACE[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        x = np.where(blank, np.uint8(32), raw).astype(np.uint32)
        three = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
        inner = ~blank[1:-1]
        grams = [three[inner]]
        if len(x) > 3:
            grams.append((three[:-1] | (x[3:] << np.uint32(24)))[inner[:-1] & inner[1:]] ^ np.uint32(0x5BD1E995))
        # a word's hash from running sums over the piece: (sum of byte * base**place), brought back to place 0
        up, down = powers(len(raw))
        total = np.zeros(len(raw) + 1, dtype=U64)
        np.cumsum(BYTES[raw] * up[: len(raw)], dtype=U64, out=total[1:])
        words = mix((total[ends] - total[starts]) * down[starts])
        hashes = np.concatenate([last, words])
        last = words[-1:]
        first, second = hashes[:-1], hashes[1:]
        pairs = (mix(first * ODD[0] + second * ODD[1]) >> U64(64 - BUCKET_BITS)).astype(np.int64)
        yield np.concatenate([
            (words >> U64(64 - BUCKET_BITS)).astype(np.int64),
            *((g * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64) for g in grams),
            np.where(first == second, REPEATED, pairs),
        ])


@dataclass
class Model:
    logits: np.ndarray  # bucket x class: the vectors times the output layer

    def probabilities(self, summed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = summed / np.maximum(counts, 1)[:, None]
        e = np.exp(mean - mean.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[bytes, int]], classes: int = 2, seed: int = 7) -> Model:
    """Mean of the feature vectors, softmax, cross entropy; the rate falls linearly to zero."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((classes, DIMENSIONS), dtype=np.float32)
    bags = []
    for text, label in rows:
        found = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for part in features(text):
            found += np.bincount(part, minlength=1 << BUCKET_BITS)
        ids = np.flatnonzero(found).astype(np.int32)
        if len(ids):
            n = found[ids]
            bags.append((ids, (n / n.sum()).astype(np.float32), label))
    if len({label for _, _, label in bags}) < 2:
        return Model(np.zeros((1 << BUCKET_BITS, classes), dtype=np.float32))
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(bags)):
            ids, share, label = bags[k]
            rate = RATE * (1 - step / steps)
            mean = share @ vectors[ids]
            z = layer @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
            step += 1
    return Model((vectors @ layer.T).astype(np.float32))


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> list[tuple[bytes, int]]:
    """At most ``SAMPLE_ROWS`` rows of each class, the lowest by a hash of the id; texts that no longer fit are left out."""
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable)
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
    )
    order = F.xxhash64("doc_id", F.lit(10))
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * SAMPLE_ROWS pairs of numbers
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
        .withColumn("at", order).orderBy("at", "doc_id").select("text", "label")
    )
    rows, size, met = [], 0, set()
    for text, label in texts.toLocalIterator():
        data = (text or "").encode()
        met.add(label)
        if size + len(data) <= SAMPLE_BYTES:
            size += len(data)
            rows.append((data, label))
    if lacking := met - {label for _, label in rows}:
        warnings.warn(f"no text of class {sorted(lacking)} fits into {SAMPLE_BYTES} bytes", stacklevel=2)
    return rows


class Scorer:
    """Class probabilities of texts; a text's logits are summed against those of the first class."""

    def __init__(self, model: Model):
        self.model = model
        self.against = [np.ascontiguousarray(model.logits[:, k] - model.logits[:, 0]) for k in range(1, model.logits.shape[1])]

    def of(self, texts: list[bytes]) -> np.ndarray:
        sums, counts = np.zeros((len(texts), len(self.against) + 1)), np.zeros(len(texts), dtype=np.int64)
        for row, text in enumerate(texts):
            for found in features(text):
                counts[row] += len(found)
                for k, column in enumerate(self.against):
                    sums[row, k + 1] += column[found].sum(dtype=np.float64)
        return self.model.probabilities(sums, counts)


def score(docs: DataFrame, model: Model, target: int = 1) -> DataFrame:
    """(doc_id, score): the probability of class ``target``, one row per row of ``docs``."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            p = scorer.of([text for (text,) in rows_of(batch, "text")])[:, target]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learned from rows whose id has a remainder other than 0, as ``op10_quality_classifier`` says."""
    model = train(sample(docs, labels, remainder() != 0))
    trim()  # this process goes on to later steps
    return model


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text does not score below the threshold, with all their columns."""
    model = fit(docs, table(spark, sf_dir, "labels"))

    def keep(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.of([text for (text,) in rows_of(batch, "text")])[:, 1] >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
