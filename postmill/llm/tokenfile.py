"""Token ids in files with a shared dictionary.

Documents are dealt by ranges of their id, encoded, and each document's ids (little-endian 32-bit) are
compressed by itself with a zstandard dictionary that was trained on the ids of a bounded
sample. A file set is a folder with three tables:

``dictionary``  one row: sha256 of the dictionary and its bytes
``chunks``      part, chunk, the dictionary's sha256, the documents' ids, their places in the blob, their token counts,
                tokens of the part before the chunk, and the blob of compressed documents
``parts``       part, tokens of all parts before it

A single document is read from its chunk's index and one slice of the blob; its first token's place in the whole is the
part's, the chunk's and the index's count together. Files are written by Spark, so a lost task's output is written
again or not at all.

Behaviour: a null text is the empty one and has the end id alone; a null doc_id comes first; rows of one doc_id follow each other
in the order of a hash of their texts. An empty table gives empty tables. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import rows_of, table, work_path
from .registry import query

END = 1
LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
#: The dictionary is trained on so many documents, the lowest by a hash of the id, and so many bytes of text at most.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 8_000_000
CHUNK_BYTES = 4_000_000
PART_BYTES = 64_000_000  # text of a part, beyond the session's number of partitions
CACHED_WORDS = 400_000


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if it is printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(rest.get(b, b)) for b in range(256)]


LETTERS = byte_letters()
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())  # of ASCII
LATIN_END = chr(0x250)  # letters below are composed, and small ones of one letter


class WordIds(dict):
    """The ids of white-space separated words, as bytes; holds two generations of at most ``CACHED_WORDS`` words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids. It cuts a word
    into runs of letters and of signs and makes letters small, so a run of Latin letters goes straight to its byte-pair
    model, and the signs after it are known from other words; all other words take the whole way.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict = {}
        self.number = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.signs = {b"": b""}

    def whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def letters(self, word: bytes) -> bytes | None:
        """The ids of Latin letters and the signs after them; None for other words."""
        core = word.rstrip(SIGNS)
        tail = word[len(core) :]
        if core.isalpha():  # of bytes: letters of ASCII
            small = core.lower().decode()
        else:
            text = core.decode()
            small = text.lower()
            if not text.isalpha() or max(text) >= LATIN_END or max(small) >= LATIN_END:
                return None
            small = "".join([LETTERS[b] for b in small.encode()])
        return b"".join([self.number[t.id] for t in self.tokenizer.model.tokenize(small)]) + self.sign_ids(tail)

    def sign_ids(self, tail: bytes) -> bytes:
        found = self.signs.get(tail)
        if found is None:
            if len(self.signs) > CACHED_WORDS:
                self.signs = {b"": b""}
            found = self.signs[tail] = self.whole([tail.decode()])[0]
        return found

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not known."""
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        new = []
        for word in words:
            found = self.old.get(word)
            if found is None:
                found = self.letters(word)
            if found is None:
                new.append(word)
            else:
                self[word] = found
        self.update(zip(new, self.whole([w.decode() for w in new]), strict=True))

    def encode(self, text: bytes) -> bytes:
        """All ids of a text, and the end id."""
        parts = []
        words = text.split()
        for i in range(0, len(words), CACHED_WORDS):
            some = words[i : i + CACHED_WORDS]
            found = list(map(self.get, some))
            try:
                parts.append(b"".join(found))
            except TypeError:  # some are not known
                missing = {w for w, ids in zip(some, found, strict=True) if ids is None}
                self.learn(missing)
                parts.append(b"".join([self[w] if ids is None else ids for w, ids in zip(some, found, strict=True)]))
        return b"".join(parts) + END.to_bytes(4, "little")


ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One for each Python worker: words stay known from task to task."""
    if path not in ENCODERS:
        ENCODERS[path] = WordIds(path)
    return ENCODERS[path]


def learned_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    chosen = (
        docs.select("doc_id", "text").filter("text is not null").select("text", F.xxhash64("doc_id", F.lit(6)).alias("at"), "doc_id")
        .orderBy("at", "doc_id").limit(SAMPLE_DOCS).select("text")
    )
    samples, size = [], 0
    words = encoder(tokenizer)
    for (text,) in chosen.toLocalIterator():
        data = text.encode()
        if size + len(data) <= SAMPLE_BYTES:  # a text that does not fit is left out
            size += len(data)
            samples.append(words.encode(data))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve as the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


CHUNKS = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())),
    ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("before", pa.int64()), ("blob", pa.binary()),
])


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    spark = docs.sparkSession
    dictionary = learned_dictionary(docs, tokenizer)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, bytes binary").write.parquet(f"{path}/dictionary")

    def run(batches):
        from pyspark import TaskContext

        part, chunk, total, before = TaskContext.get().partitionId(), 0, 0, 0
        words, zstd = encoder(tokenizer), compressor(dictionary)
        ids, offsets, counts, frames, size = [], [], [], [], 0

        def flush():
            values = [part, chunk, name, ids, offsets, counts, before, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, CHUNKS.types, strict=True)], schema=CHUNKS)

        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                data = words.encode(text)
                frame = zstd.compress(data)
                ids.append(doc_id)
                offsets.append(size)
                counts.append(len(data) // 4)
                frames.append(frame)
                size += len(frame)
                total += len(data) // 4
                if size >= CHUNK_BYTES:
                    yield flush()
                    chunk, before = chunk + 1, total
                    ids, offsets, counts, frames, size = [], [], [], [], 0
        if ids:
            yield flush()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # the text's hash splits an id that many rows have
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = docs.select("doc_id", "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    dealt.mapInArrow(
        run, "part int, chunk int, dictionary string, doc_ids array<long>, offsets array<long>, n_tokens array<long>, before long, blob binary"
    ).write.option("compression", "none").parquet(f"{path}/chunks")
    # one row for each part
    sums = spark.read.parquet(f"{path}/chunks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start")).write.parquet(f"{path}/parts")


def stored_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    name, data = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError("the stored dictionary does not have its hash")
    return name, bytes(data)


def read_tokens(spark: SparkSession, path: str, columns: str, made) -> DataFrame:
    """(doc_id, start, n_tokens) and the columns that ``made`` gets from a document's ids, given as bytes.

    ``columns`` names one column with its type, as in a schema.
    """
    name, dictionary = stored_dictionary(spark, path)

    def run(batches):
        zstd = decompressor(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dictionary"] != name:
                    raise ValueError("a chunk was written with another dictionary")
                blob, at = memoryview(row["blob"]), [*row["offsets"], len(row["blob"])]
                found = [made(zstd.decompress(blob[a:b])) for a, b in zip(at, at[1:], strict=False)]
                counts = np.array(row["n_tokens"], dtype=np.int64)
                starts = row["before"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts), pa.array(found)],
                    ["part", "doc_id", "start", "n_tokens", columns.split()[0]],
                )

    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, {columns}")
    parts = spark.read.parquet(f"{path}/parts").withColumnRenamed("start", "_start")
    return chunks.join(parts, "part").select("doc_id", (F.col("start") + F.col("_start")).alias("start"), "n_tokens", columns.split()[0])


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document: its chunk is found by the index, and one slice of the blob is decompressed."""
    _, dictionary = stored_dictionary(spark, path)
    at = F.array_position("doc_ids", F.lit(doc_id).cast("long")).cast("int")
    offset = F.element_at("offsets", at)
    end = F.coalesce(F.get("offsets", at), F.length("blob"))
    found = spark.read.parquet(f"{path}/chunks").filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select(
        F.substring(F.col("blob"), (offset + 1).cast("int"), (end - offset).cast("int")).alias("frame")
    )
    return [np.frombuffer(decompressor(dictionary).decompress(bytes(x)), dtype="<u4") for (x,) in found.toLocalIterator()]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_tokens(spark, path, "ids_crc32 long", zlib.crc32)
