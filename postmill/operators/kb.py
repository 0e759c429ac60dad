"""Knowledge base: parse skill files, hash, de-duplicate, chunk, embed, append."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import moment
from ..schemas import KB_ENTRIES, conform
from ..functions.text import lines, lstrip, strip, terms, words

# Fixed patterns of the skill-file format. The flag d keeps line ends to "\n" alone.
FUNCTION_HEADER = r"(?dm)^###\s+Function\s+\d+[:\s]+(.+)$"
TRIGGER = r"(?d)\*\*Trigger:\*\*\s*(.+)"
EXAMPLES = r"(?d)\*\*Examples?:\*\*\s*(.+)"
APPROVED = r"(?ds)\*\*Approved Language[^:]*:\*\*\s*(.*?)(?=\*\*Forbidden:|###|\z)"
EXAMPLE_BREAK = r"\"\s*/\s*\"|\s*/\s*"
QUOTES = "\"“”"


def with_file_meta(df: DataFrame, col: str = "filename") -> DataFrame:
    """Store, category and intent cluster from a skill file's name."""
    stem = F.replace(F.replace(F.col(col), F.lit("CANONICAL_skill_")), F.lit(".md"))
    store = F.when(stem.endswith("-us"), "us").when(stem.endswith("-intl"), "intl").otherwise("both")
    category = F.when(stem.endswith("-us") | stem.endswith("-intl"), F.regexp_replace(stem, "-(us|intl)$", "")).otherwise(stem)
    return (
        df.withColumn("store", store).withColumn("category", category)
        .withColumn("intent_cluster", F.substring_index("category", "-", 1))
    )


def _unquote(col: Column) -> Column:
    return strip(strip(strip(col), QUOTES))


def parse_kb(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per ``### Function N:`` block with approved language.

    Native array functions throughout; other columns of ``docs`` are carried along. The
    outer explode and the ``inline`` keep the optimizer from repeating the pattern work in
    filters below them.
    """
    text = F.col(text_col)
    titles = F.regexp_extract_all(text, F.lit(FUNCTION_HEADER), F.lit(1))
    bodies = F.split(text, FUNCTION_HEADER)
    carried = [c for c in docs.columns if c != text_col]
    blocks = (
        docs.select(*carried, titles.alias("_titles"), bodies.alias("_bodies"))
        .select(*carried, "_bodies", F.posexplode_outer("_titles").alias("position", "_title"))
        .select(*carried, "position", strip(F.col("_title")).alias("_name"),
                F.try_element_at("_bodies", F.col("position") + 2).alias("_body"))
    )
    body = F.col("_body")
    trigger = strip(F.regexp_replace(strip(F.regexp_extract(body, TRIGGER, 1)), r"\*+", ""))
    sections = F.regexp_extract_all(body, F.lit(APPROVED), F.lit(1))
    quoted = F.filter(
        # by a lambda: given as it is, ``strip`` would get a line's place for its second parameter, the characters to trim
        F.transform(F.flatten(F.transform(sections, lines)), lambda line: strip(line)), lambda line: line.startswith(">")  # noqa: PLW0108
    )
    approved = F.filter(
        F.transform(quoted, lambda line: _unquote(lstrip(line, ">"))), lambda line: line != ""
    )
    examples = F.filter(
        F.transform(F.split(strip(F.regexp_extract(body, EXAMPLES, 1)), EXAMPLE_BREAK), _unquote), lambda e: e != ""
    )
    parsed = F.struct(
        F.col("_name").alias("function_name"),
        F.when(body.rlike(TRIGGER), trigger).otherwise(F.col("_name")).alias("canonical_question"),
        F.array_join(approved, "\n").alias("canonical_answer"),
        examples.alias("question_variants"),
    )
    return blocks.select(*carried, "position", F.inline(F.array(parsed))).filter(F.col("canonical_answer") != "")


def content_hash(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat(strip(question), F.lit("|"), strip(answer)), 256)


def with_content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col("canonical_question"), F.col("canonical_answer")))


def existing_hashes(kb: DataFrame) -> DataFrame:
    """Known hashes. A failing scan fails here; it does not pass for an empty knowledge base."""
    return kb.select("content_hash").distinct()


def new_entries(entries: DataFrame, kb: DataFrame | None = None, dedup_batch: bool = True) -> DataFrame:
    """Entries whose hash is unknown; equal entries of one batch are kept once unless told otherwise."""
    if dedup_batch:
        order = [c for c in ("filename", "position") if c in entries.columns]
        rest = [c for c in entries.columns if c != "content_hash"]
        keep = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.min(F.struct(*rest))
        entries = entries.groupBy("content_hash").agg(keep.alias("_row")).select("_row.*", "content_hash")
    return entries if kb is None else entries.join(existing_hashes(kb), "content_hash", "left_anti")


def exact_duplicates(df: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    return df.groupBy(hash_col).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def chunk(df: DataFrame, text_col: str = "text", size: int = 300, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` after the one before.

    The last window ends with the text; a text of no words yields no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    n = F.size("_words")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return (
        df.withColumn("_words", words(F.col(text_col)))
        .filter(n > 0)
        .select(*[c for c in df.columns if c != text_col], "_words", F.posexplode(starts).alias("chunk_no", "_start"))
        .withColumn("chunk_text", F.array_join(F.slice("_words", F.col("_start") + 1, F.lit(size)), " "))
        .withColumn("n_words", F.least(F.lit(size), n - F.col("_start")))
        .drop("_words", "_start")
    )


EMBEDDING_MODEL = "hashed-tf"


def hashed_tf(df: DataFrame, text_col: str, out_col: str = "embedding", dims: int = 256) -> DataFrame:
    """Default embedding: hashed term frequencies of unit length, computed in the JVM."""
    tokens = df.withColumn("_terms", terms(F.col(text_col)))
    counted = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims).transform(tokens)
    scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return scaled.withColumn(out_col, vector_to_array("_unit")).drop("_terms", "_tf", "_unit")


def embed_with(
    df: DataFrame, text_col: str, embed: Callable[[list[str]], list], out_col: str = "embedding"
) -> DataFrame:
    """Caller's embedding: ``embed`` maps a batch of texts to vectors, inside Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = embed(pdf[text_col].tolist()) if len(pdf) else []
            yield pdf.assign(**{out_col: [list(map(float, v)) for v in vectors]})

    return df.mapInPandas(run, df.withColumn(out_col, F.lit(None).cast("array<double>")).schema)


def embed_missing(
    entries: DataFrame, cache: DataFrame, text_col: str = "canonical_question",
    embed: Callable[[list[str]], list] | None = None,
) -> DataFrame:
    """Vectors by content hash from ``cache`` (content_hash, embedding); only misses are computed."""
    known = cache.select("content_hash", F.col("embedding").cast("array<double>").alias("embedding"))
    hits = entries.join(known, "content_hash").withColumn("from_cache", F.lit(True))
    misses = entries.join(known.select("content_hash"), "content_hash", "left_anti")
    fresh = hashed_tf(misses, text_col) if embed is None else embed_with(misses, text_col, embed)
    return hits.unionByName(fresh.withColumn("from_cache", F.lit(False)))


def cache_status(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Whether each entry's vector is cached."""
    known = cache.select("content_hash").distinct().withColumn("_hit", F.lit(True))
    return (
        entries.join(known, "content_hash", "left")
        .withColumn("from_cache", F.coalesce("_hit", F.lit(False))).drop("_hit")
    )


def build_kb(
    docs: DataFrame, kb: DataFrame | None, as_of, embed: Callable[[list[str]], list] | None = None,
    model: str = EMBEDDING_MODEL,
) -> DataFrame:
    """Entries to append: parsed, hashed, new, embedded. Ids derive from the hash, so reruns agree."""
    parsed = with_content_hash(with_file_meta(parse_kb(docs)))
    fresh = new_entries(parsed, kb)
    embedded = hashed_tf(fresh, "canonical_question") if embed is None else embed_with(fresh, "canonical_question", embed)
    return conform(
        embedded.withColumn("kb_id", F.substring("content_hash", 1, 32))
        .withColumn("embedding_model", F.lit(model))
        .withColumn("created_at", moment(as_of)),
        KB_ENTRIES,
    )


def vectors_of_model(vectors: DataFrame, model: str) -> DataFrame:
    """One embedding model out of a long (kb_id, model, vector) table."""
    return vectors.filter(F.col("model") == model)
