"""Queries over the knowledge base: parsing, hashing, chunks, retrieval, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import cluster as K, kb as B, retrieve as Q
from ..functions.text import terms
from ..operators.drafts import kb_mapping
from ..session import work_path, written
from ..sources.files import append_kb, folders, read_kb, read_vectors, rename, save_vectors, write_context
from . import views as V
from .catalog import query
from .oracle import embedded, text, with_tables

THRESHOLD = 0.36
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


ANSWER = r"""array_to_string(list_filter(list_transform(string_split(split_part(text, '###', 1), chr(10)),
            lambda l: regexp_replace(regexp_replace(regexp_replace(regexp_replace('> ' || l, '^\s*>+', ''), '^\s+|\s+$', '', 'g'),
                '^["“”]+|["“”]+$', '', 'g'), '^\s+|\s+$', '', 'g')),
            lambda l: l <> ''), chr(10))"""


def skill_files(spark: SparkSession, d: str, source=V.read) -> DataFrame:
    """A skill file around each document: one answered function and one stub."""
    quoted = F.regexp_replace("text", "(?m)^", "> ")
    return source(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("CANONICAL_skill_"), F.col("source"), F.lit("-claim-"),
                 F.when(F.col("lang") == "en", "us").otherwise("intl"), F.lit(".md")).alias("filename"),
        F.concat(
            F.lit("# Preamble\n### Function 1: Policy of "), F.col("lang"),
            F.lit("\n**Trigger:** asks about **"), F.col("source"), F.lit('**\n**Examples:** "is it '), F.col("lang"),
            F.lit('" / “what is it”\n**Approved Language:**\n'), quoted,
            F.lit('\n**Forbidden:**\n> "never"\n### Function 2: Stub\nNothing approved.\n')).alias("text"))


@query(f"""
    SELECT doc_id, 'Policy of ' || lang AS function_name, 'asks about ' || source AS canonical_question,
        md5({ANSWER}) AS answer,
        'is it ' || lang || '|what is it' AS variants,
        CASE WHEN lang = 'en' THEN 'us' ELSE 'intl' END AS store, source || '-claim' AS category, source AS intent_cluster
    FROM documents WHERE {ANSWER} <> ''""")
def parse_kb(spark: SparkSession, d: str) -> DataFrame:
    return B.with_file_meta(B.parse_kb(skill_files(spark, d))).select(
        "doc_id", "function_name", "canonical_question", F.md5("canonical_answer").alias("answer"),
        F.array_join("question_variants", "|").alias("variants"), "store", "category", "intent_cluster")


@query(with_tables("SELECT doc_id, content_hash FROM hashed_articles", "hashed_articles"))
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.hashed_articles(spark, d).select("doc_id", "content_hash")


KNOWN = "SELECT content_hash FROM hashed_articles JOIN labels USING (doc_id)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    labelled = V.read(spark, d, "labels").select("doc_id")
    return V.hashed_articles(spark, d).join(labelled, "doc_id", "left_semi")


@query(with_tables("SELECT DISTINCT content_hash FROM known", "hashed_articles", extra={"known": KNOWN}))
def existing_hashes(spark: SparkSession, d: str) -> DataFrame:
    return B.existing_hashes(_known(spark, d))


@query(with_tables("""
    SELECT content_hash, arg_min(doc_id, (filename, position)) AS doc_id FROM hashed_articles
    WHERE content_hash NOT IN (SELECT content_hash FROM known) GROUP BY 1""", "hashed_articles", extra={"known": KNOWN}))
def new_entries(spark: SparkSession, d: str) -> DataFrame:
    return B.new_entries(V.hashed_articles(spark, d), _known(spark, d)).select("content_hash", "doc_id")


@query(with_tables("SELECT content_hash, count(*) AS copies FROM hashed_articles GROUP BY 1 HAVING count(*) > 1", "hashed_articles"))
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return B.exact_duplicates(V.hashed_articles(spark, d))


@query(with_tables("""
    SELECT doc_id, content_hash IN (SELECT content_hash FROM known) AS from_cache FROM hashed_articles""",
    "hashed_articles", extra={"known": KNOWN}))
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    return B.cache_status(V.hashed_articles(spark, d), _known(spark, d)).select("doc_id", "from_cache")


def digest(vector: str = "embedding"):
    """The values of a vector, each times its place from 1, added up: two vectors that differ hardly ever agree in it."""
    places = F.transform(vector, lambda v, i: v.cast("double") * (i + 1))
    return F.round(F.aggregate(places, F.lit(0.0), lambda a, v: a + v), 6).alias("digest")


@query(with_tables("""
    SELECT doc_id, content_hash IN (SELECT content_hash FROM known) AS from_cache,
           CASE WHEN content_hash IN (SELECT content_hash FROM known) THEN 2.2 ELSE coalesce(digest, 0) END AS digest
    FROM hashed_articles LEFT JOIN digests USING (doc_id)""", "hashed_articles", extra={"known": KNOWN, **embedded("documents", "doc_id", "text", WORDS)}))
def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Labelled articles have a stored vector; only the others are embedded."""
    stored = B.existing_hashes(_known(spark, d)).withColumn("embedding", F.array(F.lit(0.6), F.lit(0.8)))
    rows = B.embed_missing(V.hashed_articles(spark, d), stored, "canonical_answer")
    return rows.select("doc_id", "from_cache", digest())


@query(r"""
    SELECT doc_id, CAST(start // 250 AS INTEGER) AS chunk_no, CAST(least(300, len(w) - start) AS INTEGER) AS n_words,
           md5(array_to_string(w[start + 1 : start + 300], ' ')) AS digest
    FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50 - 1, 0) + 1, 250)) AS start
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
          WHERE len(w) > 0)""")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = B.chunk(V.read(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_no", "n_words", F.md5("chunk_text").alias("digest"))


@query(with_tables(f"""
    SELECT doc_id, 256 AS dims, CAST(len({WORDS}) AS INTEGER) AS n_terms, coalesce(digest, 0) AS digest
    FROM documents LEFT JOIN digests USING (doc_id)""", extra=embedded("documents", "doc_id", "text", WORDS)))
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Default embedding of every document, by its values."""
    rows = B.hashed_tf(V.read(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.size(terms(F.col("text"))).alias("n_terms"), digest())


BUILT = with_tables("""
    SELECT DISTINCT content_hash, source || '-claim' AS category, digest FROM built_rows JOIN digests USING (source)""",
    extra={
        "built_rows": f"SELECT source, 'asks about ' || source AS question, sha256('asks about ' || source || '|' || {ANSWER}) AS content_hash "
                      f"FROM documents WHERE {ANSWER} <> ''",
        **embedded("(SELECT DISTINCT source, question FROM built_rows)", "source", "question", WORDS),
    })


@query(BUILT)
def kb_build(spark: SparkSession, d: str) -> DataFrame:
    """Whole build over skill files made of the documents; ids come from hashes."""
    return B.build_kb(skill_files(spark, d), None, V.MAIL_NOW).select("content_hash", "category", digest())


@query(BUILT)
def kb_append(spark: SparkSession, d: str) -> DataFrame:
    """Built from half of the files, appended, and built on with all of them: only new entries are appended."""
    path, files = work_path(spark, "kb"), skill_files(spark, d)
    append_kb(B.build_kb(files.filter(F.col("doc_id") % 2 == 0), None, V.MAIL_NOW), path)
    append_kb(written(B.build_kb(files, spark.read.parquet(path), V.MAIL_NOW), "more"), path)
    return spark.read.parquet(path).select("content_hash", "category", digest())


FILES = """
    SELECT 'CANONICAL_skill_' || source || '-' || lang || '.md' AS filename, count(*) || ' documents of ' || sum(length(text)) || ' letters from '
        || min(md5(text)) || ' to ' || max(md5(text)) AS text
    FROM documents GROUP BY 1"""


def _kb_folder(spark: SparkSession, d: str) -> str:
    """A folder with a skill file for each source and language, which says what their documents come to, and a file that is none."""
    docs = V.read(spark, d, "documents")
    name = F.concat(F.lit("CANONICAL_skill_"), F.col("source"), F.lit("-"), F.col("lang"), F.lit(".md"))
    files = docs.groupBy(name.alias("filename")).agg(V.summary("text").alias("value"))
    files = files.unionByName(docs.agg(F.lit("README.md").alias("filename"), F.max("lang").alias("value")))
    path = work_path(spark, "kb-files")
    # Spark writes a folder for each name with one file of one row in it, which then gets the name
    files.repartition("filename").write.partitionBy("filename").text(f"{path}/parts")
    for folder in folders(spark, f"{path}/parts"):
        for part in folders(spark, f"{path}/parts/{folder}") if folder.startswith("filename=") else ():
            if part.startswith("part-"):
                rename(spark, f"{path}/parts/{folder}/{part}", f"{path}/files/{folder.removeprefix('filename=')}")
    return f"{path}/files"


@query(with_tables("SELECT filename, md5(text || chr(10)) AS digest FROM files", extra={"files": FILES}))
def kb_files(spark: SparkSession, d: str) -> DataFrame:
    """Skill files written below the shared folder and read whole; other files are not read."""
    return read_kb(spark, _kb_folder(spark, d)).select("filename", F.md5("text").alias("digest"))


@query(with_tables("SELECT filename, CAST(row_number() OVER (ORDER BY filename) AS INTEGER) AS page FROM files", extra={"files": FILES}))
def kb_files_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each file in the ordered scan, whose rows are numbered as they come."""
    files = read_kb(spark, _kb_folder(spark, d), ordered=True).select("filename", F.monotonically_increasing_id().alias("at"))
    return written(files, "pages").select("filename", F.row_number().over(Window.orderBy("at")).alias("page"))


@query("""
    SELECT vec_id AS kb_id, 64 AS dims,
        round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[65 - i] AS DOUBLE) * -2 * i)), 6) AS digest FROM embeddings""")
def vectors_of_model(spark: SparkSession, d: str) -> DataFrame:
    """Two models with different vectors, stored by model; one is read."""
    v = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("kb_id"), F.col("embedding").cast("array<double>").alias("vector"))
    other = v.withColumn("vector", F.transform(F.reverse("vector"), lambda x: x * -2))
    path = work_path(spark, "vectors")
    save_vectors(v.withColumn("model", F.lit("given")).unionByName(other.withColumn("model", F.lit("other"))), path)
    return B.vectors_of_model(read_vectors(spark, path), "other").select("kb_id", F.size("vector").alias("dims"), digest("vector"))


COSINES = """
    SELECT a.kb_id AS query_id, b.kb_id, round(coalesce(list_cosine_similarity(a.vector, b.vector), 0), 6) AS score
    FROM entries a JOIN entries b ON a.category = b.category AND a.kb_id <> b.kb_id"""
NEAREST = """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id) AS rank FROM cosines"""
COS = {"cosines": COSINES, "nearest": NEAREST}


@query(with_tables("SELECT query_id, kb_id, score, CAST(rank AS INTEGER) AS rank FROM nearest WHERE rank <= 3", "entries", extra=COS))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    kb = V.entries(spark, d)
    return Q.cosine_topk(V.as_queries(kb), kb, exclude_self=True)


def bm25_sql(kb: str, queries: str, self_join: bool) -> dict[str, str]:
    return {
        "docs": f"SELECT kb_id, category, {WORDS} AS w FROM {kb}",
        "size": "SELECT category, count(*) AS n, avg(len(w)) AS avg_len FROM docs GROUP BY 1",
        "tf": "SELECT category, kb_id, term, count(*) AS tf, max(l) AS l FROM "
              "(SELECT category, kb_id, unnest(w) AS term, len(w) AS l FROM docs) GROUP BY 1, 2, 3",
        "df": "SELECT category, term, count(*) AS df FROM tf GROUP BY 1, 2",
        "weights": "SELECT category, kb_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 "
                   "/ (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) AS weight "
                   "FROM tf JOIN df USING (category, term) JOIN size USING (category)",
        "asked": f"SELECT DISTINCT query_id, category, unnest({WORDS}) AS term FROM {queries}",
        "keywords": "SELECT query_id, kb_id, round(sum(weight), 6) AS score FROM asked JOIN weights USING (category, term) "
                    + ("WHERE query_id <> kb_id " if self_join else "") + "GROUP BY 1, 2",
        "listed": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id) AS rank "
                  "FROM keywords WHERE score > 0",
    }


@query(with_tables("SELECT query_id, kb_id, score, CAST(rank AS INTEGER) AS rank FROM listed WHERE rank <= 3",
                   "articles", "questions", extra=bm25_sql("articles", "questions", False)))
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return Q.bm25(V.questions(spark, d), V.articles(spark, d))


HYBRID = {
    **COS,
    **bm25_sql("entries", "(SELECT kb_id AS query_id, category, text FROM entries)", True),
    "fused": """
        SELECT query_id, kb_id, n.rank AS semantic_rank, l.rank AS keyword_rank,
               round(0.7 / (60 + n.rank) + coalesce(0.3 / (60 + l.rank), 0), 8) AS score
        FROM nearest n LEFT JOIN listed l USING (query_id, kb_id)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id) AS rank FROM fused",
}
HYBRID_SQL = with_tables(
    "SELECT query_id, kb_id, semantic_rank, keyword_rank, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3", "entries", extra=HYBRID)


@query(HYBRID_SQL)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    kb = V.entries(spark, d)
    return Q.hybrid_topk(V.as_queries(kb), kb, exclude_self=True).drop("best_cosine")


@query(with_tables("""
    SELECT query_id, kb_id, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT query_id, kb_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb_id) AS rank FROM (
            SELECT query_id, kb_id, round(coalesce(0.7 / (60 + n.rank), 0) + coalesce(0.3 / (60 + l.rank), 0), 8) AS score
            FROM (SELECT * FROM nearest WHERE rank <= 3) n
            FULL OUTER JOIN (SELECT * FROM listed WHERE rank <= 3) l USING (query_id, kb_id)))
    WHERE rank <= 3""", "entries", extra=HYBRID))
def fused_lists(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two given top-3 lists."""
    kb = V.entries(spark, d)
    asked = V.as_queries(kb)
    near, listed = Q.cosine_topk(asked, kb, exclude_self=True), Q.bm25(asked, kb, exclude_self=True)
    return Q.rrf(near, listed, k=3).select("query_id", "kb_id", "score", "rank")


EDGES = "SELECT DISTINCT concept, related FROM (" + " UNION ALL ".join(
    f"SELECT {text(a)} AS concept, {text(b)} AS related UNION ALL SELECT {text(b)}, {text(a)}"
    for a, b, _, _ in V.GRAPH_PAIRS) + ")"

def rescue(asked: str) -> dict[str, str]:
    """The rescue in steps; ``asked`` names the table of query terms."""
    return {
        "edges": EDGES,
        "poor": "SELECT kb_id AS query_id, category, text FROM entries WHERE kb_id NOT IN "
                "(SELECT query_id FROM nearest WHERE rank = 1 AND score >= 0.3)",
        asked: f"SELECT DISTINCT query_id, category, unnest({WORDS}) AS concept FROM poor",
        "holders": f"SELECT category, kb_id, related, count(*) AS mentions FROM "
                   f"(SELECT category, kb_id, unnest({WORDS}) AS related FROM entries) "
                   "WHERE related IN (SELECT related FROM edges) GROUP BY 1, 2, 3",
        "found": f"SELECT query_id, kb_id, max(mentions) AS mentions FROM {asked} JOIN edges USING (concept) "
                 "JOIN holders USING (category, related) WHERE query_id <> kb_id GROUP BY 1, 2",
        "rescued": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mentions DESC, kb_id) AS rank FROM found",
    }


@query(with_tables("SELECT query_id, kb_id, mentions, CAST(rank AS INTEGER) AS rank FROM rescued WHERE rank <= 3", "entries", extra={**COS, **rescue("mentioned")}))
def graph_rescue(spark: SparkSession, d: str) -> DataFrame:
    kb = V.entries(spark, d)
    asked = V.as_queries(kb)
    pairs = spark.createDataFrame(V.GRAPH_PAIRS, "concept_a string, concept_b string, relationship_type string, notes string")
    nearest = Q.cosine_topk(asked, kb, 1, exclude_self=True)
    return Q.graph_rescue(asked, kb, nearest, pairs, 0.3, exclude_self=True).select("query_id", "kb_id", "mentions", "rank")


@query(with_tables("""
    SELECT query_id, kb_id, CAST(NULL AS VARCHAR) AS filename, CAST(rank AS INTEGER) AS rank, 'graph' AS via FROM rescued WHERE rank <= 3
    UNION ALL SELECT query_id, kb_id, NULL, CAST(rank AS INTEGER), 'hybrid' FROM ranked
    WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM rescued)
    UNION ALL SELECT query_id, NULL, CASE WHEN query_id % 2 = 0 THEN 'CANONICAL_skill_order-shipping-us.md' END, 1,
        CASE WHEN query_id % 2 = 0 THEN 'mapping' ELSE 'none' END
    FROM (SELECT kb_id AS query_id FROM entries UNION ALL SELECT -1 UNION ALL SELECT -2)
    WHERE query_id NOT IN (SELECT query_id FROM rescued) AND query_id NOT IN (SELECT query_id FROM ranked)""",
    "entries", extra={**HYBRID, **rescue("mentioned")}))
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """All entries as queries, and two of a category without entries; even ids have a file."""
    kb = V.entries(spark, d)
    pairs = spark.createDataFrame(V.GRAPH_PAIRS, "concept_a string, concept_b string, relationship_type string, notes string")
    lost = spark.createDataFrame([(-1, -1, "", None), (-2, -1, None, None)], V.as_queries(kb).schema)
    asked = V.as_queries(kb).unionByName(lost)
    tagged = asked.select("query_id", V.pick(F.abs("query_id"), ("US_WISMO", "GENERAL_PRODUCT")).alias("tag"))
    mapping = tagged.join(kb_mapping(spark), "tag").select("query_id", "filename")
    return Q.retrieve(asked, kb, graph=pairs, min_score=0.3, exclude_self=True, mapping=mapping)


@query(with_tables("""
    SELECT query_id, kb_id, CAST(NULL AS VARCHAR) AS filename, CAST(rank AS INTEGER) AS rank, 'retrieval' AS via FROM nearest
    WHERE rank = 1 AND score >= 0.3
    UNION ALL SELECT kb_id, NULL, CASE WHEN kb_id % 2 = 0 THEN 'CANONICAL_skill_order-shipping-us.md'
        ELSE 'CANONICAL_skill_return-processing-intl.md' END, 1, 'mapping' FROM entries
    WHERE kb_id NOT IN (SELECT query_id FROM nearest WHERE rank = 1 AND score >= 0.3)""", "entries", extra=COS))
def mapping_fallback(spark: SparkSession, d: str) -> DataFrame:
    kb = V.entries(spark, d)
    asked = V.as_queries(kb)
    hits = Q.cosine_topk(asked, kb, 1, exclude_self=True).filter(F.col("score") >= 0.3)
    tagged = asked.select("query_id", V.pick(F.col("query_id"), ("US_WISMO", "LIFESTYLE_RETURN")).alias("tag"))
    mapped = tagged.join(kb_mapping(spark), "tag").select("query_id", "filename")
    return Q.with_fallback(asked, hits, mapped)


@query(with_tables("""
    SELECT query_id, array_to_string(list(kb_id ORDER BY rank), ',') AS matches FROM nearest WHERE rank <= 3 GROUP BY 1""",
    "entries", extra=COS))
def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    kb = V.entries(spark, d)
    rows = Q.context_rows(Q.cosine_topk(V.as_queries(kb), kb, exclude_self=True))
    return rows.select("query_id", F.array_join(F.col("matches.kb_id").cast("array<string>"), ",").alias("matches"))


@query(with_tables("""
    SELECT query_id, kb_id, CAST(rank AS BIGINT) AS rank FROM nearest WHERE rank <= 3""", "entries", extra=COS))
def context_files(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval context written as JSON and read back."""
    kb = V.entries(spark, d)
    path = work_path(spark, "context")
    write_context(Q.context_rows(Q.cosine_topk(V.as_queries(kb), kb, exclude_self=True)), path)
    rows = spark.read.schema("query_id long, matches array<struct<rank: long, kb_id: long>>").json(path)
    return rows.select("query_id", F.inline("matches")).select("query_id", "kb_id", "rank")


@query("""
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity,
           list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.1 AS semantic_match
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic_match(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vectors import cosine

    v = V.read(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("sent_vector"))
    pairs = v.select("vec_id", F.col("embedding").alias("draft_vector")).join(after, "vec_id")
    return Q.semantic_match(pairs, "draft_vector", "sent_vector", 0.1).select(
        "vec_id", F.round(cosine(F.col("draft_vector"), F.col("sent_vector")), 6).alias("similarity"), "semantic_match")


CLUSTERED = """
    SELECT node AS kb_id, min(other) AS cluster FROM reach GROUP BY 1"""


def cluster_sql(body: str, **extra: str) -> str:
    links = f"SELECT query_id AS a, kb_id AS b FROM cosines WHERE score >= {THRESHOLD}"
    reach = (
        "SELECT kb_id AS node, kb_id AS other FROM entries UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other"
    )
    return with_tables(
        body, "entries", extra={"cosines": COSINES, "links": links, "reach": reach, "clustered": CLUSTERED, **extra}
    ).replace("WITH ", "WITH RECURSIVE ", 1)


TERMS = f"""
    SELECT cluster, term, count(*) AS n
    FROM (SELECT cluster, unnest({WORDS}) AS term FROM entries JOIN clustered USING (kb_id)) GROUP BY 1, 2"""
PROFILED = """
    SELECT cluster, CAST(sum(n) AS BIGINT) AS words, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy,
           (list(term ORDER BY n DESC, term))[1] AS dominant FROM termed GROUP BY 1"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.cluster(V.entries(spark, d), THRESHOLD)


def _clustered_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same as a written table of what the operators on clusters read, some of them more than once."""
    return written(_clusters(spark, d).select("kb_id", "cluster", "text"), "clustered")


@query(cluster_sql("SELECT kb_id, cluster FROM clustered"))
def similarity_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("kb_id", "cluster")


@query(cluster_sql("SELECT cluster, words, entropy, dominant FROM profiled", termed=TERMS, profiled=PROFILED))
def term_profile(spark: SparkSession, d: str) -> DataFrame:
    return K.term_profile(_clusters(spark, d))


CANONICAL = f"""
    SELECT cluster, (list(kb_id ORDER BY uses DESC, kb_id))[1] AS canonical_id, count(*) AS members FROM (
        SELECT cluster, kb_id, len(list_filter({WORDS}, lambda t: t = dominant)) AS uses
        FROM entries JOIN clustered USING (kb_id) JOIN profiled USING (cluster)) GROUP BY 1"""


@query(cluster_sql("SELECT * FROM canonical", termed=TERMS, profiled=PROFILED, canonical=CANONICAL))
def canonical_entries(spark: SparkSession, d: str) -> DataFrame:
    return K.canonicalise(_clustered_texts(spark, d)).select("cluster", "canonical_id", "members")


@query(cluster_sql("""
    SELECT cluster, count(DISTINCT md5(text)) AS variants, min(md5(text)) AS least
    FROM entries JOIN clustered USING (kb_id) WHERE kb_id NOT IN (SELECT canonical_id FROM canonical) GROUP BY 1""",
    termed=TERMS, profiled=PROFILED, canonical=CANONICAL))
def cluster_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = _clustered_texts(spark, d).withColumn("question", F.md5("text"))
    arrays = K.variant_arrays(K.variants(rows, K.canonicalise(rows), "question"))
    return arrays.groupBy("cluster").agg(
        F.sum(F.size("question_variants")).alias("variants"), F.min(F.array_min("question_variants")).alias("least"))
