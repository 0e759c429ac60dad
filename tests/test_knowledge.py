import hashlib
import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from postmill.operators import blocks, cluster as K, kb as B, retrieve as Q
from postmill.sources.files import append_kb

NOW = datetime(2024, 3, 8, 12)
SAMPLE = """# Preamble is ignored
### Function 1: Policy Explanation
**Trigger:** customer asks about **coverage**
**Examples:** "is it covered" / "what is covered"
**Approved Language:**
> "Coverage is 12 months."
**Forbidden:**
> "forever"
### Function 2: Escalation stub
No approved language here.
"""


def test_parse_sample(spark):
    docs = spark.createDataFrame([("CANONICAL_skill_warranty-claim-us.md", SAMPLE), ("CANONICAL_skill_x.md", "nothing")], "filename string, text string")
    rows = B.with_file_meta(B.parse_kb(docs)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["function_name"], r["canonical_question"], r["canonical_answer"]) == (
        "Policy Explanation", "customer asks about coverage", "Coverage is 12 months.")
    assert r["question_variants"] == ["is it covered", "what is covered"]
    assert (r["store"], r["category"], r["intent_cluster"]) == ("us", "warranty-claim", "warranty")


def test_parse_more(spark):
    text = ("### Function 1: First\n**Approved Language (email):**\n> “one s.”\nplain\n> > two\n**Forbidden:** x\n"
            "**Approved Language:** \n> three\n### Function 2:  Second \n**Example:** a/b / \"c\"\n**Trigger:**\n"
            "**Approved Language:**\n> only")
    rows = B.parse_kb(spark.createDataFrame([("f", text)], "filename string, text string")).orderBy("position").collect()
    assert [r["canonical_answer"] for r in rows] == ["one s.\n> two\nthree", "only"]
    assert rows[0]["canonical_question"] == "First" and rows[0]["question_variants"] == []
    assert rows[1]["question_variants"] == ["a", "b", "c"] and rows[1]["function_name"] == "Second"


def test_lines_lose_white_space_and_nothing_else(spark):
    text = "### Function 1: First\n**Approved Language:**\n> call 10\n \t> or 171\n> at 12\xa0\nnot > this\n**Forbidden:**\n> never\n"
    rows = B.parse_kb(spark.createDataFrame([("f", text)], "filename string, text string")).collect()
    assert [r["canonical_answer"] for r in rows] == ["call 10\nor 171\nat 12"]


def test_appended_base_tells_answers_by_their_last_digit(spark, tmp_path):
    text = "### Function 1: First\n**Approved Language:**\n> dial {}\n"
    docs = [(n, "CANONICAL_skill_order-us.md", text.format(n)) for n in (10, 1, 100)]
    files, path = spark.createDataFrame(docs, "doc_id long, filename string, text string"), str(tmp_path / "kb")
    append_kb(B.build_kb(files.filter("doc_id % 2 = 0"), None, NOW), path)
    append_kb(B.build_kb(files, spark.read.parquet(path), NOW).localCheckpoint(), path)
    got = sorted(r["content_hash"] for r in spark.read.parquet(path).collect())
    assert got == sorted(hashlib.sha256(f"First|dial {n}".encode()).hexdigest() for n in (1, 10, 100))


def test_file_names(spark):
    names = ["CANONICAL_skill_order-shipping-intl.md", "CANONICAL_skill_chargeback-disputes.md", "CANONICAL_skill_warranty-claim-us.md"]
    got = B.with_file_meta(spark.createDataFrame([(n,) for n in names], "filename string")).collect()
    assert [(r["store"], r["category"], r["intent_cluster"]) for r in got] == [
        ("intl", "order-shipping", "order"), ("both", "chargeback-disputes", "chargeback"), ("us", "warranty-claim", "warranty")]


def test_build_is_incremental(spark):
    docs = spark.createDataFrame([("CANONICAL_skill_a-us.md", SAMPLE), ("CANONICAL_skill_b-us.md", SAMPLE)], "filename string, text string")
    first = B.build_kb(docs, None, NOW).cache()
    assert first.count() == 1
    row = first.first()
    assert row["filename"] == "CANONICAL_skill_a-us.md"
    assert row["content_hash"] == hashlib.sha256(b"customer asks about coverage|Coverage is 12 months.").hexdigest()
    assert abs(sum(v * v for v in row["embedding"]) - 1) < 1e-9
    assert B.build_kb(docs, first, NOW).count() == 0
    own = B.build_kb(docs, None, NOW, embed=lambda texts: [[len(t), 1] for t in texts])
    assert own.first()["embedding"] == [28.0, 1.0]
    batch = B.with_content_hash(B.parse_kb(docs))
    assert B.new_entries(batch, dedup_batch=False).count() == 2


def test_embedding_cache(spark):
    entries = spark.createDataFrame([("h1", "a b"), ("h2", "c")], "content_hash string, canonical_question string")
    cache = spark.createDataFrame([("h1", [9.0])], "content_hash string, embedding array<double>")
    got = {r["content_hash"]: (r["from_cache"], r["embedding"]) for r in B.embed_missing(entries, cache, embed=lambda t: [[float(len(x))] for x in t]).collect()}
    assert got == {"h1": (True, [9.0]), "h2": (False, [1.0])}


def test_chunk_edges(spark):
    sizes = [0, 1, 299, 300, 301, 550, 551, 1000]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "n int, text string")
    got = {}
    for r in B.chunk(df).orderBy("n", "chunk_no").collect():
        got.setdefault(r["n"], []).append(r["chunk_text"].split())
    for n in sizes:
        words = [f"w{i}" for i in range(n)]
        want, start = [], 0
        while n and (start == 0 or start + 50 < n):
            want.append(words[start:start + 300])
            start += 250
        assert got.get(n, []) == want


def corpus(n=90, seed=3, cats=3):
    """Entries with a hot category (over half of them), near copies and a zero vector."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(n):
        vector = rng.normal(size=6)
        if i % 4 == 0 and i >= 8:
            vector = np.array(rows[i - 8][3]) + rng.normal(size=6) * 0.05
        text = " ".join(rng.choice(words, size=rng.integers(0, 12)))
        rows.append((i, "hot" if i % 5 < 3 else f"c{i % cats}", text, [float(x) for x in vector]))
    rows[7] = (7, rows[7][1], "", [0.0] * 6)
    rows[10] = (*rows[9][:0], 10, rows[10][1], rows[9][2], rows[9][3])
    return rows


def brute(rows):
    """Full cosine and BM25 lists of every entry against its category, without itself."""
    lists = {}
    for cat in {r[1] for r in rows}:
        group = [r for r in rows if r[1] == cat]
        avg = sum(len(r[2].split()) for r in group) / len(group)
        df = {}
        for r in group:
            for t in set(r[2].split()):
                df[t] = df.get(t, 0) + 1
        for q in group:
            near, keyword = [], []
            for e in group:
                if e[0] == q[0]:
                    continue
                a, b = np.array(q[3]), np.array(e[3])
                length = np.linalg.norm(a) * np.linalg.norm(b)
                near.append((-round(float(a @ b / length), 6) if length else -0.0, e[0]))
                tokens = e[2].split()
                s = 0.0
                for t in set(q[2].split()) & set(tokens):
                    idf = math.log1p((len(group) - df[t] + 0.5) / (df[t] + 0.5))
                    tf = tokens.count(t)
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens) / avg))
                if s > 0:
                    keyword.append((-round(s, 6), e[0]))
            lists[q[0]] = ([e for _, e in sorted(near)], [e for _, e in sorted(keyword)])
    return lists


def frames(spark, rows):
    kb = spark.createDataFrame(rows, "kb_id long, category string, text string, vector array<double>")
    return kb.withColumnRenamed("kb_id", "query_id"), kb


def listed(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["kb_id"])
    return got


def test_topk_over_many_blocks_equals_brute_force(spark):
    rows = corpus()
    queries, kb = frames(spark, rows)
    lists = brute(rows)
    near = listed(Q.cosine_topk(queries, kb, 3, exclude_self=True, cell=5, unit_rows=7))
    assert near == {q: near_list[:3] for q, (near_list, _) in lists.items()}
    keyword = listed(Q.bm25(queries, kb, 3, exclude_self=True, block=5, unit_rows=7))
    assert keyword == {q: k[:3] for q, (_, k) in lists.items() if k}


def fused(lists, k, wa=0.7, wb=0.3):
    want = {}
    for q, (near, keyword) in lists.items():
        place = {e: i for i, e in enumerate(keyword, 1)}
        scores = [(-round(wa / (60 + i) + (wb / (60 + place[e]) if e in place else 0.0), 8), e) for i, e in enumerate(near, 1)]
        want[q] = [e for _, e in sorted(scores)[:k]]
    return want


def test_hybrid_is_exact_in_one_block_and_in_many(spark):
    rows = corpus()
    queries, kb = frames(spark, rows)
    want = fused(brute(rows), 3)
    assert listed(Q.hybrid_topk(queries, kb, 3, exclude_self=True)) == want
    assert listed(Q.hybrid_topk(queries, kb, 3, exclude_self=True, cell=6, block=6, unit_rows=11)) == want


def test_hybrid_stays_exact_where_the_category_is_deeper_than_the_lists(spark):
    """200 entries of one category against a list depth of 30: deep places come from counting."""
    rows = [(i, "hot", t, v) for i, _, t, v in corpus(200, seed=8)]
    queries, kb = frames(spark, rows)
    assert Q.fusion_depth(3) == 30
    want = fused(brute(rows), 3)
    assert listed(Q.hybrid_topk(queries, kb, 3, exclude_self=True, cell=64, block=64)) == want


def test_fusion_of_given_lists(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, kb_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, kb_id long, rank int")
    got = Q.rrf(a, b, k=3).orderBy("rank").collect()
    assert [(r["kb_id"], r["score"]) for r in got] == [
        (11, round(0.7 / 62 + 0.3 / 61, 8)), (10, round(0.7 / 61, 8)), (12, round(0.3 / 62, 8))]


def components(rows, t):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = np.array(a[3]), np.array(b[3])
            length = np.linalg.norm(x) * np.linalg.norm(y)
            if a[1] == b[1] and length and round(float(x @ y / length), 6) >= t:
                ra, rb = sorted((root(a[0]), root(b[0])))
                parent[rb] = ra
    return {r[0]: root(r[0]) for r in rows}


def test_clusters_equal_brute_force_in_any_blocking(spark):
    rows = corpus()
    _, kb = frames(spark, rows)
    want = components(rows, 0.9)
    assert len(set(want.values())) < len(rows)
    for block_rows in (1024, 6):
        got = {r["kb_id"]: r["cluster"] for r in K.cluster(kb, 0.9, block_rows).collect()}
        assert got == want


def test_cells_skip_far_pairs_and_lose_no_link(spark):
    """Six tight groups in one category of many blocks: distant cells are not compared, the clusters stay exact."""
    rng = np.random.default_rng(5)
    centres = np.eye(6) * 3
    rows = [(i, "c", "", [float(x) for x in centres[i % 6] + rng.normal(size=6) * 0.35]) for i in range(120)]
    _, kb = frames(spark, rows)
    _, units = K._cells(kb.select("category", "vector", "kb_id"), 0.97, 10)
    cells = {(r["_cell"], r["_block"]) for r in units.collect()} | {(r["_other"], r["_other_block"]) for r in units.collect()}
    assert units.count() < len(cells) * (len(cells) + 1) // 2
    got = {r["kb_id"]: r["cluster"] for r in K.cluster(kb, 0.97, 10).collect()}
    want = components(rows, 0.97)
    assert got == want and 6 < len(set(want.values())) < 120


def test_copies_give_linear_links(spark):
    """400 copies of one vector: a forest of links, not 80,000 pairs."""
    kb = spark.range(400).select(F.col("id").alias("kb_id"), F.lit("c").alias("category"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert K.similarity_links(kb, 0.99, 64).count() == 399
    assert K.cluster(kb, 0.99, 64).select("cluster").distinct().count() == 1


def test_components_of_long_chains(spark):
    n = 300
    links = spark.range(n - 1).select(F.col("id").alias("kb_id"), (F.col("id") + 1).alias("linked"))
    links = links.unionByName(spark.createDataFrame([(1000, 2000)], "kb_id long, linked long"))
    got = {r["node"]: r["component"] for r in K.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 2000: 1000}
    assert K.connected_components(links.limit(0)).count() == 0


def test_canonical_entry_and_variants(spark):
    rows = [(1, 1, "where is order"), (2, 1, "order order status"), (3, 1, "where is order"), (4, 4, "refund")]
    df = spark.createDataFrame(rows, "kb_id long, cluster long, text string")
    canon = K.canonicalise(df)
    assert {r["cluster"]: (r["canonical_id"], r["dominant"], r["members"]) for r in canon.collect()} == {1: (2, "order", 3), 4: (4, "refund", 1)}
    arrays = K.variant_arrays(K.variants(df, canon, "text")).collect()
    assert [(r["cluster"], r["question_variants"]) for r in arrays] == [(1, ["where is order"])]


def test_graph_rescue_and_fallback(spark):
    kb = spark.createDataFrame([(1, "c", "wireless charging help", [0.0, 1.0]), (2, "c", "band sizes", [0.0, 1.0]), (3, "d", "charging", [0.0, 1.0])],
                               "kb_id long, category string, text string, vector array<double>")
    asked = spark.createDataFrame([(10, "c", "my AirPods are dead", [1.0, 0.0]), (11, "c", "band", [0.0, 1.0]), (12, "c", "hm", [1.0, 0.0])],
                                  "query_id long, category string, text string, vector array<double>")
    pairs = spark.createDataFrame([("AirPods", "charging", "related", None)], "concept_a string, concept_b string, relationship_type string, notes string")
    near = Q.cosine_topk(asked, kb, 1)
    rescued = Q.graph_rescue(asked, kb, near, pairs, 0.5).collect()
    assert [(r["query_id"], r["kb_id"], r["related"]) for r in rescued] == [(10, 1, "charging")]
    hits = near.filter("score >= 0.5")
    fallback = spark.createDataFrame([(10, "a.md"), (10, "b.md")], "query_id long, filename string")
    got = {(r["query_id"], r["kb_id"], r["filename"], r["via"]) for r in Q.with_fallback(asked, hits, fallback).collect()}
    assert got == {(11, 1, None, "retrieval"), (10, None, "a.md", "mapping"), (10, None, "b.md", "mapping"), (12, None, None, "none")}
    whole = Q.retrieve(asked, kb, 1, pairs, 0.5).collect()
    assert ("graph", 10) in {(r["via"], r["query_id"]) for r in whole}


def test_the_query_itself_is_no_rescue(spark):
    kb = spark.createDataFrame([(1, "c", "airpods charging charging", [0.0, 1.0]), (2, "c", "charging", [0.0, -1.0]), (3, "c", "x", [0.0, -1.0])],
                               "kb_id long, category string, text string, vector array<double>")
    asked = kb.filter("kb_id = 1").withColumnRenamed("kb_id", "query_id")
    pairs = spark.createDataFrame([("AirPods", "charging", "related", None)], "concept_a string, concept_b string, relationship_type string, notes string")
    got = Q.retrieve(asked, kb, 1, pairs, 0.9, exclude_self=True).collect()
    assert [(r["kb_id"], r["via"]) for r in got] == [(2, "graph")]


def test_retrieval_answers_every_query(spark):
    """Hybrid, mapping or none; an entry without a vector is found by keyword."""
    schema = "kb_id long, category string, text string, vector array<double>"
    kb = spark.createDataFrame([(1, "c", "alpha beta", [1.0, 0.0]), (2, "c", "gamma gamma", None)], schema)
    asked = spark.createDataFrame([(10, "c", "gamma", [1.0, 0.0]), (11, "c", "gamma", None), (12, "lost", "x", None), (13, "lost", "x", None)],
                                  schema.replace("kb_id", "query_id"))
    files = spark.createDataFrame([(12, "a.md"), (10, "b.md")], "query_id long, filename string")
    got = {(r["query_id"], r["kb_id"], r["filename"], r["rank"], r["via"]) for r in Q.retrieve(asked, kb, 2, mapping=files).collect()}
    assert got == {(10, 1, None, 1, "hybrid"), (10, 2, None, 2, "hybrid"), (11, 2, None, 1, "hybrid"), (12, None, "a.md", 1, "mapping"), (13, None, None, 1, "none")}


def test_more_rules_than_one_block(spark, monkeypatch):
    from postmill.operators import rules as R

    monkeypatch.setattr(R, "RULES_AT_A_TIME", 3)
    columns = "priority int, rule_id string, tag string, field string, op string, pattern string, guard_field string, guard_op string, guard_pattern string"
    table = spark.createDataFrame([(k, f"r{k}", f"t{k}", "body", "contains", f"word{k};", None, None, None) for k in range(11)], columns)
    mail = spark.createDataFrame([(f"m{k}", "a", "s", f"word{k}; word10;", None) for k in range(12)], "message_id string, sender string, subject string, body string, received_at timestamp")
    got = {r["message_id"]: r["rule_id"] for r in R.classify_with_rules(mail, table).collect()}
    assert got == {f"m{k}": f"r{min(k, 10)}" for k in range(12)}


def test_hashed_embedding_is_unit_counts(spark):
    df = spark.createDataFrame([("a A b",), ("",)], "text string")
    got = [r["embedding"] for r in B.hashed_tf(df, "text", dims=64).collect()]
    assert sorted(v for v in got[0] if v) == sorted([2 / math.sqrt(5), 1 / math.sqrt(5)]) and not any(got[1])


def test_unit_rows_of_a_zero_vector():
    assert blocks.unit_rows([[0.0, 0.0], [3.0, 4.0]]).tolist() == [[0.0, 0.0], [0.6, 0.8]]


def test_clusters_are_read_from_a_written_table(spark, plan):
    """The operators on clusters read texts more than once; the join that brings texts to clusters is made once."""
    import __spark_entry__ as entry

    for name in ("canonical_entries", "cluster_variants"):
        text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "clustered-" in text and "documents.parquet" not in text


def test_scores_held_at_a_time_are_few():
    """A unit of work holds several copies of a tile, so a tile of a full block takes no more than 5 MB."""
    import pyarrow as pa

    from postmill.operators import cells

    ids = pa.array(range(cells.CELL))
    row = pa.table({"ids": pa.ListArray.from_arrays([0, cells.CELL], ids), "matrix": [np.ones((cells.CELL, 2)).tobytes()]})
    left = pa.table({"vector": [[3.0, 4.0]] * 700})
    runs = list(cells.products(left, row))
    assert sum(len(scores) for _, scores in runs) == 700 and max(scores.nbytes for _, scores in runs) < 5_000_000
