"""The pipeline's stages on hard rows, each judged on its own input."""

import collections

import pytest

import corpus_pipeline
from postmill.llm import decontaminate, minhash, mixing, quality

from .conftest import COLUMNS, hard_rows, prose
from .test_documents import brute_components, brute_contamination


def test_stages_in_turn(spark, hard, folder):
    sf_dir = folder(hard)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "stage")
        seen.append((name, docs))
        if name != "sharding":
            assert docs.columns == columns
    assert [n for n, _ in seen] == ["quality classifier", "near-duplicates", "benchmark decontamination", "source mixing", "sharding"]
    assert seen[-1][1].count() == seen[-2][1].count()


def test_run(spark, hard, folder):
    assert corpus_pipeline.run(spark, folder(hard)).columns[:2] == ["doc_id", "size"]


def test_run_on_nothing(spark, empty, folder):
    assert corpus_pipeline.run(spark, folder(empty)).count() == 0


def test_dedup_stage_keeps_one_of_each_group(spark, hard, folder):
    left = minhash.dedup_stage(spark, hard, folder(hard)).collect()
    groups = brute_components(hard_rows(), 5, 80)
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted({c for _, c in groups.values()})
    assert sum(r["doc_id"] is None for r in left) == 1


def test_decontaminate_stage_drops_the_contaminated(spark, hard, folder):
    sf_dir = folder(hard)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(hard_rows(), items) if r[4]}
    left = collections.Counter(r["doc_id"] for r in decontaminate.decontaminate_stage(spark, hard, sf_dir).collect())
    assert bad and left == collections.Counter(i for i, *_ in hard_rows() if i not in bad)


def test_mixing_stage_repeats_rows(spark, hard, folder):
    unique = hard.dropDuplicates(["doc_id"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(unique).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mixing_stage(spark, unique, folder(hard)).collect())
    assert got == collections.Counter({i: n for i, n in copies.items() if n})


def test_quality_stage_follows_the_scores(spark, hard, folder):
    sf_dir = folder(hard)
    model = quality.fit(hard, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = collections.Counter(r["doc_id"] for r in quality.score(hard, model).filter("score >= 0.3").collect())
    assert collections.Counter(r["doc_id"] for r in quality.quality_stage(spark, hard, sf_dir).collect()) == good


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_nothing(spark, empty, folder, name):
    sf_dir = folder(empty)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, sf_dir).count() == 0


def test_rows_of_one_id_are_judged_one_by_one(spark, folder):
    bad, clean = prose(2, 70), [prose(1000 + k, 100) for k in range(8)]
    ids = [None, None, None, 7, 7, 7, 8, 9]
    rows = [(i, t, "en", "abc"[k % 3], 1) for k, (i, t) in enumerate(zip(ids, clean, strict=True))]
    docs = spark.createDataFrame([*rows, (None, bad, "en", "a", 1), (7, bad, "en", "a", 1), (9, clean[3], "en", "a", 1)], COLUMNS)
    path = folder(docs)
    left = decontaminate.decontaminate_stage(spark, docs, path).collect()
    assert sorted(r["text"] for r in left) == sorted([*clean, clean[3]])
    single = minhash.dedup_stage(spark, docs, path).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in single) == sorted([*((i or 0, t) for i, t, *_ in rows), (0, bad), (7, bad)])
    taken = {r["source"]: r["t"] for r in mixing.mix_documents(docs).selectExpr("source", "size * copies as x").groupBy("source").sum("x").withColumnRenamed("sum(x)", "t").collect()}
    got = {}
    for r in mixing.mixing_stage(spark, docs, path).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert got == taken
