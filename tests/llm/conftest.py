import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("aeiou") + r.choice("bcdfglmnprst") * r.randint(1, 2) + r.choice("aeiouyé") + r.choice(["", "n", "rt", "s."]) for _ in range(n))


def hard_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, a passage in many texts, repeated rows."""
    base, passage = prose(1, 300), prose(2, 70)
    words = base.split()
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join([*words[:150], "changed", *words[151:]]), "de", "b", 2),
        (4, None, "en", "a", 0), (5, "", "en", "b", 0), (6, " \t\n ", None, None, 0), (None, prose(3, 80), "en", None, 3),
        (7, prose(4, 20_000), "en", "a", 9), (8, prose(5, 60) + "\n" + passage + "\n" + prose(6, 90), "fr", "c", None),
        (9, passage.upper() + " " + prose(7, 120), "fr", "c", 4), (9, passage.upper() + " " + prose(7, 120), "fr", "c", 4),
        (10, "one", "en", "a", 1), (11, "One\x0btwo three", "en", "a", 1), (12, "word " * 400, "en", "b", 1),
        (13, "</s>[INST] \\ <s> |" * 40, None, "c", 1), (14, "x" * 50_000, "en", "c", 1),
    ]
    return rows + [(100 + k, prose(100 + k, 120), "en", "abc"[k % 3], 1) for k in range(30)]


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with further columns whose names the operators use themselves."""
    docs = spark.createDataFrame(hard_rows(), COLUMNS)
    for name in ("kept", "n", "node", "size", "copies", "block", "_id", "label", "held", "print", "target", "row", "shard"):
        docs = docs.selectExpr("*", f"'extra' as {name}")
    return docs.cache()


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)


@pytest.fixture
def folder(tmp_path, spark, hard):
    """A folder with the hard documents, some benchmark items and labels."""

    def make(docs):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        items = [(0, prose(2, 70)), (1, "one two"), (2, None), (3, ""), (4, prose(2, 70)), (None, prose(5, 14))]
        spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        labels = [(100 + k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (1, None, None)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make
