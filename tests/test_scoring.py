import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postmill.functions import dates, scoring, tags

PAIRS = [
    ("hello", "hello", 0, 0.0, 100.0, "PERFECT"),
    ("kitten", "sitting", 3, 50.0, 50.0, "MAJOR_EDIT"),
    ("a" * 100, "b" * 4 + "a" * 96, 4, 4.0, 96.0, "MINOR_EDIT"),
    ("a" * 100, "b" * 5 + "a" * 95, 5, 5.0, 95.0, "MAJOR_EDIT"),
    ("abc", "xyzuvw", 6, 200.0, 0.0, "REWRITE"),
    ("", "anything", 8, 0.0, 100.0, "PERFECT"),
    ("abc", "", 3, 100.0, 0.0, "REWRITE"),
    (None, None, 0, 0.0, 100.0, "PERFECT"),
    ("héllo", "hello", 1, 20.0, 80.0, "MAJOR_EDIT"),
]


def test_score_cases(spark):
    df = spark.createDataFrame([(i, p[0], p[1]) for i, p in enumerate(PAIRS)], "i int, draft_text string, final_sent string")
    got = scoring.score(df).orderBy("i").collect()
    assert [(r["edit_distance"], r["edit_pct"], r["accuracy_score"], r["result"]) for r in got] == [p[2:] for p in PAIRS]
    assert [r["empty_draft"] for r in got] == [not p[0] for p in PAIRS]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


texts = st.text(alphabet="abcé你 ", max_size=150)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=20))
def test_distance_is_exact_beyond_the_band(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", scoring.edit_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [plain_distance(a, b) for a, b in pairs]


def test_business_days_and_hours(spark):
    days = [("2024-03-04", "2024-03-06"), ("2024-03-07", "2024-03-11"), ("2024-03-08", "2024-03-12"),
            ("2024-03-09", "2024-03-12"), ("2024-03-10", "2024-03-12")]
    df = spark.createDataFrame(days, "d string, want string")
    got = df.select(dates.add_business_days(F.to_date("d")).cast("string").alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)
    hours = spark.createDataFrame([("2024-03-04 04:59:59", False, True), ("2024-03-04 05:00:00", True, True),
                                   ("2024-03-04 21:59:59", True, True), ("2024-03-03 23:00:00", False, True),
                                   ("2024-03-04 23:00:00", False, False)], "t string, open boolean, monday boolean")
    ts = F.col("t").cast("timestamp")
    got = hours.select(dates.in_business_hours(ts).alias("o"), dates.is_local_monday(ts).alias("m"), "open", "monday").collect()
    assert all(r["o"] == r["open"] and r["m"] == r["monday"] for r in got)


@pytest.mark.parametrize("prefix", ["SITE_", "a_"])
def test_tag_prefix_round_trip(spark, prefix):
    df = spark.createDataFrame([("US_WISMO",), ("GENERAL_PRODUCT",), ("B2B_FILTERED",)], "tag string")
    site = tags.with_prefix(F.col("tag"), prefix)
    got = df.select("tag", site.alias("s"), tags.without_prefix(site, prefix).alias("back")).collect()
    assert [r["s"] for r in got] == [prefix + "US_WISMO", "GENERAL_PRODUCT", "B2B_FILTERED"]
    assert all(r["tag"] == r["back"] for r in got)


def test_far_pairs_by_bits(spark):
    rows = [(0, "x" * 300, "y" * 300), (1, "héllo" * 50, "hello wörld" * 40), (2, None, "a" * 90), (3, "same", "same"), (4, "a" * 200 + "b", "c" + "a" * 100)]
    df = spark.createDataFrame(rows, "i int, draft_text string, final_sent string")
    got = [r["edit_distance"] for r in scoring.score(df, by_bits=True).orderBy("i").collect()]
    assert got == [plain_distance(a or "", b or "") for _, a, b in rows] == [r["edit_distance"] for r in scoring.score(df).orderBy("i").collect()]


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_bit_distance_against_the_table(a, b):
    assert scoring.bit_distance(a, b) == plain_distance(a, b)
