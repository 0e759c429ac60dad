"""Filter audit, HTML regions and importance resampling against brute force on small, hard rows."""

import hashlib
import html
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import regions, resampling, survival

from .conftest import COLUMNS, hard_rows, prose

# ---- 11 filter audit


def failed(rows):
    """(part, good, toxic, failed letters) of every row, filter by filter."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    labels = {100 + k: (k % 2 == 1, False) for k in range(30)}
    for i, text, _, source, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = ""
        bad += "A" if len(w) < 50 else ""
        bad += "B" if 100 * len(set(w)) < 65 * len(w) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else ""
        bad += "D" if re.search(r"[#$%&*|]", t) else ""
        bad += "E" if i is not None and first[t] < i else ""
        yield (source or "", *labels.get(i, (False, False)), bad)


def test_filter_audit_against_applying_every_order(spark, hard, folder):
    path = folder(hard)
    got = {(r["part"], r["filter_order"], r["step"]): r for r in survival.audit(hard, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    rows = list(failed(hard_rows()))
    parts = {p for p, *_ in rows}
    assert len(got) == len(parts) * 600 and "" in parts
    for part in parts:
        mine = [r for r in rows if r[0] == part]
        shapley, seen = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                after = [r for r in left if letter not in r[3]]
                lost = [r for r in left if letter in r[3]]
                shapley[letter] += len(lost)
                fails = [r for r in mine if letter in r[3]]
                seen["".join(order), step] = (
                    letter, len(after), len(lost), len(fails) - len(lost), sum(r[3] == letter for r in mine), sum(r[1] for r in lost), sum(r[2] for r in lost),
                )
                left = after
        for (order, step), (letter, *want) in seen.items():
            r = got[part, order, step]
            assert [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] == want
            assert r["shapley"] == shapley[letter]


def test_filter_audit_labels(spark):
    """Several label rows of one id, one of them null; a text that a smaller id has; the same id twice."""
    text = prose(1, 60)
    docs = spark.createDataFrame([(3, text, "a"), (3, text, "a"), (5, text, "a"), (None, text, "a"), (7, text + " #", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(5, 0, None), (5, 1, 1), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in survival.audit(docs, labels).collect()}
    e = got["a", "EABCD", 1]
    assert (e["kept"], e["removed"], e["unique_fails"], e["good_lost"], e["toxic_lost"], e["shapley"]) == (3, 1, 1, 1, 1, 120)
    assert got["", "ABCDE", 4]["removed"] == 1 and got["", "EDCBA", 1]["kept"] == 1


def test_filter_audit_of_nothing(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert survival.audit(empty, labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 17, 1000, 40_001])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    want = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
    assert survival.positional_popcount(words).tolist() == want


def test_truth_tables():
    tables = survival.truth_tables(5).tolist()
    assert tables[0] == 0xFFFFFFFF and tables[31] == 1
    assert all(bool(tables[f] >> s & 1) == (s & f == 0) for f in range(32) for s in range(32))


def test_many_parts_and_flushes(spark, monkeypatch):
    """More parts than rows in a batch, and tables given out before the end."""
    monkeypatch.setattr(survival, "FLUSH_ROWS", 100)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one # two").alias("text"), (F.col("id") % 700).cast("string").alias("source"))
    rows = survival.survivors(survival.labelled(survival.copied(survival.judged(docs)), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    got = {(r["part"], r["subset"]): r["n"] for r in rows.collect()}
    assert len({p for p, _ in got}) == 700 and sum(n for (_, s), n in got.items() if s == 0) == 3000
    assert sum(n for (_, s), n in got.items() if s == 16) == 1  # only the first of the equal texts passes E


# ---- 12 HTML regions


def shell(body: str, title: str = "t") -> str:
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        f'<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav><!-- ad 1 -->{body}'
        "<footer>&copy; site &middot; All rights reserved by all of us</footer></body></html>"
    )


def article_of(k: int):
    r = np.random.default_rng(k)
    parts = [prose(1000 * k + j, int(r.integers(1, 60))) for j in range(int(r.integers(1, 7)))]
    inside = f"<h1>{parts[0]} &amp; more</h1>" + "".join(f"<p>{p}</p>" if j % 3 else f"<p><b>{p}<br>" for j, p in enumerate(parts))
    return shell(f'<div class="ad">{prose(7000 + k, 20)}</div><article>{inside}</article>'), "\n".join([f"{parts[0]} & more", *parts])


VARIANTS = {
    "comments, adverts and forms in the middle": (
        '<header><a href="/">Site</a></header><div id="cookie-notice">We use cookies to make this site work for you.</div><main><div class="post">'
        '<h1>The title</h1><p class="byline">By A</p><p>First paragraph &eacute;&nbsp;x <b>bo</b>ld.</p><div class="ad">Buy this now please, today</div>'
        '<form>Your mail <input> <button>Send</button></form><p>Second<br>after break</p><ul><li>item one</li><li>item two</li></ul></div>'
        f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{prose(5, 90)}</p></article></section></main><aside><p>side</p></aside>',
        "The title\nBy A\nFirst paragraph é x bold.\nSecond\nafter break\nitem one\nitem two",
    ),
    "no element says article": (
        '<div class="menu"><a href=1>Home</a><a href=2>About</a></div><div id="content"><h1>Title here</h1><p>Body of the text with a number of words.</p>'
        f'<p>More body.</p></div><div class="sidebar"><p>{prose(8, 40)}</p></div><div id="comments"><p>{prose(9, 60)}</p></div><div class="footer">Copyright</div>',
        "Title here\nBody of the text with a number of words.\nMore body.",
    ),
    "links without any class": (
        '<div><a href=1>Start page</a> <a href=2>News</a> <a href=3>Shop now</a></div><div><h2>About hats</h2><p>Hats are worn on the head by many.</p>'
        "<p>Some are round.</p></div><div><a href=4>Next one</a> <a href=5>Imprint page</a></div>",
        "About hats\nHats are worn on the head by many.\nSome are round.",
    ),
    "an article in a wrapper that is named after its sidebar": (
        f'<div class="with-sidebar"><article class="post comment-open"><header><h1>Head line</h1></header><p>Text &#228; &lt;tag&gt; here.</p></article>'
        f'<div class="related"><article><p>{prose(4, 30)}</p></article></div></div>',
        "Head line\nText ä <tag> here.",
    ),
    "a box that only its name tells, with the headline before it": (
        '<div id="top"><a href=1>Start page</a></div><h1>Big news</h1><div class="article-body">Some <em>text</em> without any paragraph.<br>More of it.</div>'
        "<div>Read these words that we put under all our pages</div>",
        "Big news\nSome text without any paragraph.\nMore of it.",
    ),
    "broken markup": (
        "<article><h1>One <i>two</h1><p>three</div></p><p title='a>b'>four <script>if (a<b) x('</article>')</script>five< 6<p>seven</article>",
        "One two\nthree\nfour five< 6\nseven",
    ),
}


@pytest.fixture(scope="module")
def pages(spark):
    made = [(k, f"http://x/{k}", article_of(k)[0]) for k in range(40)]
    made += [(100 + k, None, shell(body)) for k, (body, _) in enumerate(VARIANTS.values())]
    made += [(200, "u", None), (201, "u", ""), (202, "u", "plain   text &amp; no tag"), (203, None, "<p>"), (None, "u", made[0][2]), (0, "http://x/0", made[0][2])]
    made += [(204, "u", shell(f"<article><p>{prose(3, 40_000)}</p></article>")), (205, "u", '<a "' * 3000 + "<" * 3000)]
    return spark.createDataFrame(made, "page_id long, url string, html string").selectExpr("*", "'x' as text", "0 as n_chars", "'y' as feature")


def test_regions(pages):
    got = {}
    for r in regions.extracted(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append((r["url"], r["text"]))
    for k in range(40):
        assert got[k][0] == (f"http://x/{k}", article_of(k)[1])
    for k, (name, (_, want)) in enumerate(VARIANTS.items()):
        assert got[100 + k][0][1] == want, name
    assert got[200] == [("u", "")] and got[201] == [("u", "")] and got[203] == [(None, "")]
    assert got[202] == [("u", "plain text & no tag")] and got[None][0][1] == article_of(0)[1] and len(got[0]) == 2
    assert got[204][0][1] == prose(3, 40_000)


def test_weights_come_from_labelled_pages(pages):
    """Places inside articles get weights above zero, menus below; tags always cost."""
    words, tags = regions.learn(pages)
    assert words["|p|"] > 2 and words["|h1|"] > 2 and words["menu|li|a"] < -2 and words["ad|div|"] < -2
    assert all(cost >= regions.TAG_LEAST for cost in tags.values()) and tags["nav"] > tags["p"]


def test_words_alone_find_articles_that_nothing_marks(pages):
    """Weights learned from marked pages, on the same articles in pages where plain boxes hold everything."""
    weights = regions.learn(pages)
    for k in range(40):
        page, want = article_of(k)
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert regions.main_text(bare, weights) == want


def test_region_against_all_runs():
    r = np.random.default_rng(3)
    for _ in range(300):
        scores = r.integers(-4, 5, int(r.integers(0, 12))).astype(float).tolist()
        first, end = regions.region(scores)
        best = max([0.0, *[sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]])
        assert sum(scores[first:end]) == best


def test_regions_without_pages(pages):
    assert regions.extracted(pages.limit(0)).collect() == []


# ---- 13 importance resampling


def words13(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]


def brute13(rows, items, length, percent):
    grams = lambda t: [" ".join(w[i : i + k]) for w in [words13(t)] for k in range(1, length + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s = Counter(bucket(g) for _, t in rows for g in grams(t))
    t = Counter(bucket(g) for x in items for g in grams(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found = grams(text)
        gains = [math.floor(1000 * math.log(((t[b] + 1) * (s_all + 10_000)) / ((s[b] + 1) * (t_all + 10_000)))) for b in map(bucket, found)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words13(text)), len(found), sum(gains), sum(gains) + noise))
    eligible = sorted([r for r in out if r[1] >= 20], key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = eligible[: percent * len(eligible) // 100]
    return out, [(r[4], r[0]) for r in drawn]


@pytest.mark.parametrize(("length", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_resampling(spark, hard, monkeypatch, length, percent):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 5000)
    rows = [(i, t) for i, t, *_ in hard_rows()]
    items = [prose(2, 70), "one two", None, "", prose(5, 14)]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    got = [tuple(r) for r in resampling.resampled(hard, target, length, percent=percent).collect()]
    scored, drawn = brute13(rows, items, length, percent)
    assert sorted([g[:5] for g in got], key=repr) == sorted(scored, key=repr)
    ranked = sorted([g for g in got if g[5] is not None], key=lambda g: g[5])
    assert [g[5] for g in ranked] == list(range(1, len(drawn) + 1)) and [(g[4], g[0]) for g in ranked] == drawn


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_without_nulls_keep_their_words(monkeypatch, kind):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 3000)
    texts = [prose(k, 100) for k in range(20)]
    runs = resampling.slices(pa.array(texts, kind))
    assert len(runs) > 3 and [t for run in runs for t in run.to_pylist()] == texts
    counts = Counter()
    for run in runs:
        for bucket, _ in resampling.features(run, 1, 1000)[1]:
            counts.update(bucket.tolist())
    words = [w.encode() for t in texts for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    assert counts == Counter(zlib.crc32(w) % 1000 for w in words)


def test_resampling_of_nothing(spark, empty):
    none = spark.createDataFrame([], "text string")
    assert resampling.resampled(empty, none).count() == 0


def test_resampling_without_target(spark, hard):
    rows = resampling.resampled(hard, spark.createDataFrame([], "text string"), 1).collect()
    assert len(rows) == len(hard_rows()) and sum(r["rank"] is not None for r in rows) == sum(r["n_words"] >= 20 for r in rows) // 10


def test_places_over_ranges(spark):
    """Equal scores and ids, and more ranges than rows."""
    rows = spark.range(500).select((F.col("id") % 7).alias("score"), F.col("id").alias("_row"))
    got = sorted((r["place"], -r["score"], r["_row"]) for r in resampling.placed(rows, [F.col("score").desc(), F.col("_row").asc()], 500, "place").collect())
    assert [p for p, *_ in got] == list(range(1, 501)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    few = resampling.placed(rows.limit(2), [F.col("score").desc(), F.col("_row").asc()], 2, "place")
    assert sorted(r["place"] for r in few.collect()) == [1, 2]


def test_distinct_runs_are_hashed_once():
    texts = pa.array(["A b a b", None, "", "b", "a b"])
    count, found = resampling.features(texts, 2, 10_000)
    assert count.tolist() == [4, 0, 0, 1, 2]
    pairs = [(int(b), int(o)) for b, o in zip(*found[1], strict=True)]
    c = lambda g: zlib.crc32(g.encode()) % 10_000
    assert pairs == [(c("a b"), 0), (c("b a"), 0), (c("a b"), 0), (c("a b"), 4)]


def test_columns_are_those_of_the_contract(spark, hard, folder):
    path = folder(hard)
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert regions.op12_html_regions(spark, path).dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert {t for _, t in resampling.op13_importance_resampling(spark, path).dtypes} == {"bigint"}
    assert [c for c, _ in survival.op11_filter_audit(spark, path).dtypes][:3] == ["part", "filter_order", "step"]
    assert COLUMNS.startswith("doc_id") and html.unescape("&amp;") == "&"
