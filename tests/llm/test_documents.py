"""Each operator against a brute-force version on small, hard rows."""

import collections
import hashlib
import math
import pathlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import common, decontaminate, minhash, mixing, passages, pitman_yor, quality, rules, sharding, tokenfile

from .conftest import COLUMNS, hard_rows, prose


def lower_words(text):
    return (text or "").encode().lower().split()


# ---- 1 language model


def counted(rows):
    c = collections.Counter()
    for i, text, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1:
            c.update([*lower_words(text), None])
    return c


@pytest.mark.parametrize("cell", [10**6, 500])
def test_language_model(spark, hard, monkeypatch, cell):
    for name, value in (("CELL_TOKENS", cell), ("BLOCK_TOKENS", 4 * cell), ("PART_WORDS", cell)):
        monkeypatch.setattr(pitman_yor, name, value)
    got = sorted(map(tuple, pitman_yor.scored(hard).collect()), key=repr)
    c = counted(hard_rows())
    n, v = sum(c.values()), len(c)
    want = []
    for i, text, *_ in hard_rows():
        words = [*lower_words(text), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want.append((i, zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1, len(words), sum(c[w] > 0 for w in words), n, base))
    want.sort(key=repr)
    key = lambda r: (repr(r[0]), r[2])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-6)
        assert -50 * g[2] < g[6] <= 0
    # the repeated document was learned, so its text is likelier than by single words
    trained = [g for g in got if not g[1] and g[2] > 50]
    assert sum(g[6] for g in trained) > sum(g[5] for g in trained)


def test_probabilities_sum_to_one(spark):
    """All words after a context, and one unknown word, have probabilities that add up to one."""
    text = "a b a c a b d a b"
    rows = [(k, text) for k in range(2, 12)]
    words = ["a", "b", "c", "d", "zzz"]
    asked = [(1000 + k, f"a {w}") for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string")
    held = {i for i, _ in rows + asked if zlib.crc32(str(i).encode()) % 5 == 1}
    kept = [r for r in rows if r[0] not in held]
    c = collections.Counter(w for _, t in kept for w in [*t.split(), None])
    from postmill.llm.pitman_yor import Settings, draw_tables

    s = Settings(1, [len(c)], len(c))
    s.customers, s.tables, s.top_strength = 20, 6, 2.0
    k = np.array([8, 6, 3, 2, 1])
    t = np.array([2, 1, 1, 1, 1])
    assert math.isclose(s.word_probability(k, t).sum() + s.word_probability(np.zeros(1), np.zeros(1))[0], 1)
    random = np.random.default_rng(1)
    drawn = draw_tables(np.array([0, 1, 2, 5, 48, 49, 5000]), np.full(7, 3), np.full(7, 0.2), 0.5, 1.0, random)
    assert drawn[0] == 0 and drawn[1] == 1 and all(1 <= a <= b for a, b in zip(drawn[1:], [1, 2, 5, 48, 49, 5000], strict=True))
    assert docs.count() == 15


def test_stirling_numbers():
    """Against seating all customers in every possible way."""
    d = 0.4
    exact = {(1, 1): 1.0}
    for n in range(1, 8):
        for t in range(1, n + 1):
            exact[n + 1, t] = exact.get((n + 1, t), 0) + exact.get((n, t), 0) * (n - t * d)
            exact[n + 1, t + 1] = exact.get((n + 1, t + 1), 0) + exact.get((n, t), 0)
    table = pitman_yor.log_stirling(d)
    assert all(math.isclose(math.exp(table[n, t]), x, rel_tol=1e-9) for (n, t), x in exact.items() if x > 0)


def test_drawn_tables_follow_their_law():
    """The draw for few customers has the frequencies of the exact conditional."""
    d, s, p, others, c = 0.5, 1.0, 0.1, 4, 6
    drawn = pitman_yor.draw_tables(np.full(40_000, c), np.full(40_000, others), np.full(40_000, p), d, s, np.random.default_rng(2))
    stirling = pitman_yor.log_stirling(d)
    w = np.array([math.exp(stirling[c, t]) * p**t * math.prod(s + d * (others + i) for i in range(t)) for t in range(1, c + 1)])
    assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 40_000 - w / w.sum()).max() < 0.01


def test_language_model_empty(spark, empty):
    assert pitman_yor.scored(empty).count() == 0


# ---- 2 near-duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = lower_words(text)
            found = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
            sets.setdefault(i, found)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def chain(n):
    """Texts of which each is near the next one, and the ends are far apart; some have a pair of near copies beside them."""
    words = prose(50, 200).split()
    rows = []
    for k in range(n):
        words = [*words[: 8 * k], f"new{k}", *words[8 * k + 1 :]]
        rows.append((1000 - k, " ".join(words), "en", "a", 1))
    far = [*[f"far{j}" if j % 7 == 0 else w for j, w in enumerate(words)]]
    return [*rows, (2000, " ".join(far), "en", "a", 1), (2001, " ".join([*far[:-1], "end"]), "en", "a", 1)]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, hard, size):
    rows = hard_rows() + chain(20)
    docs = hard.unionByName(spark.createDataFrame(chain(20), COLUMNS), allowMissingColumns=True)
    got = minhash.near_duplicates(docs, size, 80).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, size, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_only_texts_that_may_be_compared_are_dealt_out(spark):
    docs = spark.range(-20_000, 20_000).selectExpr("id * 7919 doc_id", "cast(id as string) text").unionByName(
        spark.createDataFrame([(None, "x"), (7919, "again")], "doc_id long, text string"))
    ids = spark.range(-20_000, 20_000, 40).selectExpr("id * 7919 doc_id").unionByName(spark.createDataFrame([(7919,), (5,)], "doc_id long"))
    left = [r["doc_id"] for r in minhash.likely(docs, ids).collect()]
    assert {r["doc_id"] for r in ids.collect()} - {5} <= set(left) and left.count(7919) == 2
    assert len(left) < 1_100
    # the text is filtered on the map side, before it is dealt out for the join
    sets = minhash.full_sets(docs, ids.withColumnRenamed("doc_id", "node"), 4)
    lines = sets._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(doc_id" in line][0]
    assert any("_bits" in line for line in lines[dealt:]) and sets.count() == 1_001


def test_working_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, was = shuffles(), spark.conf.get(common.CLEANUP, None)
    table = common.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 7 and spark.conf.get(common.CLEANUP, None) == was


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = prose(60, 50), prose(61, 50)
    docs = spark.createDataFrame([(5, a), (5, b), (6, a), (7, b), (8, prose(62, 50))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8)}


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_that_are_not_near_each_other(spark, monkeypatch, block):
    """Every copy is near one text of middle id, and near nothing else."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = prose(60, 400).split()
    rows = [(60, " ".join(words))]
    for k in [*range(1, 60), *range(61, 151)]:
        r = np.random.default_rng(k)
        copy = list(words)
        for at in np.arange(5, 400, 48)[:8] + r.integers(0, 40, 8):
            copy[min(at, 394)] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    want = brute_components([(*r, "en", "a", 1) for r in rows], 5, 80)
    assert {c for _, c in want.values()} == {1}
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


# ---- 3 sharding


def test_shards(spark, hard):
    copies = spark.createDataFrame([(500 + k, "a large group", "en", "a", 1) for k in range(300)], COLUMNS)
    docs = hard.unionByName(copies, allowMissingColumns=True)
    got = sharding.laid_out(docs).collect()
    texts = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in hard_rows())
    texts.update((500 + k, 13 + 8, zlib.crc32(b"a large group")) for k in range(300))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    # the group of 300 fits in no shard; it lies in hardly more of them than it must
    spread = {r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 500}
    assert len(spread) <= -(-300 // min(sizes)) + 4
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_shards_of_few_or_no_rows(spark, empty):
    assert sharding.laid_out(empty).count() == 0
    few = sharding.laid_out(spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "doc_id long, text string")).collect()
    assert len(few) == 3 and all(r["slot"] == 0 for r in few)


# ---- 4 quality rules


def test_rules(hard):
    got = {(r["doc_id"], r["n_words"]): r for r in rules.judged(hard).collect()}
    for i, text, *_ in hard_rows():
        text = text or ""
        w = [x.decode() for x in text.encode().split()]
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {j + k for j in range(len(w) - 2) if triples[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_rules_follow_the_group(spark):
    """What is usual in one source is an outlier in another."""
    plain = [(k, prose(k, 100), "en", "plain", 1) for k in range(150)]
    marked = [(1000 + k, " ".join(w + "##" for w in prose(2000 + k, 100).split()), "en", "marked", 1) for k in range(150)]
    odd = [(5000, marked[0][1] + " x", "en", "plain", 1), (5001, marked[1][1] + " y", "en", "marked", 1)]
    kept = {r["doc_id"] for r in rules.judged(spark.createDataFrame(plain + marked + odd, COLUMNS)).filter("kept").collect()}
    assert 5000 not in kept and 5001 in kept and {r[0] for r in plain + marked} <= kept


def test_rules_empty(empty):
    assert rules.judged(empty).count() == 0


def test_rules_stay_native(hard, plan):
    text = plan(rules.measured(hard)) + plan(rules.sketches(rules.measured(hard)))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# ---- 6 token files


def test_token_files(spark, hard, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "CHUNK_BYTES", 2000)
    path = str(tmp_path / "tokens")
    tokenfile.write_tokens(hard, path, tokenfile.default_tokenizer())
    got = tokenfile.read_tokens(spark, path, "ids binary", bytes).orderBy("start").collect()
    encoder = Tokenizer.from_file(tokenfile.default_tokenizer())
    want = collections.defaultdict(list)
    for i, text, *_ in hard_rows():
        want[i].append([*encoder.encode(text or "", add_special_tokens=False).ids, 1])
    at = 0
    assert [r["doc_id"] for r in got] == sorted([i for i, *_ in hard_rows()], key=lambda i: (i is not None, i or 0))
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids in want[r["doc_id"]] and (r["start"], r["n_tokens"]) == (at, len(ids))
        at += len(ids)
    assert tokenfile.document_ids(spark, path, 11)[0].tolist() == want[11][0]
    name, data = tokenfile.stored_dictionary(spark, path)
    assert hashlib.sha256(data).hexdigest() == name


def test_token_files_empty(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    tokenfile.write_tokens(empty, path, tokenfile.default_tokenizer())
    assert tokenfile.read_tokens(spark, path, "crc long", zlib.crc32).count() == 0


# ---- 7 mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= rate * weight[s] + 1e-9}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, hard):
    many = spark.createDataFrame([(3000 + k, prose(3000 + k, 5 + k % 200), "en", ["a", "b", None, "zé"][k % 4], 1) for k in range(600)], COLUMNS)
    docs = hard.unionByName(many, allowMissingColumns=True)
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 600 + len(hard_rows())
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
    assert math.isclose(sum(want.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix_documents(docs).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_rates_are_tilted(spark):
    """Below a rate of one, longer documents are taken less often, as the exponential tilt says."""
    rows = [(k, prose(k, 20 if k % 2 else 200), "en", "a" if k < 400 else "b", 1) for k in range(440)]
    docs = spark.createDataFrame(rows, COLUMNS)
    sizes = docs.groupBy("source", mixing.n_words().alias("size")).agg(F.count("*").alias("n")).cache()
    wanted = spark.createDataFrame([("a", 400 * 110, 30_000.0), ("b", 40 * 110, 8000.0)], "source string, source_size long, target double")
    found = {r["source"]: r for r in mixing.solve(sizes, wanted).collect()}
    for s, n, target in (("a", 400, 30_000), ("b", 40, 8000)):
        rate = lambda size: min(2, math.exp(found[s]["lam"] * size / found[s]["mean"]))  # noqa: B023, E731
        assert math.isclose(n / 2 * (20 * rate(20) + 200 * rate(200)), target, rel_tol=1e-6)
    assert found["a"]["lam"] < 0 < found["b"]["lam"]


def test_mixing_empty(empty):
    assert mixing.mix_documents(empty).count() == 0


# ---- 8 decontamination


def brute_contamination(rows, items):
    import re

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(x for x in named if x is not None)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_pass", [100, 1])
def test_contamination(spark, hard, monkeypatch, per_pass):
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", per_pass)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 1000)
    items = [(0, prose(2, 70)), (1, "one two"), (2, None), (3, ""), (4, prose(2, 70)), (None, prose(5, 14)), (5, "word"), (6, "ONE! two, three")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(hard, benchmark).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"])), r["contaminated"]) for r in got), key=repr)
    assert got == brute_contamination(hard_rows(), items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha so beta or gamma"), (3, "gamma far far far far far far beta")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), slop=2)
    assert {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in found.collect()} == {1: (3, 1), 2: (0, 1), 3: (0, 0)}


def test_contamination_empty(spark, empty, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    rows = decontaminate.contamination(hard, none).collect()
    assert len(rows) == len(hard_rows()) and not any(r["n_hit"] for r in rows)


# ---- 9 passages


def test_passages(spark, hard):
    got = passages.repeated_passages(hard).collect()
    rows = {i: lower_words(t) for i, t, *_ in hard_rows()}
    for r in got:
        a = rows[r["origin_id"]][r["origin_start"] : r["origin_start"] + r["origin_words"]]
        b = rows[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        assert len(b) == r["n_words"] >= 50 and 100 * len(x & y) >= 80 * len(x | y)
    runs = collections.defaultdict(set)
    for i, w in rows.items():
        if i is not None:
            for k in range(len(w) - 49):
                runs[tuple(w[k : k + 50])].add(i)
    covered = collections.defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
        covered[r["origin_id"]].append((r["origin_start"], r["origin_start"] + r["origin_words"]))
    for i, w in rows.items():
        for k in range(len(w) - 49):
            if i is not None and len(runs[tuple(w[k : k + 50])]) > 1:
                assert any(s <= k and k + 50 <= e for s, e in covered[i])
    assert {1, 2, 3, 8, 9} <= set(covered) and not set(covered) & set(range(100, 130))


def variants(enough):
    """Documents with variants of a passage, mostly not near the first one, and the ids that share ``enough`` signatures with a near one."""
    words, rows = prose(70, 60).split(), []
    for k in range(24):
        r = np.random.default_rng(700 + k)
        variant = list(words)
        for at in r.choice([6, 14, 22, 30, 38, 46, 54], 2 if k else 5, replace=False):
            variant[at] = f"new{at}" if k else f"far{at}"
        rows.append((k, prose(800 + k, 60) + " " + " ".join(variant) + " " + prose(900 + k, 60)))
    windows = passages.compact_windows([passages.shingles(passages.WordHashes().of(t.encode().lower().split()), 5) for _, t in rows], [i for i, _ in rows], 46)
    keys = collections.defaultdict(set)
    for w in windows:
        keys[int(w["doc"])].add((int(w["key"]), int(w["sig"])))
    texts = [t.encode().lower().split() for _, t in rows]
    x = [passages.shingles(passages.WordHashes().of(t), 5) for t in texts]
    want = {
        i for a in range(24) for b in range(a + 1, 24)
        if len({s for _, s in keys[a] & keys[b]}) >= enough and passages.stretches(x[a], x[b], 50, 80) for i in (a, b)
    }
    return rows, want


@pytest.mark.parametrize("turns", [2_000_000, 1])
def test_passages_in_variants(spark, monkeypatch, turns):
    monkeypatch.setattr(passages, "TURNS", turns, raising=False)
    rows, want = variants(passages.ENOUGH)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) > 12 and {i for r in got for i in (r["doc_id"], r["origin_id"])} >= want


def test_rounds_in_slices(spark, monkeypatch):
    """Slices of a round find what the whole round finds, and neither their meetings nor shingles stay on disk."""
    rows, _ = variants(passages.ENOUGH)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(passages.repeated_passages(docs).collect())
    counts, slices, parts, paths = [], passages.slices_of, [], {}

    class Noted(common.WorkTables):
        def write(self, df, name):
            table = super().write(df, name)
            paths.setdefault(name, []).append(self.made[-1][1].removeprefix("file:"))
            return table

    def sliced(dealt):
        parts.append(slices(dealt))
        counts.append(passages.meetings(dealt).count())
        assert sum(passages.meetings(dealt, i, parts[-1]).count() for i in range(parts[-1])) == counts[-1]
        return parts[-1]

    monkeypatch.setattr(passages, "WorkTables", Noted)
    monkeypatch.setattr(passages, "slices_of", sliced)
    monkeypatch.setattr(passages, "MEETINGS", 300)
    monkeypatch.setattr(passages, "MEETINGS_EACH", 0)
    assert sorted(passages.repeated_passages(docs).collect()) == want
    assert parts == [max(1, -(-m // 300)) for m in counts] and max(parts) > 2
    assert {"hits", "shingles", "dealt", "rest", "windows", "covered"} <= set(paths) and len(paths["hits"]) > 3
    assert not [p for made in paths.values() for p in made if pathlib.Path(p).exists()]


def test_two_signatures_are_enough(spark):
    """Pairs that share a short passage with one edit, of which some agree in two signatures only."""
    rows, x = [], []
    for k in range(60):
        words = prose(1000 + k, 56).split()
        for i in (2 * k, 2 * k + 1):
            rows.append((i, prose(2000 + i, 60) + " " + " ".join(words) + " " + prose(3000 + i, 60)))
            words = [*words[:28], "new", *words[29:]]
    for _, t in rows:
        x.append(passages.shingles(passages.WordHashes().of(t.encode().lower().split()), 5))
    keys = collections.defaultdict(set)
    for w in passages.compact_windows(x, [i for i, _ in rows], 46):
        keys[int(w["doc"])].add((int(w["key"]), int(w["sig"])))
    shared = {a: len({s for _, s in keys[a] & keys[a + 1]}) for a in range(0, 120, 2) if passages.stretches(x[a], x[a + 1], 50, 80)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 2 in shared.values() and {r["origin_id"] for r in got} >= {a for a, n in shared.items() if n >= 2}


def plain_stretches(a, b, words, percent):
    places = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    shared = [j for j, x in enumerate(b) if x in places]
    if not shared:
        return []
    once = [places[b[j]][0] - j for j in shared if len(places[b[j]]) == 1]
    usual = np.median(once or [places[b[j]][0] - j for j in shared])
    place = [min(places[b[j]], key=lambda p, j=j: (abs(p - j - usual), p)) for j in shared]
    found, todo = [], [(0, len(shared))]
    while todo:
        i, j = todo.pop()
        if j <= i or shared[j - 1] - shared[i] + passages.SIZE < words:
            continue
        lo, hi = min(place[i:j]), max(place[i:j]) + 1
        x, y = set(a[lo:hi]), set(b[shared[i] : shared[j - 1] + 1])
        if 100 * len(x & y) >= percent * len(x | y):
            found.append((lo, hi, shared[i], shared[j - 1] + 1, 100 * len(x & y) // len(x | y)))
        elif j - i > 1:
            breaks = [shared[k + 1] - shared[k] + abs((place[k + 1] - shared[k + 1]) - (place[k] - shared[k])) for k in range(i, j - 1)]
            cut = i + 1 + breaks.index(max(breaks))
            todo += [(i, cut), (cut, j)]
    return found


@pytest.mark.parametrize("kinds", [3, 40, 100_000])
def test_stretches_against_a_plain_model(kinds):
    random = np.random.default_rng(kinds)
    for n in (1, 2, 30, 200):
        for _ in range(20):
            a = random.integers(1, kinds, n).astype(np.uint64)
            b = np.concatenate([random.integers(1, kinds, n // 3), a[n // 4 :], random.integers(1, kinds, 3), a[: n // 2]]).astype(np.uint64)
            changed = random.random(len(b)) < 0.05
            b[changed] = random.integers(1, kinds, int(changed.sum()))
            assert passages.stretches(a, b, 8, 80) == plain_stretches(a.tolist(), b.tolist(), 8, 80)
    a = random.integers(1, 9, 9).astype(np.uint64)
    before = passages.seen_before(a, np.argsort(a, kind="stable")).tolist()
    assert before == [max([j for j in range(i) if a[j] == a[i]], default=-1) for i in range(9)]


def test_passages_empty(empty):
    assert passages.repeated_passages(empty).count() == 0


def test_compact_windows_are_all_windows():
    """Each stretch of enough shingles lies in the window of its own minimum, and windows have no other minimum."""
    x = np.random.default_rng(4).integers(1, 60, 300).astype(np.uint64)
    before, after = passages.smaller_before(np.concatenate([[0], x, [0]]).astype(np.uint64), False), None
    v = np.concatenate([[0], x, [0]]).astype(np.uint64)
    after = len(v) - 1 - passages.smaller_before(v[::-1], True)[::-1]
    for c in range(1, 301):
        left = c - 1
        while v[left] > v[c]:
            left -= 1
        right = c + 1
        while right < len(v) and v[right] >= v[c]:
            right += 1
        assert (before[c], after[c]) == (left, right)
    assert passages.sliding_minimum(v, 5)[:296].tolist() == [min(v[i : i + 5]) for i in range(296)]


# ---- 10 quality classifier


def labelled(n=400):
    good = [(k, prose(k, 60), "en", "a", 1) for k in range(n)]
    bad = [(k, " ".join(w + "***" for w in prose(k, 60).split()), "en", "a", 1) for k in range(n, 2 * n)]
    return good + bad, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]


def test_quality_classifier(spark, hard):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, COLUMNS)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((got[i] >= 0.3) == (i < 400) for i in held) / len(held) > 0.98
    scored = quality.score(hard, model).collect()
    assert len(scored) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in scored if r["doc_id"] in (4, 5, 6)} == {0.5}


def test_a_text_too_long_for_the_sample_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    docs = spark.createDataFrame([(k, "w" * (5000 if k % 3 else 20)) for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert sorted(quality.sample(docs, labels, F.lit(True))) == sorted((b"w" * 20, k % 2) for k in range(0, 30, 3))
    with pytest.warns(UserWarning, match="no text of class"):
        assert quality.sample(docs.filter("doc_id % 3 = 1"), labels, F.lit(True)) == []


def test_training_gives_memory_back(spark, hard, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "trim", lambda: given.append(True), raising=False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.fit(hard, labels)
    assert given == [True]


def test_quality_without_labels(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(hard, none)
    assert {r["score"] for r in quality.score(hard, model).collect()} == {0.5} and quality.score(empty, model).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = (prose(9, 3000) + "  é " + "long" * 50).encode()
    whole = np.sort(np.concatenate(list(quality.features(text))))
    monkeypatch.setattr(quality, "CHUNK", 100)
    parts = np.sort(np.concatenate(list(quality.features(text))))
    # n-grams and pairs of words across a cut are kept; only blanks between pieces differ
    assert len(whole) == len(parts) and (whole == parts).all()
