"""The language model's draws against the exact law, and its scores against its own seating."""

import math
import zlib

import numpy as np
import pytest
import xxhash

from postmill.llm import pitman_yor as P


def exact_law(c, others, parent, d, strength):
    """Weights of 1 .. c tables, by the recursion of the Stirling numbers for this c alone."""
    row = np.full(c + 1, -np.inf)
    row[0] = 0
    t = np.arange(1, c + 1)
    with np.errstate(divide="ignore"):
        for n in range(c):
            row[1:] = np.logaddexp(row[:-1], np.log(np.maximum(n - t * d, 0)) + row[1:])
            row[0] = -np.inf
    w = row[1:] + np.cumsum(np.log(strength + d * (others + np.arange(c))) + math.log(parent))
    w = np.exp(w - w.max())
    return row[1:], w / w.sum()


LAWS = [(49, 10, 0.1, 0.5), (49, 300, 0.1, 0.8), (100, 40, 0.2, 0.8), (300, 300, 0.1, 0.8), (1025, 50, 0.3, 0.8), (2000, 1000, 0.01, 0.7), (2000, 2000, 0.5, 0.8), (2000, 100, 0.2, 0.3)]


@pytest.mark.parametrize(("c", "others", "parent", "d"), LAWS)
def test_tables_are_drawn_from_one_law_at_every_size(c, others, parent, d):
    numbers, law = exact_law(c, others, parent, d, 1.0)
    t = np.arange(1, c + 1)
    mean = (law * t).sum()
    spread = math.sqrt((law * (t - mean) ** 2).sum())
    n = 20_000 if c <= P.EXACT else 4_000
    drawn = P.draw_tables(np.full(n, c), np.full(n, others), np.full(n, parent), d, 1.0, np.random.default_rng(1))
    noise = 4 * spread / math.sqrt(n)
    assert abs(drawn.mean() - mean) < 0.005 * mean + noise and abs(drawn.std() - spread) < 0.02 * spread + noise
    likely = law > 1e-9
    off = (P.far_stirling(np.full(c, c), t, d) - numbers)[likely]
    assert off.max() - off.min() < 0.01  # a common factor does not matter


def test_one_and_no_customers():
    drawn = P.draw_tables(np.array([0, 1, 2, 5000, 10**7]), np.full(5, 3), np.full(5, 0.2), 0.5, 1.0, np.random.default_rng(1))
    assert drawn[0] == 0 and drawn[1] == 1 and 1 <= drawn[2] <= 2 and 1 <= drawn[3] <= 5000 and 1 <= drawn[4] <= 10**7


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_scores_follow_from_the_seating(spark, monkeypatch):
    """Every score again from the drawn tables by the predictive formula, whose probabilities add up to one."""
    texts = ["a b a c a b d a b", "b c a", "", "d d d b", "a zzz"]
    rows = [(i, texts[i % 4]) for i in range(60)] + [(i, texts[4]) for i in range(60, 200) if held(i)]
    kept, original = [], P.answered

    def spy(asked, state, samples, side):
        kept.append((state.collect(), [(slices.collect(), s) for slices, s in samples], side))
        return original(asked, state, samples, side)

    monkeypatch.setattr(P, "answered", spy)
    got = {r["doc_id"]: r["score"] for r in P.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (state, samples, side), = kept
    assert side == 1 and len(samples) == P.SAMPLES
    hashes = {w: xxhash.xxh64_intdigest(w.encode()) for _, t in rows for w in t.split()} | {None: P.END}
    number = {w: k for k, (w, _) in enumerate(sorted(hashes.items(), key=lambda x: x[1]))}  # words are numbered by hash
    s = next(r for r in state if r["kind"] == "s")
    keys = P.unpack_pairs(bytes(s["a"])).tolist()
    tables = P.unpack(bytes(s["c"]), np.uint32).reshape(-1, len(keys))[1:]
    followed = {}
    for i, text in rows:
        if not held(i):
            w = [None, *text.split(), None]
            for u, v in zip(w, w[1:]):
                followed[number[u], number[v]] = followed.get((number[u], number[v]), 0) + 1
    assert dict(zip(keys, P.unpack(bytes(s["b"]), np.uint32).tolist())) == {(u << 32) | v: n for (u, v), n in followed.items()}
    known = {v for _, v in followed}

    def p(u, v):
        total = 0.0
        for k, (slices, x) in enumerate(samples):
            t = {key: int(n) for key, n in zip(keys, tables[len(samples) - 1 - k])}
            of = lambda match: sum(n for key, n in t.items() if match(key >> 32, key & 0xFFFFFFFF))
            customers, mine = of(lambda a, b: True), of(lambda a, b: b == v)
            top = next(P.unpack(bytes(r["b"]), np.int64) for r in slices if r["kind"] == "K")
            parent = (mine - x.top_discount * (top[v] if v is not None else 0) + (x.top_strength + x.top_discount * top.sum()) / (len(known) + 1)) / (x.top_strength + customers)
            c, n = followed.get((u, v), 0), sum(n for (a, _), n in followed.items() if a == u)
            own = c - x.discount * t.get((u << 32) | v, 0) if c else 0.0
            total += (own + (x.strength + x.discount * of(lambda a, b: a == u)) * parent) / (x.strength + n)
        return total / len(samples)

    unknown = number["zzz"]
    for u in [*known, unknown]:
        assert math.isclose(sum(p(u, v) for v in known) + p(u, unknown), 1, rel_tol=1e-9)
    for i, text in rows[:4] + rows[-1:]:
        w = [number[x] for x in [None, *text.split(), None]]
        assert math.isclose(got[i], sum(math.log10(p(u, v)) for u, v in zip(w, w[1:])), rel_tol=1e-5)
