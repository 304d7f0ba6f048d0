import random
import re

import pytest

from textloom.llm import similar


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)]) if w else frozenset()


def brute(rows):
    """The group (its first row's index) of each row by the Jaccard similarity of all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s == t or 10 * len(s & t) >= 8 * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(rows))]


def expected(rows):
    """(id, component) of each row and the rows kept, from brute force."""
    group = brute(rows)
    first = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            first[g] = min(d, first.get(g, d))
    return sorted(((d, first.get(g)) for (d, _), g in zip(rows, group, strict=True)), key=str), sorted(first.values())


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = "w%d" % rnd.randint(0, 99_999)
    return out


@pytest.mark.parametrize("hot", [2, 8, 1000])
def test_similar_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "SAMPLED", 1)
    rnd = random.Random(hot)
    line = "this very common line stands in nearly every one of the texts".split()
    rows = []
    for _ in range(12):
        base = [f"w{rnd.randint(0, 99_999)}" for _ in range(rnd.choice([1, 4, 5, 9, 30, 120, 300]))]
        for _ in range(rnd.randint(1, 9)):
            w = edited(rnd, base, rnd.randint(0, 1 + len(base) // 40))
            rows.append(w[: len(w) - rnd.randint(0, len(w) // 8)] + line * rnd.randint(0, 2))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000, None), (1001, " "), (None, "a b c d e f"), (None, rows and " ".join(rows[0]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept = expected(rows)
    assert sorted(((r.doc_id, r.component_id) for r in similar.similar(df).collect()), key=str) == want and len(kept) < len(rows)
    got = [r.doc_id for r in similar.keep_one_similar(df).collect()]
    assert sorted(d for d in got if d is not None) == kept and got.count(None) == 2


def test_chain_of_similar_texts_is_one_group(spark, monkeypatch):
    """Links that only a chain of documents makes, in one hot key or many: a group far wider than one star."""
    monkeypatch.setattr(similar, "SAMPLED", 1)
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 99_999)}" for _ in range(300)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 150])) for i in range(75)] + [(500 + i, " ".join(edited(rnd, words, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in similar.similar(df).collect()), key=str) == expected(rows)[0]


def test_recall_of_pairs(spark):
    """Pairs of just over the least similarity, each by itself: found but for a few in a hundred."""
    rnd = random.Random(11)
    rows, n = [], 0
    while n < 400:
        base = [f"w{rnd.randint(0, 9_999_999)}" for _ in range(rnd.choice([40, 80, 200]))]
        other = edited(rnd, base, max(1, len(base) // 45))
        s, t = shingles(" ".join(base)), shingles(" ".join(other))
        if len(s & t) < len(s | t) and 0.8 <= len(s & t) / len(s | t) < 0.9:
            rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
            n += 1
    got = {r.doc_id: r.component_id for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(n)) >= 0.97 * n


def test_rings():
    import numpy as np

    for n in (0, 1, 1000, 10**6, 10**10):
        ring = similar.ring_for(n)
        assert ring.width <= 32 and ring.lanes * 64 >= ring.width * ring.segments
        assert (1 - similar.CHAIN_KEPT * (1 - similar.FLIP) ** ring.width) ** ring.segments <= similar.MISS
        assert [b for b, _ in ring.budgets()][-1] == 64
    h = np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = similar.shingle_set(h)
    ones = [0] * 128
    for x in s.tolist():
        for at, v in enumerate(similar.fingerprint(np.array([x], dtype=np.uint64), 2).tolist()):
            for b in range(64):
                ones[64 * at + b] += v >> b & 1
    want = [sum(1 << b for b in range(64) if 2 * ones[64 * at + b] > len(s)) for at in range(2)]
    assert len(s) == 46 and similar.fingerprint(s, 2).tolist() == want


def test_chains_are_the_ring_s_bits(spark):
    ring = similar.Ring(18, 9)
    rnd = random.Random(1)
    fp = [rnd.getrandbits(64) for _ in range(ring.lanes)]
    bits = sum(v << 64 * i for i, v in enumerate(fp))
    total = 64 * ring.lanes
    at = lambda o, n: ((bits >> o) | (bits << (total - o))) & ((1 << n) - 1) if o else bits & ((1 << n) - 1)
    df = spark.createDataFrame([(7, [v - (1 << 64) if v >> 63 else v for v in fp])], "id long, fp array<bigint>")
    got = {(r.k, r.chain & ((1 << 64) - 1)) for r in similar.chains(df, ring).collect()}
    assert got == {(i << 40 | at(18 * i, 18), at((18 * i + 18) % total, 64)) for i in range(9)}


def test_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (9, b + " tail")], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in similar.keep_one_similar(df).collect())
    assert kept == [(3, a), (5, b)]
    assert sorted((r.doc_id, r.component_id) for r in similar.similar(df).collect()) == [(3, 3), (5, 3), (5, 5), (5, 5), (9, 5)]


def test_stage_drops_edited_copies(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    w = docs.filter("n_chars > 2000").orderBy("doc_id").first().text.split()
    copy = [x if i % 60 else "changed" for i, x in enumerate(w)]
    both = docs.unionByName(docs.limit(1).selectExpr("10000000L as doc_id", "'" + " ".join(copy).replace("'", "") + "' as text", "lang", "source", "n_chars"))
    _, want = expected([(r.doc_id, r.text) for r in both.collect()])
    kept = P.near_dedup(spark, both, small)
    assert 10000000 not in want and kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    empty = docs.limit(0)
    assert P.near_dedup(spark, empty, small).count() == 0
