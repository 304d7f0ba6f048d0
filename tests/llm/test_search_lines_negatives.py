import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from oracles import same
from pyspark.sql import functions as F

from textloom.llm import hard_negatives, lexical_search, line_dedup, queries

# ---- ranked search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_search(docs, items, k=10, counted=False):
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None and t is not None:
            wanted[i] += collections.Counter(terms(t))
    out = []
    for i, q in wanted.items():
        rows = []
        for d, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum((n if counted else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in q.items() if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_oracle(spark, small):
    name = "op11_lexical_search_sparse_product"
    same(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


@pytest.mark.parametrize("counted", [False, True])
@pytest.mark.parametrize("pass_bytes", [1, 1 << 20])
def test_search_edges(spark, edge_docs, no_docs, counted, pass_bytes, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 3)
    items = [(1, "The cat, the CAT and the king"), (2, None), (3, ""), (4, "one two"), (None, "cat"), (5, "日本語 é 0100"), (6, "absent"), (4, "word word")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    found = lexical_search.search(edge_docs, table, counted=counted, pass_bytes=pass_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute_search(docs, items, counted=counted)
    assert lexical_search.search(no_docs, table).count() == 0 and lexical_search.search(edge_docs, table.limit(0)).count() == 0


def test_search_ties_and_slices(spark, monkeypatch):
    """More equal scores than ranks, over several blocks, and texts longer than a slice."""
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 7)
    docs = [(i, "Alpha beta gamma " * (1 + i % 2)) for i in range(60, 0, -1)] + [(100, "gamma delta épée " * 50)]
    items = [(1, "alpha GAMMA"), (2, "épée delta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(lexical_search.search(df, spark.createDataFrame(items, "item_id long, text string"), k=4)) == brute_search(docs, items, 4)


def test_length_norm_without_overflow():
    n = np.array([0, 5, 10**9], np.int64)
    assert lexical_search._lengths(n, 10**10, 10**15).tolist() == [10 + 90 * int(x) * 10**10 // 10**15 for x in n]


# ---- lines


def line_key(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))


def brute_lines(texts, min_docs=10, min_chars=1):
    n = collections.Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        ls = (t or "").split("\n")
        kept = [x for x in ls if n[line_key(x)] < min_docs]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def cleaned(df):
    return sorted((r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_lines_oracle(spark, small):
    name = "op12_line_dedup_perfect_hash"
    same(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_by_either_way(spark, small, limit, monkeypatch):
    """Arrays broadcast, or sent to the hashes; several shards, and a line of a third of all rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n  Hot LINE\t"))).otherwise(F.col("text")).alias("text"))
    texts = [r.text for r in docs.collect()]
    real = line_dedup.line_index
    monkeypatch.setattr(line_dedup, "line_index", lambda counts: real(counts, 5))
    for min_docs, min_chars in ((10, 1), (2, 1), (3, 9)):
        found = line_dedup.dedup_lines(docs, min_docs=min_docs, min_chars=min_chars, broadcast_bytes=limit, salts=3)
        assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert cleaned(found) == brute_lines(texts, min_docs, min_chars)
    assert hashlib.sha256(b"").hexdigest() == line_dedup.dedup_lines(docs.limit(1).withColumn("text", F.lit(None).cast("string")), broadcast_bytes=limit).select(F.sha2("text", 256)).first()[0]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_edges(spark, edge_docs, no_docs, limit):
    texts = [r.text for r in edge_docs.collect()]
    taken = edge_docs.withColumn("n_lines", F.lit("x")).withColumn("t1", F.lit("y")).withColumn("a1", F.lit(1))
    found = line_dedup.dedup_lines(taken, min_docs=2, broadcast_bytes=limit)
    assert found.columns == [*edge_docs.columns, "t1", "a1", "n_lines", "n_dropped"]
    assert cleaned(found) == brute_lines(texts, 2) and {(r.t1, r.a1, r.words) for r in found.collect()} == {("y", 1, "a")}
    assert line_dedup.dedup_lines(no_docs, broadcast_bytes=limit).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 5000):
        h = rnd.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        h[0] //= np.uint64(1 << 61)  # few values of one half: keys differ by the other
        made = line_dedup.PerfectHash.build(*h)
        assert sorted(made.lookup(*h).tolist()) == list(range(n))
        assert int(made.sizes.sum()) <= max(64 * len(made.sizes), 5 * n)


# ---- hard negatives


def brute_negatives(rows, anchors, scale=1.0, positives=5, negatives=10, low=30, high=90):
    part = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part[i] = min(part.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in part.items()}
    out = []
    for a in sorted(i for i in whole if anchors(i)):
        label, v = whole[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            fit = [x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def test_negatives_oracle(spark, small):
    name = "op13_hard_negatives_distance_keys"
    same(queries.QUERIES[name](spark, small), queries.ORACLES[name], small)


_ROWS = "vec_id long, embedding array<double>, label int, id string, pivot string, dist string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], _ROWS)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_clusters(spark, seed, monkeypatch):
    """Clustered vectors of unequal lengths, many equal ones, a rare label, passes of few anchors."""
    monkeypatch.setattr(hard_negatives, "PASS_ANCHORS", [1000, 7, 1000][seed])
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ROWS_PER_PIVOT", 20)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", [40, 4096, 1][seed])
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 3) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(400):
        c = rnd.randrange(8)
        v = [x + rnd.gauss(0, 0.7) for x in centres[c]] if i % 4 else [1.0, 0.5, 0.0, -1.0, 2.0, 0.25]
        rows.append((i * 3 - 200, v, 9 if i == 77 else (c if rnd.random() < 0.7 else rnd.randrange(4))))
    found = hard_negatives.hard_negatives(_table(spark, rows), F.col("id") % 10 == 0, scale=16)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0, 16)


@pytest.mark.parametrize("scale", [256.0, 1e30])
def test_negatives_edges(spark, scale):
    """Rows without part, repeated rows and ids, ties, vectors of other lengths, numbers beyond 64 bits."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, [0.5, 0.5], 2), (4, [0.5, 0.5], 2), (5, [0.5], 3), (6, [], 1), (7, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [None, 1.0], 2), (None, [1.0, 1.0], 1), (11, [1.0, 1.0], None), (12, [-1.0, -2.0], 2), (100, [0.0, 0.0], 2)]
    found = sorted(map(tuple, hard_negatives.hard_negatives(_table(spark, rows), F.col("id") % 100 == 0, scale=scale).collect()))
    if scale == 256.0:
        filled = [(i, v if v is None else [*v, *[0.0] * (2 - len(v))], label) for i, v, label in rows]
        assert found == brute_negatives(filled, lambda i: i % 100 == 0, scale)
    else:
        assert found and max(abs(s) for r in found for s in r[4:]) <= 2**63 - 1
    assert hard_negatives.hard_negatives(_table(spark, rows).limit(0), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(_table(spark, rows), F.col("id") == 55).count() == 0
