import itertools
import random
import re
import time
import zlib

import pytest
import xxhash
from oracles import same
from pyspark.sql import functions as F

from textloom.llm import components, decontamination, mixing, queries, sharding, simhash, url_filter


def fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_pigeonring(spark, small).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(edge_docs).collect()]
    assert len(rows) == edge_docs.count() and (2, "0" * 16, 2) in rows and (3, "0" * 16, 2) in rows and (4, "0" * 16, 2) in rows
    assert [c for d, _, c in rows if d is None] == [1]
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(edge_docs).collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("max_bucket", [1, 3, 1000])
@pytest.mark.parametrize("segments", [None, 16, 32])
def test_links_by_either_way(spark, max_bucket, segments):
    rnd = random.Random(max_bucket)
    bases = [rnd.getrandbits(64) for _ in range(6)]
    fps = {rnd.choice(bases) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)}
    prints = {v - (1 << 64) if v >> 63 else v: v for v in fps}
    df = spark.createDataFrame([(k,) for k in prints], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(df, segments=segments, max_bucket=max_bucket)).collect()}
    assert {d: found.get(d, d) for d in prints} == brute_components(prints)


def test_pigeonring_alone_finds_all_links(spark):
    """The chains find every pair within two bits; the neighbourhoods of hot keys are for cost only."""
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rnd.sample(range(64), k)) for f in fps for k in (1, 2, 3)]
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for segments in (8, 16, 32):
        got = simhash.ring_links(simhash.ring_keys(df, segments), segments).distinct().collect()
        assert {(r.u, r.v) for r in got} == want
    assert [simhash.segments_for(n) for n in (0, 10**8, 10**9, 10**12)] == [8, 8, 16, 32]
    assert {(r.u, r.v) for r in simhash.links(df).collect()} == want  # no key is hot: all links come from the ring


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(3, "a b c d"), (5, "a b c d"), (5, "x y z w q"), (5, "x y z w q"), (4, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(3, 3), (4, 3), (5, 3), (5, 5), (5, 5)]
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(3, "a b c d"), (5, "x y z w q")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (200, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def toks(t):
    return [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]


def overlaps(docs, items):
    """{(row, item_id): (n_match, n_window, first_token)} over every alignment and window, without seeds."""
    out = {}
    for r, (_, text) in enumerate(docs):
        d = toks(text)
        for item_id, item in items:
            b = toks(item)
            if item_id is None or not b or (len(b) < 6 and d != b):
                continue
            need = min(20, len(b))
            least = need if len(b) < 12 else -(-need * 4 // 5)
            for shift in range(-len(b) + 1, len(d)):
                m = [int(d[j + shift] == b[j]) for j in range(max(0, -shift), min(len(b), len(d) - shift))]
                sums = [sum(m[s : s + need]) for s in range(len(m) - need + 1)]
                good = [s for s, v in enumerate(sums) if v >= least]
                if good:
                    best, window, first = out.get((r, item_id), (0, 99, 10**9))
                    out[(r, item_id)] = (max(best, max(sums)), min(window, need), min(first, max(0, shift) + good[0]))
    return out


def test_masks_are_lossless():
    """Every pattern of a fifth of 12 to 20 tokens substituted leaves a seed of some mask whole."""
    kept = [[i for i, bit in enumerate(m) if bit == "1"] for m in decontamination.MASKS]
    for n in range(decontamination.LEAST_LOOSE, decontamination.MIN_OVERLAP + 1):
        for gone in map(set, itertools.combinations(range(n), n // 5)):
            assert any(all(s + i not in gone for i in k) for k in kept for s in range(n - k[-1])), (n, gone)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_decontamination(spark, small, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", bound)
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_TOKENS", bound)
    same(queries.op5_decontamination_spaced_seeds(spark, small), queries.ORACLES["op5_decontamination_spaced_seeds"], small)
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {r.doc_id for r in decontamination.contaminated(docs, bench).collect()}
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - found


def test_decontamination_against_all_windows(spark):
    """Items of all lengths, planted with and without substitutions, also at block ends and text ends."""
    rnd = random.Random(4)
    word = lambda: "w%d" % rnd.randint(0, 40)  # noqa: E731  few words: chance agreements are common
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 5, 6, 9, 11, 12, 13, 15, 17, 19, 20, 25, 60)]
    docs = []
    for n, text in items:
        w = text.split()
        for gone in (0, 1, n // 5, n // 5 + 1, n // 3):
            copy = list(w)
            for i in rnd.sample(range(n), min(n, gone)):
                copy[i] = "other%d" % i
            before = [word() for _ in range(rnd.choice([0, 3, 250, 256, 300]))]
            docs.append((len(docs), " ".join([*before, *copy, *[word() for _ in range(rnd.choice([0, 2, 30]))]]).upper() + "!"))
    docs += [(900, items[0][1]), (901, items[1][1] + "."), (902, items[2][1]), (None, items[-1][1]), (None, None), (903, items[-1][1]), (903, "clean words"), (904, "")]
    items += [(60, items[-1][1]), (70, None), (None, items[-2][1]), (71, " ")]
    want = overlaps(docs, items)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(rows, bench).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.item_id, r.n_match, r.n_window, r.first_token) for r in got], key=key) == sorted([(docs[r][0], i, *v) for (r, i), v in want.items()], key=key)
    dirty = {r for r, _ in want}
    kept = decontamination.decontaminate(rows, bench).collect()
    assert sorted([tuple(r) for r in kept], key=key) == sorted([d for r, d in enumerate(docs) if r not in dirty], key=key)
    assert (903, "clean words") in map(tuple, kept) and (None, None) in map(tuple, kept)


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(9, "some benchmark item of more than twelve words that nothing in the documents has ever said")], "item_id long, text string")
    assert decontamination.contaminated(edge_docs, bench).count() == 0
    assert decontamination.decontaminate(edge_docs, bench).count() == edge_docs.count()
    assert decontamination.contaminated(no_docs, bench).count() == 0 and decontamination.decontaminate(no_docs, bench).count() == 0
    assert decontamination.contaminated(edge_docs, bench.limit(0)).count() == 0
    copy = spark.createDataFrame([(9, "The cat sat on the mat and the dog ran to the house of the king")], "item_id long, text string")
    kept = decontamination.decontaminate(edge_docs, copy)  # all three copies go, also the one without an id
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3


def waterfill(budget, weights, caps):
    """Shares of budget by weight, none above its cap; shortages go to the others by weight."""
    out, left = dict.fromkeys(caps, 0), min(budget, sum(c for k, c in caps.items() if weights[k] > 0))
    free = {k for k, c in caps.items() if c > 0 and weights[k] > 0}
    while free and left > 1e-9:
        total = sum(weights[k] for k in free)
        full = {k for k in free if left * weights[k] / total >= caps[k]}
        out |= {k: caps[k] for k in full} if full else {k: left * weights[k] / total for k in free}
        if not full:
            break
        left -= sum(caps[k] for k in full)
        free -= full
    return out


def solved(leaves, m):
    """Tokens to take from each leaf, by recursion over the tree."""
    cap = lambda p: m.max_epochs * sum(n for q, n in leaves.items() if q[: len(p)] == p)
    budgets = {(): min(m.share * sum(leaves.values()), cap(()))}
    for depth in range(3):
        for node in [p for p in budgets if len(p) == depth]:
            kids = sorted({q[: depth + 1] for q in leaves if q[:depth] == node}, key=repr)
            known = [m.weights[k] for k in kids if k in m.weights]
            mean = sum(known) / len(known) if known else 1.0
            budgets |= waterfill(budgets[node], {k: m.weights.get(k, mean) for k in kids}, {k: cap(k) for k in kids})
    return {p: int(b + 1e-6) for p, b in budgets.items() if len(p) == 3}


def take_of(spark, leaves, m):
    df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "_d string, _l string, _s string, n long")
    return {tuple(r)[:3]: r["take"] for r in mixing.solve(df, m).collect()}


def test_waterfill_and_tree(spark):
    leaves = {("d", "en", "x"): 10, ("d", "en", "y"): 1000, ("d", "de", "z"): 1000, ("e", "en", "x"): 1000}
    got = take_of(spark, leaves, mixing.Mixture({}, share=0.2, max_epochs=1))
    # x's shortage goes to its sibling y, not to de or e
    assert got == {("d", "en", "x"): 10, ("d", "en", "y"): 140, ("d", "de", "z"): 150, ("e", "en", "x"): 301}
    assert take_of(spark, leaves, mixing.Mixture({}, share=9, max_epochs=2)) == {p: 2 * n for p, n in leaves.items()}
    assert take_of(spark, leaves, mixing.Mixture({("e",): 0.0}, share=0.5))[("e", "en", "x")] == 0
    assert take_of(spark, {}, mixing.Mixture({})) == {}
    rnd = random.Random(8)
    for _ in range(6):
        names = [None, "a", "b", "c"]
        leaves = {(rnd.choice(names), rnd.choice(names), f"s{i}"): rnd.choice([1, 7, 1000, 10**6]) for i in range(40)}
        weights = {p[:k]: rnd.choice([0.0, 0.5, 1.0, 4.0]) for p in leaves for k in (1, 2, 3) if rnd.random() < 0.4 and None not in p}
        m = mixing.Mixture(weights, share=rnd.choice([0.05, 0.5, 0.9, 2.5]), max_epochs=rnd.choice([1, 3]))
        want, got = solved(leaves, m), take_of(spark, leaves, m)
        assert all(abs(got[p] - want[p]) <= 1 for p in leaves), m


def brute_mixed(rows, hashes, m):
    """(row, epoch) of every document that the mixture takes; rows: (id, domain, lang, source, text), hashes[row][epoch]."""
    n_tok = [len([x for x in re.split(r"[\x20\x09-\x0D]+", r[4] or "") if x]) for r in rows]
    by_leaf = {}
    for i, r in enumerate(rows):
        if n_tok[i]:
            by_leaf.setdefault(tuple(r[1:4]), []).append(i)
    take = solved({p: sum(n_tok[i] for i in rs) for p, rs in by_leaf.items()}, m)
    out = []
    for p, rs in by_leaf.items():
        full, rest = divmod(take[p], sum(n_tok[i] for i in rs))
        out += [(i, e) for i in rs for e in range(full)]
        before = 0
        for i in sorted(rs, key=lambda i: hashes[i][full]):
            if before < rest:
                out.append((i, full))
            before += n_tok[i]
    return sorted(out)


def epoch_hashes(docs, m):
    return [F.xxhash64(F.lit(m.seed), F.lit(e).cast("long"), "doc_id").alias(f"h{e}") for e in range(m.max_epochs + 1)]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_mixed_against_brute_force(spark, small, monkeypatch, bits, bound):
    monkeypatch.setattr(mixing, "LEVEL_BITS", bits)  # with one bit the last parts hold many documents
    monkeypatch.setattr(mixing, "MAX_BROADCAST", bound)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = mixing.Mixture({("web",): 1.0, ("forum",): 6.0, ("curated",): 3.0}, share=1.1, max_epochs=3)
    keyed = docs.select("doc_id", mixing.domain_of(F.col("source")).alias("d"), "lang", "source", "text", *epoch_hashes(docs, m)).collect()
    rows = [tuple(r)[:5] for r in keyed]
    want = brute_mixed(rows, [tuple(r)[5:] for r in keyed], m)
    got = mixing.mixed(docs, m, epoch_col="epoch")
    assert sorted((r.doc_id, r.epoch) for r in got.collect()) == sorted((rows[i][0], e) for i, e in want)
    assert got.drop("epoch").columns == docs.columns


def test_mixed_edges(spark, edge_docs, no_docs):
    out = mixing.mixed(edge_docs, mixing.Mixture({}, share=1.0, max_epochs=1))  # no leaf can give more than it has
    assert out.columns == edge_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in edge_docs.filter(r"text rlike '[^ \\t\\n\\x0B\\f\\r]'").collect())
    assert mixing.mixed(no_docs).count() == 0


def test_sharding(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(queries.op7_sharding_by_bytes(spark, small).collect(), key=lambda r: r.doc_id)
    sizes = [len(r.text.encode()) + 8 for r in sorted(docs.collect(), key=lambda r: r.doc_id)]
    start, total, slots = 0, sum(sizes), {}
    for r, size in zip(rows, sizes, strict=True):
        shard = start * 24 // total
        assert (r.size, r.shard, r.slot, r.law, r.grown_shard) == (size, shard, slots.get(shard, 0), "bytes", None)
        slots[shard] = slots.get(shard, 0) + 1
        start += size
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    edge = sharding.assign_shards(edge_docs).collect()
    assert len(edge) == edge_docs.count() and {r.size for r in edge if r.doc_id in (2, 3)} == {8}
    assert sharding.assign_shards(no_docs).count() == 0


@pytest.mark.parametrize("bound", [0, 500_000])
def test_url_filter(spark, small, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_ENTRIES", bound)
    same(queries.op9_url_temporal_lists(spark, small), queries.ORACLES["op9_url_temporal_lists"], small)
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("l", "domain", "ex.com", "block", t(5)), ("l", "domain", "ex.com", "block", t(5)), ("l", "domain", "ex.com", "remove", t(10)), ("m", "host", "a.ex.com", "allow", t(6)), ("m", "prefix", "a.ex.com/bad", "block", t(6)), ("l", "host", None, "block", t(1)), ("l", "domain", "ex.com", "block", t(20))]
    e = spark.createDataFrame(entries, "list_name string, kind string, key string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    caps = [(1, "http://b.ex.com/x", t(4)), (2, "http://b.ex.com/x", t(5)), (3, "http://b.ex.com/x", t(10)), (4, "https://u:p@A.ex.com:80/x", t(7)), (5, "http://a.ex.com/bad/y?q", t(7)), (6, None, t(7)), (7, "not a url", t(7)), (8, "http://ex.com", None), (9, "http://www.ex.com", t(25)), (9, "http://www.ex.com", t(25)), (None, "http://ex.com/", t(6))]
    c = spark.createDataFrame([(*x, "clash") for x in caps], "page_id long, url string, fetched_at string, key string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = sorted(((r.page_id, r.blocked) for r in url_filter.filter_urls(c, e).collect()), key=str)
    assert got == sorted([(1, False), (2, True), (3, False), (4, False), (5, True), (6, False), (7, False), (8, False), (9, True), (9, True), (None, True)], key=str)
    assert url_filter.filter_urls(c.limit(0), e).count() == 0
    assert url_filter.filter_urls(c, e.limit(0)).filter("blocked").count() == 0


def test_url_filter_long_prefixes(spark):
    key = "ex.com/" + "/".join("abcdefghi")
    e = spark.createDataFrame([("l", "prefix", key, "block")], "list_name string, kind string, key string, action string").withColumn("listed_at", F.to_timestamp(F.lit("2024-01-01")))
    urls = [(1, f"http://{key}"), (2, f"http://{key}/j?q"), (3, "http://ex.com/" + "/".join("abcdefgh"))]
    c = spark.createDataFrame(urls, "page_id long, url string").withColumn("fetched_at", F.to_timestamp(F.lit("2024-01-02")))
    assert {r.page_id: r.blocked for r in url_filter.filter_urls(c, e).collect()} == {1: True, 2: True, 3: False}


def test_url_filter_normal_forms(spark):
    t = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [
        ("l", "host", "www.foo.com", "block", t(1)),  # as captures lose www., so do keys
        ("l", "host", "Bar.com", "block", t(1)), ("l", "host", "bar.com", "remove", t(3)),  # one key in two spellings
        ("l", "domain", "ex.com.", "block", t(1)),
        ("l", "prefix", "https://WWW.Case.org//Private/x/?q", "block", t(1)),
        ("l", "prefix", "dom.net/", "block", t(1)),
        ("l", None, "none.com", "block", t(1)), (None, "host", "unnamed.com", "block", t(1)), ("l", "host", "  ", "block", t(1)),
    ]
    e = spark.createDataFrame(entries, "list_name string, kind string, key string, action string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    urls = {
        1: ("http://foo.com/", True), 2: ("http://WWW.FOO.COM", True), 3: ("http://bar.com/", False), 4: ("https://a.ex.com./x", True), 5: ("http://case.org/Private/x/y", True),
        6: ("http://case.org/private/x", False), 7: ("http://case.org/Private", False), 8: ("http://dom.net/any", True), 12: ("http://a.dom.net/any", False), 13: ("http://dom.net", True), 9: ("http://none.com", False), 10: ("http://unnamed.com", True), 11: ("http:///x", False),
    }
    c = spark.createDataFrame([(k, u) for k, (u, _) in urls.items()], "page_id long, url string").withColumn("fetched_at", F.lit(t(5)).cast("timestamp"))
    got = {r.page_id: r.blocked for r in url_filter.filter_urls(c, e).collect()}
    assert got == {k: b for k, (_, b) in urls.items()}


def test_native_plans(spark, small):
    for f in (queries.op4_quality_rules, queries.op5_decontamination_spaced_seeds, queries.op9_url_temporal_lists):
        plan = f(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_decontamination_of_repeated_tokens(spark):
    """Runs and periods on both sides: as many alignments as there are different surroundings, and the rows of all alignments."""
    import duckdb

    junk = {1: "a " * 700, 2: "x y z " * 90, 3: "q " + "a " * 30 + "r s " * 40 + "a " * 25 + "q", 4: "b " * 19 + "c", 5: "a b " * 60 + "c d e f g h i j k l m n o p q r s t u v w", 6: "b " * 9 + "c"}
    items = {1: "a " * 60, 2: "y z x " * 12, 3: "r s " * 12 + "a " * 15, 4: "b " * 40, 5: "b " * 8 + "c c", 6: "a b " * 8 + "c d e f g h i j"}
    docs, bench = spark.createDataFrame(list(junk.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", junk), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", list(rows.items()))
    names = ["doc_id", "item_id", "n_match", "n_window", "first_token"]
    want = con.sql(f"select {', '.join(names)} from ({queries.ORACLES['op5_decontamination_spaced_seeds']})").fetchall()
    assert sorted(tuple(r[n] for n in names) for r in decontamination.contaminated(docs, bench).collect()) == sorted(want)
    long = spark.createDataFrame([(1, "a " * 20_000), (2, "a b c " * 20_000)], "doc_id long, text string")
    many = spark.createDataFrame([(1, "a " * 300), (2, "c a b " * 100)], "item_id long, text string")
    began = time.time()
    assert {(r.doc_id, r.item_id, r.n_match, r.first_token) for r in decontamination.contaminated(long, many).collect()} >= {(1, 1, 20, 0)}
    assert time.time() - began < 60
