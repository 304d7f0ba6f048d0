"""The pipeline against a brute-force pipeline over plain Python lists."""

import random
import zlib

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_corpus_operators import brute_mixed, epoch_hashes, overlaps
from test_similar import expected
from test_text_operators import brute_quality

from textloom.llm import mixing, quality


def passes(text):
    n, chars, symbols, dup, repeat = brute_quality(text)
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if n < 50 or 100 * repeat > 50 * n or n > 10_000_000:
        return False
    stop = sum(w.lower() in set(quality.STOP_WORDS) for w in words)
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
    alpha = sum(any(c.isalpha() for c in w) for w in words)
    return 2 <= chars / n <= 20 and symbols / n <= 0.25 and stop >= 2 and stop / n >= 0.02 and dup / max(lines, 1) <= 0.5 and alpha / n >= 0.6


def brute_pipeline(spark, docs, items):
    """(doc_id, size, crc, shard, slot, row) of the shard table; docs: (doc_id, text, lang, source)."""
    docs = [d for d in docs if passes(d[1])]
    kept = set(expected([(d[0], d[1]) for d in docs])[1])
    docs = [d for d in docs if d[0] in kept]
    dirty = {r for r, _ in overlaps([(d[0], d[1]) for d in docs], items)}
    docs = [d for i, d in enumerate(docs) if i not in dirty]
    m = mixing.PRODUCTION
    df = spark.createDataFrame([(i, d[0], d[3]) for i, d in enumerate(docs)], "i long, doc_id long, source string")
    hashed = {r[0]: tuple(r)[1:] for r in df.select("i", mixing.domain_of(F.col("source")), *epoch_hashes(df, m)).collect()}
    rows = [(d[0], hashed[i][0], d[2], d[3], d[1]) for i, d in enumerate(docs)]
    chosen = brute_mixed(rows, [hashed[i][1:] for i in range(len(docs))], m)
    last = sorted((docs[i][0], zlib.crc32(docs[i][1].encode()), len(docs[i][1].encode()) + 8) for i, _ in chosen)
    total, start, slots, out = sum(x[2] for x in last), 0, {}, []
    for row, (doc_id, crc, size) in enumerate(last):
        shard = start * 24 // total
        out.append((doc_id, size, crc, shard, slots.setdefault(shard, 0), row))
        slots[shard] += 1
        start += size
    return out


def test_run_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = P.run(spark, small)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.row) for r in got.collect()) == sorted(brute_pipeline(spark, docs, items))


def test_run_on_planted_documents(spark, tmp_path):
    """Edited copies, benchmark passages with substitutions, junk, ties of text and several epochs."""
    rnd = random.Random(21)
    stop = ["the", "of", "and", "to"]
    word = lambda: rnd.choice(stop) if rnd.random() < 0.2 else "w" + "".join(rnd.choice("abcdefgh") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, items = [], [(i, text(40)) for i in range(3)]
    add = lambda t: docs.append((len(docs) + 10, t, rnd.choice(["en", "de", None]), rnd.choice([f"src{i}" for i in range(7)] + [None])))
    for _ in range(25):
        base = text(rnd.randint(60, 200))
        add(base)
        for _ in range(rnd.randint(0, 3)):
            w = base.split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = "changed"
            add(" ".join(w))
    for _, item in items:
        w = item.split()
        w[5], w[25] = "x1", "x2"
        add(text(80) + " " + " ".join(w) + " " + text(30))
    for t in (None, "", "short", "a b c " * 50, "#### $$$$ %%%% " * 40):
        add(t)
    rnd.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = P.run(spark, str(tmp_path))
    want = brute_pipeline(spark, docs, items)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.row) for r in got.collect()) == sorted(want) and 10 < len(want)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and 0 < out.count(), name
        assert out.dropDuplicates(["doc_id"]).count() <= docs.count(), name
        docs = out
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_stage_edges(spark, edge_docs, no_docs, small):
    texts = lambda df: sorted(r.text or "" for r in df.collect())
    rows = edge_docs.collect()
    for name, stage in P.STAGES:
        assert stage(spark, no_docs, small).count() == 0, name
    assert texts(P.quality(spark, edge_docs, small)) == []  # all are short or one word again and again
    near = P.near_dedup(spark, edge_docs, small)
    # of the rows equal in id and text one; of the texts without words one; the row without an id stays
    assert near.columns == edge_docs.columns and sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    assert P.decontamination(spark, edge_docs, small).count() == len(rows)
    mixed = P.mixing(spark, edge_docs, small)
    assert mixed.columns == edge_docs.columns and not any((r.text or "").strip() == "" for r in mixed.collect())
    shards = P.sharding(spark, edge_docs, small).collect()
    assert sorted(r.row for r in shards) == list(range(len(rows))) and {r.size for r in shards if r.doc_id in (2, 3)} == {8}


def test_scratch_tables_are_deleted(spark, tmp_path, small, monkeypatch):
    """Each stage leaves what its result reads and nothing else."""
    from textloom.llm import common

    monkeypatch.setattr(common, "checkpoint_root", lambda spark: f"file://{tmp_path}")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in P.STAGES[1:4]:
        n = stage(spark, docs, small).count()
        left = sorted(p.name for p in tmp_path.glob("textloom-*/*"))
        assert n and left == {"near_dedup": ["drop"], "decontamination": ["found"], "mixing": ["cuts", "plan", "taken"]}[name], name
        for p in tmp_path.glob("textloom-*"):
            common._delete(spark, f"file://{p}")
    with common.scratch(spark):
        with common.scratch(spark):
            table = common.keep(common.materialize(docs.select("doc_id")))
        assert table.count() == docs.count()
    assert not list(tmp_path.glob("textloom-*/*"))
