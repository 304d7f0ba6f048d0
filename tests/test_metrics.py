import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import classification as C
from textloom.operators import encoders as E
from textloom.operators import ranking, sequence
from textloom.operators.slices import slice_table


def scores(spark, ys, ps):
    data = [(s, i, float(y), None if p is None else float(p)) for s, (yy, pp) in enumerate(zip(ys, ps, strict=True)) for i, (y, p) in enumerate(zip(yy, pp, strict=True))]
    return spark.createDataFrame(data, "sample_id long, label_idx int, y_true double, y_prob double")


def test_ranking_example(spark):
    r = ranking.metrics_at_k(scores(spark, [[1, 0, 1, 0]], [[0.9, 0.8, 0.1, 0.3]]), (3,)).first()
    assert (r["r-p@3"], r["p@3"], r["r@3"]) == (0.5, pytest.approx(1 / 3), 0.5)
    assert r["ndcg@3"] == pytest.approx(0.61315, abs=1e-5)
    top = ranking.ranked(scores(spark, [[0, 0, 0]], [[0.5, 0.9, 0.5]])).filter("rn <= 2").orderBy("rn").collect()
    assert [x.label_idx for x in top] == [1, 2]
    assert ranking.per_sample(scores(spark, [[0, 0]], [[float("nan"), None]]), (1, None)).first()["ndcg@1"] == 0


def test_ndcg_ties_against_direct_formula(spark):
    rnd = random.Random(1)
    ys = [[rnd.randint(0, 2) for _ in range(6)] for _ in range(30)]
    ps = [[round(rnd.random(), 1) for _ in range(6)] for _ in range(30)]
    got = {r.sample_id: r["ndcg@4"] for r in ranking.per_sample(scores(spark, ys, ps), (4,)).collect()}
    for s, (y, p) in enumerate(zip(ys, ps, strict=True)):
        disc = [1 / math.log2(i + 2) if i < 4 else 0 for i in range(6)]
        order, dcg, at = sorted(set(p), reverse=True), 0.0, 0
        for v in order:
            g = [a for a, b in zip(y, p, strict=True) if b == v]
            dcg += sum(g) / len(g) * sum(disc[at : at + len(g)])
            at += len(g)
        ideal = sum(a * d for a, d in zip(sorted(y, reverse=True), disc, strict=True))
        assert got[s] == pytest.approx(dcg / ideal if ideal else 0)


def test_prf_and_guard(spark):
    ys, ps = [[1, 0], [1, 1], [0, 1]], [[0.9, 0.2], [0.8, 0.3], [0.7, 0.9]]
    r = C.prf(C.decide(scores(spark, ys, ps), "multilabel")).first()
    assert (r["micro.p"], r["micro.r"], r["macro.p"]) == (0.75, 0.75, pytest.approx((2 / 3 + 1) / 2))
    assert r["hamming_loss"] == pytest.approx(2 / 6)
    lone = C.prf(C.decide(scores(spark, [[1]] * 400, [[0.9]] + [[0.1]] * 399), "multilabel")).first()
    assert (lone["micro.p"], lone["acc"]) == (0, 0)
    m = C.prf(C.decide(scores(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 0]], [[0.1, 0.8, 0.1], [0, 1, 0], [0, 0, 1], [0, 1, 0]]), "multiclass"), "multiclass").first()
    assert m["acc"] == 0.75 and "hamming_loss" not in m.asDict()
    assert set(C.prf(C.decide(scores(spark, ys, ps), "binary"), "binary").columns) == {"macro.f1", "macro.p", "macro.r", "acc"}


def test_entities(spark):
    df = spark.createDataFrame([(1, ["B-PER", "I-PER", "O"], ["B-PER", "O", "O"])], "s int, gold array<string>, pred array<string>")
    r = sequence.entity_prf(df).first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0) and r.accuracy == pytest.approx(2 / 3)
    one = spark.createDataFrame([(1, ["O", "I-PER", "I-LOC"]), (2, []), (3, ["B-X", "B-X", "I-X", "O", "I-X"])], "s int, labels array<string>")
    assert sorted((x.s, x["type"], x["first"], x["last"]) for x in sequence.chunks(one, ["s"]).collect()) == [(1, "LOC", 2, 2), (1, "PER", 1, 1), (3, "X", 0, 0), (3, "X", 1, 2), (3, "X", 4, 4)]
    lg = spark.createDataFrame([(1, [[0.1, 0.9], [0.8, 0.2]], [-100, 1])], "s int, lg array<array<double>>, ids array<int>")
    assert [tuple(x) for x in sequence.aligned(lg, ["s"], "lg", "ids", {0: "O", 1: "B-X"}).collect()] == [(1, ["B-X"], ["O"])]
    assert sequence.entity_prf(df.limit(0)).first().accuracy is None


def test_encoders(spark):
    with pytest.raises(ValueError):
        E.BinaryEncoder(["a", "b", "c"])
    m = E.MultilabelEncoder(["a", "b", "c"])
    df = spark.createDataFrame([(["c", "a"],)], "l array<string>")
    v = df.select(m.vectorize(F.col("l")).alias("v"))
    assert v.first().v == [1, 0, 1] and v.select(m.unvectorize(F.col("v"))).first()[0] == ["a", "c"]
    b = E.ENCODERS["binary"](["n", "y"])
    assert spark.range(1).select(b.vectorize(F.lit("y")), b.unvectorize(F.lit(0))).first()[:] == (1, "n")
    lab = spark.createDataFrame([(["I-PER", "B-PER", "B-LOC"],)], "labels array<string>")
    assert [r.label for r in E.label_list(lab).orderBy("id").collect()] == ["O", "B-LOC", "B-PER", "I-PER"]


def test_slices(spark):
    s = slice_table(spark, "2020-01-01", "2020-01-21").orderBy("slice_id").collect()
    assert len(s) == 3 and s[2].step_start == s[2].step_end
    assert slice_table(spark, "2010-01-01", "2025-01-01").count() == 548


def test_too_many_labels_are_an_error(spark, monkeypatch):
    from textloom.operators import encoders, stats

    df = spark.range(6).selectExpr("cast(id as string) as label", "array(concat('B-', id)) as labels", "array('x') as tokens")
    assert len(encoders.vocabulary(df, "label", 6)) == len(stats.tags(df)) == 6
    with pytest.raises(ValueError, match="numbered"):
        encoders.vocabulary(df, "label", 5)
    monkeypatch.setattr(stats, "MAX_TAGS", 5)
    with pytest.raises(ValueError, match="label_counts"):
        stats.tags(df)
