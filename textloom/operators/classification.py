"""Multilabel, multiclass and binary metrics over long predictions (sample_id, label_idx, y_true, y_prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AVERAGES = ("micro", "macro", "weighted")


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def argmax(values: Column) -> Column:
    """Index of the first maximum."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def decide(scores: DataFrame, kind: str, threshold: float = 0.5) -> DataFrame:
    """sample_id, label_idx, t, p (0/1). Multiclass: the arg max of each sample."""
    if kind == "multilabel":
        return scores.select("sample_id", "label_idx", F.col("y_true").cast("int").alias("t"), (F.col("y_prob") > threshold).cast("int").alias("p"))
    best = scores.groupBy("sample_id").agg(F.max_by("label_idx", F.struct("y_prob", -F.col("label_idx"))).alias("best"))
    joined = scores.join(best, "sample_id")
    return joined.select("sample_id", "label_idx", F.col("y_true").cast("int").alias("t"), (F.col("label_idx") == F.col("best")).cast("int").alias("p"))


def per_label(decided: DataFrame) -> DataFrame:
    c = lambda cond: F.sum(F.expr(cond).cast("long"))
    return decided.groupBy("label_idx").agg(c("t = 1 and p = 1").alias("tp"), c("t = 0 and p = 1").alias("fp"), c("t = 1 and p = 0").alias("fn"))


def prf(decided: DataFrame, kind: str = "multilabel", prefix: str = "", guard: bool = True) -> DataFrame:
    """One row of micro, macro and weighted f1, p, r, accuracy and (multilabel) Hamming loss.

    guard: p, r and f1 are 0 where p > 0.99 rests on at most max(2, samples / 100) predictions;
    accuracy is 0 on so few predictions whatever p is. Predictions of class id 0 do not count as
    predictions for multiclass and binary.
    """
    labels = per_label(decided).withColumns({"lp": _div(F.col("tp"), F.col("tp") + F.col("fp")), "lr": _div(F.col("tp"), F.col("tp") + F.col("fn")), "sup": F.col("tp") + F.col("fn")})
    labels = labels.withColumn("lf", _div(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    used = F.expr("sup > 0 or fp > 0")
    s = {c: F.sum(c) for c in ("tp", "fp", "fn", "sup")}
    agg = {"micro.p": _div(s["tp"], s["tp"] + s["fp"]), "micro.r": _div(s["tp"], s["tp"] + s["fn"]), "micro.f1": _div(2.0 * s["tp"], 2 * s["tp"] + s["fp"] + s["fn"])}
    for name, c in (("p", "lp"), ("r", "lr"), ("f1", "lf")):
        agg[f"macro.{name}"] = F.avg(c) if kind == "multilabel" else F.avg(F.when(used, F.col(c)))
        agg[f"weighted.{name}"] = _div(F.sum(F.col(c) * F.col("sup")), s["sup"])
    scores = labels.agg(*[e.alias(n.replace(".", "_")) for n, e in agg.items()])
    nonzero = "p = 1" if kind == "multilabel" else "p = 1 and label_idx > 0"
    samples = decided.groupBy("sample_id").agg(F.min((F.col("t") == F.col("p")).cast("int")).alias("exact"), F.sum((F.col("t") != F.col("p")).cast("long")).alias("wrong"), F.count("*").alias("n"), F.sum(F.expr(f"int({nonzero})")).alias("predicted"))
    whole = samples.agg(F.avg("exact").alias("acc"), (F.sum("wrong") / F.sum("n")).alias("hamming"), F.sum("predicted").alias("predicted"), F.count("*").alias("samples"))
    one = scores.crossJoin(F.broadcast(whole))  # one row by one row
    few = F.col("predicted") <= F.greatest(F.lit(2.0), F.col("samples") / 100)
    averages = ("macro",) if kind == "binary" else AVERAGES
    out = []
    for a in averages:
        zero = few & (F.col(f"{a}_p") > 0.99) if guard else F.lit(False)
        out += [F.when(zero, 0.0).otherwise(F.col(f"{a}_{m}")).alias(f"{prefix}{a}.{m}") for m in ("f1", "p", "r")]
    out.append(F.when(few & F.lit(guard), 0.0).otherwise(F.col("acc")).alias(f"{prefix}acc"))
    if kind == "multilabel":
        out.append(F.col("hamming").alias(f"{prefix}hamming_loss"))
    return one.select(*out)
