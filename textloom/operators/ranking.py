"""Ranking metrics at k over long scores (sample_id, label_idx, y_true, y_prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K_VALUES = (1, 3, 5, 7, 9)


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with NaN and null as 0, rank by score (ties: higher index first) and the ideal rank."""
    clean = scores.select("sample_id", "label_idx", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in ("y_true", "y_prob")])
    w = Window.partitionBy("sample_id")
    return clean.select(
        "*",
        F.row_number().over(w.orderBy(F.desc("y_prob"), F.desc("label_idx"))).alias("rn"),
        F.row_number().over(w.orderBy(F.desc("y_true"))).alias("ideal"),
        F.avg("y_true").over(Window.partitionBy("sample_id", "y_prob")).alias("y_tied"),
    )


def per_sample(scores: DataFrame, ks: tuple[int | None, ...] = K_VALUES) -> DataFrame:
    """One row per sample with r-p, p, r and ndcg for every k in one pass; k None is the sample's own total."""
    r = ranked(scores)
    total = F.sum("y_true")
    cols = [total.alias("total")]
    for k in ks:
        n = "all" if k is None else str(k)
        top = lambda rank, k=k: F.lit(True) if k is None else F.col(rank) <= k
        gain = lambda y, rank, k=k: F.sum(F.when(top(rank), F.col(y) / F.log2(F.col(rank) + 1)).otherwise(0.0))
        cols += [gain("y_tied", "rn").alias(f"dcg_{n}"), gain("y_true", "ideal").alias(f"idcg_{n}")]
        if k is not None:
            cols.append(F.sum(F.when(F.col("rn") <= k, F.col("y_true")).otherwise(0.0)).alias(f"hit_{n}"))
    if None in ks:
        r = r.withColumn("own", F.floor(F.sum("y_true").over(Window.partitionBy("sample_id"))))
        cols.append(F.sum(F.when(F.col("rn") <= F.col("own"), F.col("y_true")).otherwise(0.0)).alias("hit_all"))
    g = r.groupBy("sample_id").agg(*cols)
    out = []
    for k in ks:
        n = "all" if k is None else str(k)
        s = "" if k is None else f"@{k}"
        kk = F.floor("total") if k is None else F.lit(k)
        div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        out += [
            div(F.col(f"hit_{n}"), F.least(F.col("total"), kk.cast("double"))).alias(f"r-p{s}"),
            div(F.col(f"hit_{n}"), kk).alias(f"p{s}"),
            div(F.col(f"hit_{n}"), F.col("total")).alias(f"r{s}"),
            div(F.col(f"dcg_{n}"), F.col(f"idcg_{n}")).alias(f"ndcg{s}"),
        ]
    return g.select("sample_id", *out)


def metrics_at_k(scores: DataFrame, ks: tuple[int | None, ...] = K_VALUES, prefix: str = "") -> DataFrame:
    """One row: the means over samples."""
    p = per_sample(scores, ks)
    return p.agg(*[F.avg(f"`{c}`").alias(prefix + c) for c in p.columns if c != "sample_id"])


def r_precision_at_k(scores: DataFrame, k: int | None) -> DataFrame:
    s = "" if k is None else f"@{k}"
    return per_sample(scores, (k,)).select("sample_id", F.col(f"`r-p{s}`").alias("r_precision"))


def long_form(df: DataFrame, key: str, truth: str, probs: str) -> DataFrame:
    """Array columns as long scores."""
    z = df.select(F.col(key).alias("sample_id"), F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(probs).alias("p"))).alias("label_idx", "x"))
    return z.select("sample_id", "label_idx", F.col("x.t").cast("double").alias("y_true"), F.col("x.p").cast("double").alias("y_prob"))


