"""Stratified, seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "eval", "test")
DEFAULT_RATIOS = (0.8, 0.1, 0.1)


def normalized(ratios: tuple[float, float, float]) -> tuple[float, float, float]:
    total = sum(ratios)
    return tuple(r / total for r in ratios) if total > 0 else DEFAULT_RATIOS


def portable_order(key: Column, seed: int) -> Column:
    """A seeded order that other SQL engines can reproduce."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def stratified_split(df: DataFrame, by: str, key: str, ratios: tuple[float, float, float] = DEFAULT_RATIOS, seed: int = 2611) -> DataFrame:
    """df with `split`: per stratum the first floor(n * r) rows of a seeded order, the rest to test.

    Only counts per (stratum, hash bucket) and the keys of the buckets in which a split ends are shuffled; they
    give the last place of each split, which goes to the rows by broadcast (one row per stratum).
    """
    a, b, _ = normalized(ratios)
    order = portable_order(F.col(key), seed)
    bucket = F.conv(F.substring("_o", 1, 4), 16, 10).cast("int")
    places = df.select(F.col(by).alias("_by"), F.col(key).alias("_key"), order.alias("_o")).withColumn("_b", bucket)
    counts = places.groupBy("_by", "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_by")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_by", "_b", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"))
    n_train = F.floor(F.col("_total") * F.lit(float(a)))
    ends = counts.withColumns({"_e1": n_train, "_e2": n_train + F.floor(F.col("_total") * F.lit(float(b)))})
    holds = lambda e: (F.col("_start") < F.col(e)) & (F.col(e) <= F.col("_start") + F.col("_n"))
    ends = ends.filter(holds("_e1") | holds("_e2")).select(F.col("_by").alias("_by2"), F.col("_b").alias("_b2"), "_start", "_e1", "_e2")
    near = places.join(F.broadcast(ends), F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_b") == F.col("_b2")))  # two buckets per stratum
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_by", "_b").orderBy("_o", "_key"))
    place = F.struct("_o", "_key")
    last = lambda e: F.max(F.when(F.col("_rank") <= F.col(e), place))
    cuts = near.withColumn("_rank", rank).groupBy("_by").agg(last("_e1").alias("_train"), last("_e2").alias("_eval"))
    cuts = cuts.select(F.col("_by").alias("_stratum"), "_train", "_eval")
    rows = df.withColumn("_place", F.struct(order.alias("_o"), F.col(key).alias("_key")))
    rows = rows.join(F.broadcast(cuts), F.col(by).eqNullSafe(F.col("_stratum")), "left")
    split = F.when(F.col("_place") <= F.col("_train"), SPLITS[0]).when(F.col("_place") <= F.col("_eval"), SPLITS[1]).otherwise(SPLITS[2])
    return rows.select(*df.columns, split.alias("split"))
