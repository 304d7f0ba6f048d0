"""Sinks: CSV and JSON lines, rolling shards, per-language files, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.scratch import stored

#: Files of an order are written by tasks of about so many rows, one after another; larger files by a task each.
TASK_ROWS = 10_000

#: Folders of files are listed by at most so many tasks.
LISTING_TASKS = 64


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats that cannot hold them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_articles(df: DataFrame, path: str, rows_per_file: int = 10_000, order: list[str] | None = None) -> tuple[int, int] | None:
    """Append df as CSV and JSON lines, at most rows_per_file rows a file; nothing is written for no rows.

    With an order, files are full but for the last one and hold consecutive rows: each is one task's, named by
    its folder shard=N. The rows and the files are then given back.
    """
    if df.isEmpty():
        return (0, 0) if order else None
    done = None
    if order:
        numbered = rolling_shard(df, order, rows_per_file)
        rows, last = numbered.agg(F.count("*"), F.max("shard")).first()
        done = rows, last + 1
        out = dealt_by_shard(numbered, order, rows_per_file, last + 1)
        writer = lambda x: x.write.mode("append").partitionBy("shard")
    else:
        out = df
        writer = lambda x: x.write.mode("append").option("maxRecordsPerFile", rows_per_file)
    writer(out).json(f"{path}/jsonl")
    writer(flat(out)).option("header", True).option("escape", '"').csv(f"{path}/csv")
    return done


def dealt_by_shard(numbered: DataFrame, order: list[str], rows_per_file: int, files: int, first: int = 0) -> DataFrame:
    """Rows of the shards from `first` on, in order, whole shards to tasks of about TASK_ROWS rows.

    So the number of tasks, and what each reports to the driver, follows the rows and not the files; a task's
    number is known from the shard, so none are sampled.
    """
    each = max(1, TASK_ROWS // rows_per_file)
    return numbered.repartitionById(-(-files // each), F.floor((F.col("shard") - first) / each).cast("int")).sortWithinPartitions("shard", *order)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """What is loaded in here has its folders listed by at most LISTING_TASKS tasks (else by a task each, up to 10,000).

    Each task reports kilobytes of its own to the driver, a file some hundred bytes. The session's setting is put back.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), LISTING_TASKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rolling_shard(df: DataFrame, order: list[str], rows_per_file: int) -> DataFrame:
    """df with `shard`: consecutive runs of rows_per_file rows in order, without one global window.

    Range partitions are written once with their number and counted; a row's number is its partition's start
    plus its own rank. Both come from what was written, so they agree whatever is computed again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_at")))
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_at")))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").withColumn("shard", F.floor((F.col("_r") + F.col("_s") - 1) / rows_per_file).cast("int")).drop("_p", "_at", "_r", "_s")


def write_sentences(df: DataFrame, path: str) -> None:
    """sentence,labels per language (and split), as partition folders."""
    by = [c for c in ("lang", "split") if c in df.columns]
    df.select(*by, F.array_join("tokens", " ").alias("sentence"), F.array_join("labels", " ").alias("labels")).write.mode("overwrite").partitionBy(*by).option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Records as JSON lines under the commit protocol; none at all is an error."""
    from textloom.sources.records import MergeError

    if df.isEmpty():
        raise MergeError(f"no records for {path}")
    df.write.mode("overwrite").json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def dump_metrics(epochs: list[dict], model: str, folder: Path, meta: dict | None = None, multiplier: float = 1) -> Path:
    scaled = [{k: v * multiplier for k, v in e.items()} for e in epochs]
    to = folder / f"{model}_metrics.json"
    to.write_text(json.dumps({"epochs": scaled, "model_name": model, **(meta or {})}, ensure_ascii=False, indent=2), encoding="utf-8")
    return to
