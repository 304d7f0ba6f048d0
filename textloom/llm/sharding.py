"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are range-partitioned by id and sorted inside their partition, and the narrow digest (no
text) is written once with its partition. Per-partition totals (one row per partition) give every partition its
global start; a running sum inside the partition gives every row its own. A row belongs to the
shard in which its first byte falls, so shards are contiguous in id order and differ by at most
one row's size.

Defined results: null text has size 8 and the checksum of the empty string; null ids come first;
rows that tie on id are ordered by checksum and size, equal rows are interchangeable; an empty
table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

N_SHARDS = 24
ROW_OVERHEAD = 8


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row, its place in the whole order, which is unique."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # the position in the input only parts equal rows, so that no run of ties lands in one task
    tie = F.monotonically_increasing_id()
    order = ["doc_id", "text_crc32", "size", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("tie", tie).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(ranged.select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranged")
    inside = Window.partitionBy("part").orderBy("at")
    placed = stored.select(
        "doc_id",
        "size",
        "text_crc32",
        "part",
        (F.row_number().over(inside) - 1).alias("part_row"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("part_start"),
    )

    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per partition: bounded by the number of shuffle partitions
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("bytes_all"),
    )
    offset = F.col("part_start") + F.col("bytes_before")
    sharded = placed.join(F.broadcast(starts), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"cast((part_start + bytes_before) * cast({n_shards} as decimal(10, 0)) div bytes_all as int)").alias("shard"),
        (F.col("part_row") + F.col("rows_before")).alias("row"),
        offset.alias("offset"),
    )
    # one row per shard
    firsts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
