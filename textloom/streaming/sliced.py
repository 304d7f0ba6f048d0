"""Streaming forms of sliced processing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.sinks.runs import Log
from textloom.sinks.writers import TASK_ROWS, dealt_by_shard, few_listing_tasks, rolling_shard


def tumbling_counts(events: DataFrame, ts: str, by: list[str], width: str = "10 days", start: str = "0 seconds", watermark: str | None = None) -> DataFrame:
    """Counts per tumbling window; works on batches and, with a watermark, on streams."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        df = df.withWatermark(ts, watermark)
    w = F.window(ts, width, startTime=start)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def dedup(events: DataFrame, ts: str, keys: list[str], watermark: str = "10 days") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run callback on everything there is, then stop."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Control:
    """A flag that ends the work after the batch at hand."""

    stop: bool = False


@dataclass
class RunState:
    """What goes from batch to batch: the files and rows written, and whatever JSON a callback adds to `values`."""

    rows_per_file: int = 10_000
    file_number: int = 0
    rows_written: int = 0
    values: dict[str, Any] = field(default_factory=dict)


def rolling_batches(stream: DataFrame, path: str, checkpoint: str, state: RunState, control: Control | None = None, on_batch: Callable[[DataFrame, RunState], None] | None = None, order: list[str] | None = None) -> StreamingQuery:
    """Append each batch as files of at most state.rows_per_file rows, numbered on from batch to batch.

    The state after each batch is logged beside the stream's checkpoint, so a new process goes on with the numbers
    and values of the last batch (values that the caller's state has already stay). A batch that is run again after
    a failure overwrites its own folder; if its state was logged it is left alone. With an order a batch's files
    hold consecutive rows, are full but for its last one, and are named shard=N by their number in the whole run.
    A set stop flag skips what is left, which a later run takes up.
    """
    spark = stream.sparkSession
    log, control = Log(spark, f"{checkpoint}/run-state"), control or Control()

    def restore(before: int | None = None) -> None:
        known = [int(n) for n in log.names() if before is None or int(n) < before]
        if known:
            last = log.get(str(max(known)))
            state.file_number, state.rows_written = last["file_number"], last["rows_written"]
            state.values = {**last["values"], **state.values}

    def write(batch: DataFrame, number: int) -> None:
        if log.get(str(number)) is not None:
            return
        if control.stop:
            raise Stopped(f"stopped before batch {number}")
        restore(number)
        out, files, rows = f"{path}/batch={number}", 0, batch.count()
        log.remove_tree(out)
        if rows and order:
            numbered = rolling_shard(batch, order, state.rows_per_file).withColumn("shard", F.col("shard") + state.file_number)
            files = -(-rows // state.rows_per_file)
            dealt_by_shard(numbered, order, state.rows_per_file, files, state.file_number).write.mode("overwrite").partitionBy("shard").json(out)
        elif rows:
            batch.write.mode("overwrite").option("maxRecordsPerFile", state.rows_per_file).json(out)
            files = -(-rows // state.rows_per_file)
        state.rows_written, state.file_number = state.rows_written + rows, state.file_number + files
        if on_batch:
            on_batch(batch, state)
        log.put(str(number), {"file_number": state.file_number, "rows_written": state.rows_written, "rows": rows, "files": files, "values": state.values})

    restore()
    return each_batch(stream, write, checkpoint)


def read_batches(spark: SparkSession, path: str, checkpoint: str, schema: str | StructType) -> DataFrame:
    """The rows of all batches written to path; the schema may name batch and, where files have an order, shard.

    Small files are read by tasks of about TASK_ROWS rows, as they were written; the rows are those of the run's log.
    """
    log = Log(spark, f"{checkpoint}/run-state")
    rows = max((log.get(n)["rows_written"] for n in log.names()), default=0)
    with few_listing_tasks(spark):
        found = spark.read.schema(schema).option("basePath", path).json(path)
    return found.coalesce(-(-rows // TASK_ROWS)) if rows else found


class Stopped(RuntimeError):
    """The control's flag was set; the batch is not committed and runs again next time."""
