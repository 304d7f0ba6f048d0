"""Runs whose files are there all together or not at all.

A run writes below a folder of its own and is then named in a log, one small file per run that appears by a
rename. Readers take only what the log names. A run that fails, or whose driver is lost, leaves nothing that a
reader sees, and the same run id may be run again: what it left behind is overwritten, and if it had been
committed nothing is done.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.sinks.writers import few_listing_tasks, write_articles

LOG = "runs"


class Log:
    """Small JSON records by name in a folder of any of Hadoop's file systems; each is written once, whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.folder, self._fs = folder, self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, name: str) -> dict[str, Any] | None:
        at = self._path(f"{self.folder}/{name}.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def put(self, name: str, record: dict[str, Any]) -> bool:
        """Whether the record is now that of the name; the first one written stays."""
        hidden, at = self._path(f"{self.folder}/.{name}"), self._path(f"{self.folder}/{name}.json")
        if self._fs.exists(at):
            return False
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(json.dumps(record, ensure_ascii=False).encode()))
        finally:
            stream.close()
        return self._fs.rename(hidden, at)

    def names(self) -> list[str]:
        root = self._path(self.folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n.removesuffix(".json") for n in found if n.endswith(".json") and not n.startswith("."))

    def remove_tree(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def commit_articles(df: DataFrame, path: str, run: str, rows_per_file: int = 10_000, order: list[str] | None = None) -> dict[str, Any]:
    """The log record of a run that writes df as JSON lines and CSV: run, rows, first_shard, shards.

    Files of an order are numbered on after those of the runs committed before; shards are the run's own.
    Runs of one folder are to be committed one after another.
    """
    log = Log(df.sparkSession, f"{path}/{LOG}")
    if (done := log.get(run)) is not None:
        return done
    earlier = [log.get(r) for r in log.names()]
    first = max([0, *(r["first_shard"] + r["shards"] for r in earlier)])
    folder = f"{path}/run={run}"
    log.remove_tree(folder)
    done = write_articles(df, folder, rows_per_file, order)
    if done is not None:  # as numbered
        rows, shards = done
        log.put(run, {"run": run, "rows": rows, "first_shard": first, "shards": shards})
        return log.get(run)
    found = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{folder}/jsonl") if log._fs.exists(log._path(f"{folder}/jsonl")) else None
    rows = df.sparkSession.read.text(f"{folder}/jsonl", recursiveFileLookup=True).count() if found is not None else 0
    log.put(run, {"run": run, "rows": rows, "first_shard": first, "shards": found.count() if found is not None else 0})
    return log.get(run)


def read_articles(spark: SparkSession, path: str, schema: str | StructType, form: str = "jsonl") -> DataFrame:
    """The rows of all committed runs under their schema, with run and, where files have an order, the shard numbered over all runs (else null)."""
    log = Log(spark, f"{path}/{LOG}")
    done = [r for r in map(log.get, log.names()) if r["rows"]]
    if not done:
        return spark.createDataFrame([], schema).select("*", F.lit("").alias("run"), F.lit(0).alias("shard"))
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("header", True).option("escape", '"')
    with few_listing_tasks(spark):
        rows = reader.format("json" if form == "jsonl" else "csv").load([f"{path}/run={r['run']}/{form}" for r in done])
    at = F.col("_metadata.file_path")
    rows = rows.select("*", F.regexp_extract(at, f"/run=([^/]+)/{form}/", 1).alias("run"), F.regexp_extract(at, "/shard=([0-9]+)/", 1).try_cast("int").alias("shard"))
    first = F.create_map(*[F.lit(x) for r in done for x in (r["run"], r["first_shard"])])
    return rows.withColumn("shard", F.col("shard") + F.element_at(first, F.col("run")))
