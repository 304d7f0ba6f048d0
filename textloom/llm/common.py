"""Helpers shared by the training-data operators."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder and everything runs in one process.
LOCAL_CHECKPOINT_DIR = "file:///tmp/checkpoints"

#: ASCII white space of the word contract: space, \t, \n, \v, \f, \r.
NON_WORD = "[\\x20\\x09-\\x0D]"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return LOCAL_CHECKPOINT_DIR
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/textloom-{uuid.uuid4().hex}/{label}"


_scopes = threading.local()


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the tables that materialize() wrote inside it, but for those given to keep()."""
    made: list[str] = []
    _open_scopes().append(made)
    try:
        yield
    finally:
        _open_scopes().pop()
        for path in made:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """df, as materialize() gave it, which outlives the scratch() at hand and belongs to the one around it."""
    stack, path = _open_scopes(), df.__dict__["scratch_path"]
    if stack and path in stack[-1]:
        stack[-1].remove(path)
        if len(stack) > 1:
            stack[-2].append(path)
    return df


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and every reader sees the
    same rows even if the plan above was not deterministic.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if _open_scopes():
        _open_scopes()[-1].append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["scratch_path"] = path
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    _delete(df.sparkSession, df.__dict__["scratch_path"])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from names that df does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_tl_{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{NON_WORD}+"), "")


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it is small enough, otherwise as it is (a shuffle join)."""
    return F.broadcast(df) if bounded(df, max_rows) else df


def salt_of(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def spread_back(rows: DataFrame, key: str, salt: str, values: DataFrame, how: str = "left") -> DataFrame:
    """Join values (key, salts, ...) to rows (key, salt, ...) with hot keys dealt over their salts.

    values has one row per key and, in `salts`, the salts under which rows has that key; each key
    is repeated once per such salt, so a key with a third of all rows meets its rows in that many
    tasks, and the repeats never outnumber the distinct (key, salt) pairs.
    """
    dealt = values.withColumn(salt, F.explode("salts")).drop("salts")
    return rows.join(dealt, [key, salt], how)
