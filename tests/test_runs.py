import json

import pytest
from pyspark.sql import functions as F

from textloom.sinks import runs
from textloom.sinks import writers as runs_writers
from textloom.streaming import sliced

SCHEMA = "id long, xs array<string>"


def test_run_that_breaks_leaves_nothing(spark, tmp_path, monkeypatch):
    """Broken between its two forms, or before the log: no row is seen, and the same run writes them once."""
    path, df = str(tmp_path), spark.range(25).selectExpr("id", "array('a') as xs")
    real = runs.write_articles

    def halfway(d, folder, n, order):
        d.write.json(f"{folder}/jsonl/shard=0")
        raise OSError("lost")

    def unnamed(d, folder, n, order):
        real(d, folder, n, order)
        raise OSError("lost")

    for broken in (halfway, unnamed):
        monkeypatch.setattr(runs, "write_articles", broken)
        with pytest.raises(OSError):
            runs.commit_articles(df, path, "a", 10, ["id"])
        assert runs.read_articles(spark, path, SCHEMA).count() == 0
    monkeypatch.setattr(runs, "write_articles", real)
    done = runs.commit_articles(df, path, "a", 10, ["id"])
    assert done == {"run": "a", "rows": 25, "first_shard": 0, "shards": 3} == runs.commit_articles(df, path, "a", 10, ["id"])
    runs.commit_articles(df.withColumn("id", F.col("id") + 100), path, "b", 10, ["id"])
    runs.commit_articles(df.limit(0), path, "none", 10, ["id"])
    rows = runs.read_articles(spark, path, SCHEMA).groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("f")).collect()
    assert sorted(map(tuple, rows)) == [(0, 10, 0), (1, 10, 10), (2, 5, 20), (3, 10, 100), (4, 10, 110), (5, 5, 120)]
    assert runs.read_articles(spark, path, "id long, xs string", "csv").count() == 50


def _stream(spark, folder):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(folder)


@pytest.mark.parametrize("lost", ["before", "after", None])
def test_state_outlives_its_process(spark, tmp_path, monkeypatch, lost):
    """A batch broken before its state is logged, or after it: a new state goes on with the same numbers and values."""
    for i, n in enumerate((7, 5, 3, 8)):
        spark.range(n).selectExpr(f"id + {100 * i} as id").coalesce(1).write.json(f"{tmp_path}/in/part={i}")
    put, calls = sliced.Log.put, []

    def broken(self, name, record):
        calls.append(name)
        if lost and len(calls) == 2:
            if lost == "after":
                put(self, name, record)
            raise OSError("lost")
        return put(self, name, record)

    monkeypatch.setattr(sliced.Log, "put", broken)

    def hook(batch, state):
        state.values["seen"] = state.values.get("seen", 0) + batch.count()

    def start():
        state = sliced.RunState(rows_per_file=4)
        sliced.rolling_batches(_stream(spark, f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp", state, None, hook, ["id"]).awaitTermination()
        return state

    if lost:
        with pytest.raises(Exception, match="lost"):
            start()
    state = start()
    assert (state.rows_written, state.file_number, state.values) == (23, 7, {"seen": 23})
    found = spark.read.schema("id long, shard int, batch int").option("basePath", f"{tmp_path}/out").json(f"{tmp_path}/out")
    assert sorted(r[0] for r in found.select("shard").distinct().collect()) == list(range(7)) and found.count() == 23
    assert json.loads((tmp_path / "cp/run-state/3.json").read_text())["rows"] == 8
    again = start()
    assert (again.rows_written, again.file_number) == (23, 7)


def test_tasks_follow_rows_not_files(spark, tmp_path):
    """Many small files are some task's one after another, in batches and in streams, and still hold consecutive rows."""
    df = spark.range(405).selectExpr("id", "array('a') as xs")
    done = runs.commit_articles(df, f"{tmp_path}/run", "a", 4, ["id"])
    assert done == {"run": "a", "rows": 405, "first_shard": 0, "shards": 102}
    df.select("id").coalesce(1).write.json(f"{tmp_path}/in")
    sliced.rolling_batches(_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", sliced.RunState(rows_per_file=4, file_number=3), None, None, ["id"]).awaitTermination()
    for root, first in ((f"{tmp_path}/run/run=a/jsonl", 0), (f"{tmp_path}/out/batch=0", 3)):
        rows = spark.read.schema("id long").json(root).select("id", "shard", F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).alias("task")).collect()
        assert sorted((r.id, r.shard) for r in rows) == [(i, i // 4 + first) for i in range(405)]
        assert len({r.task for r in rows}) == 1


def test_listing_tasks_do_not_follow_files(spark, tmp_path):
    """102 folders of a file each are listed by fewer tasks, in runs and in batches, and all are found; the session keeps its setting."""
    df, setting = spark.range(405).selectExpr("id", "array('a') as xs"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    runs.commit_articles(df, f"{tmp_path}/run", "a", 4, ["id"])
    df.select("id").coalesce(1).write.json(f"{tmp_path}/in")
    sliced.rolling_batches(_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", sliced.RunState(rows_per_file=4), None, None, ["id"]).awaitTermination()
    sc, before = spark.sparkContext, spark.conf.get(setting)
    for group, read in (("runs", lambda: runs.read_articles(spark, f"{tmp_path}/run", SCHEMA)), ("batches", lambda: sliced.read_batches(spark, f"{tmp_path}/out", f"{tmp_path}/cp", "id long, shard int, batch int"))):
        sc.setJobGroup(group, "listing")
        rows = read()
        sc.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert 0 < sum(sc.statusTracker().getStageInfo(s).numTasks for s in stages) <= runs_writers.LISTING_TASKS < 102
        assert sorted((r.id, r.shard) for r in rows.select("id", "shard").collect()) == [(i, i // 4) for i in range(405)]
    assert rows.rdd.getNumPartitions() == 1 < spark.read.json(f"{tmp_path}/out").rdd.getNumPartitions()
    assert spark.conf.get(setting) == before


def test_large_files_are_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(runs_writers, "TASK_ROWS", 20)
    numbered = spark.range(100).selectExpr("id", "cast(id div 10 + 7 as int) as shard")
    for rows_per_file, files, tasks in ((10, 10, 5), (30, 10, 10)):
        got = runs_writers.dealt_by_shard(numbered, ["id"], rows_per_file, files, 7).select("id", "shard", F.spark_partition_id().alias("p")).collect()
        assert len({r.p for r in got}) == tasks and len({(r.p, r.shard) for r in got}) == 10 and len(got) == 100
