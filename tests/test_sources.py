from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom import config, schemas
from textloom.operators.articles import monitored, sanitize
from textloom.plans import corpus, datasets
from textloom.sinks import writers
from textloom.sources import records, search
from textloom.streaming import sliced

ART = {
    "uuid": "u", "created": "2010-01-02", "published": None, "language": "sl", "url": "http://x", "media": {"uuid": "m", "name": "M", "tags": [{"class": "aMediaType", "name": "tv"}, {"class": "bMediaType", "name": "radio"}]},
    "country": {"name": "SI"}, "rubric": None, "tags": [{"uuid": "t1", "class": "x.CustomerTopicGroup"}, {"uuid": "t2", "class": "y"}], "translations": {"sl": {"title": " T ", "body": "T http://x rest of Petrol"}},
}


def frame(spark, *changes):
    return spark.createDataFrame([{**ART, **c} for c in changes], schemas.ARTICLE)


def test_sanitize(spark):
    df = sanitize(frame(spark, {}, {"translations": {"en": {"title": "x", "body": ""}}}, {"media": None}))
    (r,) = df.collect()
    assert (r.title, r.body, r.media_type, r.section_name, r.country) == ("T", "rest of Petrol", "radio", "", "SI")
    got = frame(spark, {}).select(monitored(F.col("tags"), {"t1": "One"}).alias("m")).first().m
    assert [(x.uuid, x.name) for x in got] == [("t1", "One")]


def test_company_plan(spark):
    spec = datasets.ScanSpec("2010-01-01", "2010-02-01")
    c = datasets.CompanySpec({"t1": "One"}, {"petrol": ["Petrol*"]}, {"re": ["rest of"], "petrol": ["of petrol"]})
    rows = datasets.company_articles(frame(spark, {}, {"uuid": "v", "created": "2011-01-01"}, {"uuid": "w", "tags": None}), spec, c).collect()
    assert [(r.uuid, r.matched, r.matches, r.monitored) for r in rows] == [("u", ["petrol", "re"], ["Petrol", "rest of", "of petrol"], ["One"])]
    k = datasets.keyword_articles(frame(spark, {}, {}), spec, {"a": ["Petrol"], "b": ["nothing"]}).collect()
    assert [(r.uuid, r.categories) for r in k] == [("u", ["a"])]


def index(documents):
    """A search index over documents for search.post: filters by range and terms, sorts, and pages by search_after."""
    asked = []

    def post(url, body, *args, **kw):
        asked.append(body)
        found = documents
        for f in body["query"]["bool"]["filter"]:
            if "range" in f:
                r = f["range"]["created"]
                found = [d for d in found if all({"gte": d["created"] >= v, "gt": d["created"] > v, "lt": d["created"] < v, "lte": d["created"] <= v}[k] for k, v in r.items())]
            if "terms" in f:
                found = [d for d in found if d["media"]["uuid"] in f["terms"]["media.uuid"]]
        found = sorted(found, key=lambda d: (d["created"], d["uuid"]))
        rest = [d for d in found if [d["created"], d["uuid"]] > body["search_after"]] if "search_after" in body else found[body["from"] :]
        return {"hits": {"total": {"value": len(found)}, "hits": [{"_source": d, "sort": [d["created"], d["uuid"]]} for d in rest[: body["size"]]]}}

    return post, asked


def test_search_source(spark, monkeypatch):
    docs = [{"uuid": f"u{i}", "created": f"2020-01-0{1 + i // 5}T00:00:00", "media": {"uuid": f"m{i % 2}"}} for i in range(12)]  # many ties
    post, asked = index(docs)
    monkeypatch.setattr(search, "post", post)
    r = search.PushingReader({"start": "2020-01-01", "end": "2020-01-05", "limit": "2"})
    (part,) = r.partitions()
    rows = list(r.read(part))
    assert sorted(x[1] for x in rows) == sorted(d["uuid"] for d in docs) and {x[5] for x in rows} == {12}
    assert "from" in asked[0] and all("search_after" in b for b in asked[1:])
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains

    left = list(r.pushFilters([GreaterThanOrEqual(("created",), "2020-01-02T00:00:00"), In(("media",), ("m1", "m2")), EqualTo(("uuid",), "x"), StringContains(("source",), "y")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringContains"]
    assert sorted(x[1] for x in r.read(part)) == sorted(d["uuid"] for d in docs if d["created"] >= "2020-01-02T00:00:00" and d["media"]["uuid"] == "m1")
    assert len(list(search.SearchReader({"start": "2020-01-01", "end": "2020-01-05", "limit": "5", "limit_total": "7", "offset": "3"}).read(part))) == 7
    assert len(search.slices("2010-01-01", "2025-01-01", 10)) == 548


def test_search_clauses():
    assert search.query_of(["Petrol", "jekl*"], ["rast pri*"]) == {
        "bool": {
            "minimum_should_match": 1,
            "should": [
                {"match": {"text": "Petrol"}},
                {"prefix": {"text": "jekl"}},
                {"span_near": {"slop": 0, "in_order": True, "clauses": [{"span_multi": {"match": {"prefix": {"text": {"value": w}}}}} for w in ("rast", "pri")]}},
            ],
        }
    }
    assert search.query_of() is None and search.phrase_clause("a b") == {"match_phrase": {"text": "a b"}}
    body = search.request_body({"keywords": '["a"]', "query": '{"terms": {"x": [1]}}'}, search.Slice("s", "e"))
    assert len(body["query"]["bool"]["filter"]) == 3 and body["sort"][-1] == {"uuid": "asc"}


def test_search_over_http(spark):
    """The registered source against a server that is busy at first."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answer, seen = index([{"uuid": f"u{i:02d}", "created": "2020-01-01T00:00:00", "media": {"uuid": "m"}} for i in range(25)])[0], []
    bodies = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            bodies.append(body.decode())
            seen.append(self.headers.get("Authorization"))
            data = json.dumps(answer("", json.loads(body))).encode() if len(seen) > 1 else b""
            self.send_response(200 if data else 503)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        options = {"url": url, "user": "a", "password": "b", "start": "2020-01-01", "end": "2020-01-02", "days": "1", "limit": "10"}
        df = search.search_index(spark, **options)
        assert sorted(r.uuid for r in df.collect()) == [f"u{i:02d}" for i in range(25)] and set(seen) == {"Basic YTpi"}
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        assert search.search_index(spark, **options).filter("created > '2020-01-01T00:00:00'").count() == 0 and '"gt"' in bodies[-1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()


def test_config(tmp_path):
    assert config.deep_merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    (tmp_path / "data" / "act" / "n").mkdir(parents=True)
    (tmp_path / "n.yaml").write_text('{"a": {"x": 1}, "l": [1], "from": "root name"}')
    (tmp_path / "c1.yaml").write_text('{"from": "root extra", "c": 1}')
    (tmp_path / "data" / "n.yaml").write_text('{"a": {"y": 2}, "l": [2], "from": "script name"}')
    (tmp_path / "data" / "act" / "n" / "n.yaml").write_text('{"deep": 1}')
    got = config.stacked(tmp_path, "data", "act", "n", ("c1",))
    assert got == {"a": {"x": 1, "y": 2}, "l": [2], "from": "script name", "c": 1, "deep": 1}  # a level beats an earlier one, whatever the file
    assert config.stacked(tmp_path, "data", "n") == {"a": {"x": 1, "y": 2}, "l": [2], "from": "script name"}  # the action's name stands in
    sections = {"model": {"m"}, "train": {"lr"}}
    assert config.route({"model": {"m": 1}, "lr": 2, "z": 3}, sections) == {"model": {"m": 1}, "train": {"lr": 2}, "extra": {"z": 3}}
    assert config.route({"model": {"m": 1}, "m": 2}, sections) == {"model": {"m": 1}, "train": {}, "extra": {"m": 2}}  # nested first
    (tmp_path / "bad.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        config.load_yaml(tmp_path / "bad.yaml")
    assert config.run_name("ner", "x", 32, 5e-5) == "ner.x.b32.lr5e-05"
    dirs = config.run_dirs(tmp_path, "split", "ner")
    assert dirs["base"]["data"].is_dir() and dirs["ner"]["data"] == tmp_path / "result" / "data" / "ner" and set(dirs) == {"base", "split", "ner"}
    log = config.logger("x", dirs["base"]["log"])
    log.info("a line")
    assert "a line" in (tmp_path / "log" / "x.log").read_text()


def test_actions(tmp_path):
    from textloom import actions

    own = tmp_path / "actions" / "data" / "create"
    own.mkdir(parents=True)
    (own / "mine.py").write_text("def main(config, value, other=5):\n    return config, value, other\n")
    (tmp_path / "actions" / "data" / "extra").mkdir()
    (tmp_path / "actions" / "data" / "extra" / "__init__.py").write_text("def main(log):\n    return log.name\n")
    found = actions.tree(tmp_path)
    assert {"keywords", "companies", "mine"} <= set(found["data"]["create"]) and found["data"]["extra"] == [] and "run" in found["query"]
    (tmp_path / "conf" / "data" / "create").mkdir(parents=True)
    (tmp_path / "conf" / "data" / "create" / "mine.yaml").write_text('{"value": 7, "unused": 1}')
    assert actions.run(tmp_path, "data", "create", "mine", (), None) == ({"value": 7, "unused": 1}, 7, 5)
    assert actions.run(tmp_path, "data", "extra", None, (), None) == "textloom.extra"
    (tmp_path / "conf" / "data" / "create" / "mine.yaml").write_text("{}")
    with pytest.raises(ValueError, match="value"):
        actions.run(tmp_path, "data", "create", "mine", (), None)
    with pytest.raises(LookupError):
        actions.resolve(tmp_path, "data", "create", "nothing")


def test_command_line(spark, small, tmp_path, monkeypatch):
    from textloom import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["--root", str(tmp_path), "query", "run", "-s", "query=url_names", "-s", f"tables={small}", "-s", f"out={tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{small}/pages.parquet").count()
    rows = [{**ART, "uuid": f"u{i}"} for i in range(3)]
    spark.createDataFrame(rows, schemas.ARTICLE).write.json(f"{tmp_path}/articles")
    (tmp_path / "conf").mkdir(exist_ok=True)
    (tmp_path / "conf" / "k.yaml").write_text('{"categories": {"a": ["Petrol"]}, "dataset_src_start": "2010-01-01", "data": {"dataset_src_end": "2010-02-01"}}')
    cli.main(["--root", str(tmp_path), "data", "create", "keywords", "-c", "k", "-s", f"articles={tmp_path}/articles", "-s", f"out={tmp_path}/made"])
    assert spark.read.json(f"{tmp_path}/made/jsonl").count() == 3
    with pytest.raises(SystemExit):
        cli.main(["--root", str(tmp_path), "data", "create", "unknown"])


def test_prepare_split_analyze(spark, tmp_path):
    from textloom import actions

    (tmp_path / "setimes").mkdir()
    rows = "".join(f"1\ttok{i}\t\t\t\t\t\t\t\t\t{'B-per' if i % 2 else 'O'}\n\n" for i in range(20))
    (tmp_path / "setimes" / "set.sr.conll").write_text(rows)
    log = config.logger("analyze", tmp_path)
    actions.prepare_ner(spark, {"setimes": f"{tmp_path}/setimes"}, f"{tmp_path}/prepared")
    actions.split_ner(spark, f"{tmp_path}/prepared", f"{tmp_path}/splits")
    actions.analyze_ner(spark, f"{tmp_path}/splits", f"{tmp_path}/stats", log)
    assert {(r.lang, r.split, r.sentences) for r in spark.read.csv(f"{tmp_path}/stats/splits", header=True).collect()} == {("sr", "train", "16"), ("sr", "eval", "2"), ("sr", "test", "2")}
    from textloom.sources.records import found_splits, prepared_sentences

    assert found_splits(prepared_sentences(spark, f"{tmp_path}/splits")) == ["eval", "test", "train"]


def test_dates(spark):
    from textloom.functions import dates

    df = spark.createDataFrame([("2020-01-02T03:04:05+02:00",), ("2020-01-02 03:04:05.25",), ("2020-01-02",), ("junk",), (None,)], "v string").withColumn("t", dates.to_time(F.col("v")))
    got = [tuple(r) for r in df.select(dates.zulu(F.col("t")), dates.iso_offset(F.col("t")), dates.zulu(dates.end_or_day(F.col("t"), F.lit(None).cast("timestamp")))).collect()]
    assert got[0] == ("2020-01-02T01:04:05Z", "2020-01-02T01:04:05+00:00", "2020-01-03T01:04:05Z")
    assert got[1][0] == "2020-01-02T03:04:05.250000Z" and got[2][0] == "2020-01-02T00:00:00Z" and got[3] == got[4] == (None, None, None)


def test_rolling_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, n in enumerate((7, 5, 3)):
        spark.range(n).selectExpr(f"id + {100 * i} as id").coalesce(1).write.json(f"{tmp_path}/part{i}")
        next((tmp_path / f"part{i}").glob("*.json")).rename(tmp_path / "in" / f"{i}.json")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state, control = sliced.RunState(rows_per_file=4), sliced.Control()

    def on_batch(df, s):
        s.values["batches"] = s.values.get("batches", 0) + 1
        control.stop = s.values["batches"] == 2

    q = sliced.rolling_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", state, control, on_batch)
    with pytest.raises(Exception, match="stopped"):
        q.awaitTermination()
    assert state.values["batches"] == 2 and state.rows_written + 0 == spark.read.json(f"{tmp_path}/out").count()
    control.stop = False
    state.values["batches"] = 10
    sliced.rolling_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", state, control, on_batch).awaitTermination()
    assert state.rows_written == 15 == spark.read.json(f"{tmp_path}/out").count() and state.file_number >= 5


def test_stream(spark, small, tmp_path):
    batch = sliced.tumbling_counts(spark.read.parquet(f"{small}/events.parquet"), "ts", ["event_type"], "10 days")
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").write_bytes(Path(f"{small}/events.parquet").read_bytes())
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sliced.tumbling_counts(stream, "ts", ["event_type"], "10 days", watermark="1 day").writeStream.outputMode("complete").format("memory").queryName("tc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tc").collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    s = sliced.each_batch(sliced.dedup(stream, "ts", ["user_id"]), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    s.awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{small}/events.parquet").select("user_id").distinct().count()


def test_labels_in_sql_stay_in_their_rows(spark, small):
    """No token travels with its sentence: the statement has no shuffle."""
    from textloom import queries_tables  # noqa: F401  registers all queries
    from textloom import registry as Q
    from textloom import sql

    sql.register(spark)
    got = spark.sql("SELECT loom_labels(array(' NER=B-per|x ', 'o', ' I-loc ', 'NER=O', '', null)) AS l").first().l
    assert got == ["B-per", "O", "I-loc", "O", "", None]
    assert spark.sql("SELECT loom_bio_types(array('B-per', 'O', 'I-x-y')) AS l").first().l == ["per", "", "x-y"]
    assert "Exchange" not in Q.QUERIES["sql_functions"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_strip_is_the_white_space_of_expressions(spark, small):
    """Every character that (?U)\\s stands for, and none else; lines and labels are stripped without an expression."""
    from textloom import queries_tables  # noqa: F401  registers all queries
    from textloom import registry as Q
    from textloom.functions import text

    c = F.col("c")
    df = spark.range(1, 0x3100).filter("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    odd = df.filter((text.strip(F.concat(c, F.lit("a b"), c)) != F.regexp_replace(F.concat(c, F.lit("a b"), c), "(?U)^\\s+|\\s+$", "")) | (text.blank(c) != c.rlike("^(?U)\\s*$")))
    assert [r.c for r in odd.collect()] == []
    assert "regexp_replace" not in Q.QUERIES["conll_sentences"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_odd_lines_of_column_files(spark, small):
    """Other line ends, lines of white space, gaps of any length and comments; none costs an expression for each line."""
    from textloom import queries_tables  # noqa: F401  registers all queries
    from textloom import registry as Q
    from textloom.sources import annotated

    values = ["a\tB-x\r\nb\to\r\n\r\nc\tO", "\n\n\na\tB-x\nb\tO\n \t\n \n\n\nc\tO\n", "#\na\tB-x\n# c\nb\to  #\n\n# d\n\nc\tO\n\n", " \na\tB-x\x0bb\tO\x0c\x0c\x85c\tO", "a\tB-x\nb\t NER=o \n\x1c\nc\tNER=O|y"]
    got = annotated.conll(spark.createDataFrame(list(enumerate(values)), "file int, value string"), 0, annotated.column_or_outside(1)).orderBy("file", "ord").collect()
    assert [(r.file, r.ord, r.tokens, r.labels) for r in got] == [x for i in range(len(values)) for x in ((i, 0, ["a", "b"], ["B-x", "O"]), (i, 1, ["c"], ["O"]))]
    plan = Q.QUERIES["conll_sentences"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "{2,}" not in plan


def test_passages_are_spread_by_their_size(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("cast(id as string) as docid", "'t' as title", "sha2(cast(id as string), 512) as text").coalesce(1).write.option("compression", "gzip").json(f"{tmp_path}/p")
    assert records.passages(spark, f"{tmp_path}/p", 2).rdd.getNumPartitions() == 2
    monkeypatch.setattr(records, "PART_BYTES", 2000)
    found = records.passages(spark, f"{tmp_path}/p", 2)
    assert found.rdd.getNumPartitions() > 8 and found.select("docid").distinct().count() == 300


def test_prepared_lines_are_read_in_splits(spark, tmp_path):
    rows = spark.range(400).selectExpr("'sl' as lang", "'train' as split", "array('\"a', cast(id as string), 'c,\"', '\\\\') as tokens", "array('O', 'B-PER', 'O', 'O') as labels")
    writers.write_sentences(rows.coalesce(1), f"{tmp_path}/s")
    whole = records.prepared_sentences(spark, f"{tmp_path}/s")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = records.prepared_sentences(spark, f"{tmp_path}/s", lines=True)
        assert found.rdd.getNumPartitions() > 4 and records.prepared_sentences(spark, f"{tmp_path}/s").rdd.getNumPartitions() == 1
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.select("lang", "split", "tokens", "labels").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_language_is_sorted_by_many_tasks(spark):
    rows = spark.range(4000).selectExpr("if(id % 10 = 0, 'hr', if(id % 10 = 1, 'xx', 'sl')) as lang", "cast(id as string) as sentence", "map(1, 2) as m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [(r.p, r.lang) for r in corpus.training_rows(rows, ["sl", "hr"]).withColumn("p", F.spark_partition_id()).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x for _, x in found] == ["sl"] * 3200 + ["hr"] * 400
    assert len({p for p, x in found if x == "sl"}) > 2
