import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from test_sources import index

from textloom.sources import search
from textloom.streaming import sliced


@pytest.fixture
def served():
    documents = [{"uuid": f"u{i:02d}", "created": f"2020-01-{1 + i // 4:02d}T0{i % 4}:00:00", "media": {"uuid": "m"}} for i in range(40)]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["query"]["bool"]["filter"][0]["range"]["created"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(index(documents)[0]("", body)).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", documents, asked
    server.shutdown()


def test_stream_goes_on_where_it_stopped(spark, served, tmp_path):
    """Stopped and taken up with a later end: the rows of one batch read, each slice asked for once."""
    url, documents, asked = served
    options = {"url": url, "start": "2020-01-01", "days": "2", "limit": "3"}

    def run(out, **more):
        stream = search.search_stream(spark, **options, **more)
        sliced.each_batch(stream, lambda df, i: df.write.mode("overwrite").json(f"{tmp_path}/{out}/batch={i}"), f"{tmp_path}/cp").awaitTermination()

    run("out", end="2020-01-06")
    first = spark.read.json(f"{tmp_path}/out")
    assert sorted(r.uuid for r in first.collect()) == [f"u{i:02d}" for i in range(16)]  # the slice that has not ended is left
    before = len(asked)
    run("out", end="2020-01-11")
    assert min(a["gte"] for a in asked[before:]) == "2020-01-05T00:00:00"
    rows = sorted(r.uuid for r in spark.read.json(f"{tmp_path}/out").collect())
    assert rows == sorted(r.uuid for r in search.search_index(spark, **options, end="2020-01-11").collect()) == sorted(d["uuid"] for d in documents)


def test_late_documents_by_lookback(served):
    url, documents, _ = served
    reader = search.SearchStreamReader({"url": url, "start": "2020-01-01", "days": "1", "end": "2020-01-04", "lookback": "2"})
    assert [p.start[:10] for p in reader.partitions({"until": "2020-01-03T00:00:00"}, reader.latestOffset())] == ["2020-01-01", "2020-01-02", "2020-01-03"]
    assert reader.partitions({"until": "2020-01-04T00:00:00"}, reader.latestOffset()) == [] and reader.initialOffset() == {"until": "2020-01-01T00:00:00"}
    documents.append({"uuid": "late", "created": "2020-01-02T09:00:00", "media": {"uuid": "m"}})
    (part,) = [p for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) if p.start.startswith("2020-01-02")]
    assert "late" in {row[1] for row in reader.read(part)}
