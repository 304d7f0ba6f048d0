import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from textloom.sources import records, store


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = b"x" * 3_000_000 + self.path.encode() if "missing" not in self.path else b""
            self.send_response(404 if "missing" in self.path else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_files_are_fetched_once(spark, server, tmp_path):
    root, asked = server
    urls = [f"{root}/a/one.gz?x=1", f"{root}/b/two.gz/", f"{root}/a/same.gz", f"{root}/b/same.gz", f"{root}/a/one.gz?x=1", None, " "]
    df = spark.createDataFrame([(u, 1) for u in urls], "link string, url int")
    folder = f"file://{tmp_path}/staged"
    got = {r.url: r for r in store.fetch(df, folder, "link").collect()}
    assert set(got) == set(urls[:4])
    assert got[urls[0]].file == "one.gz" and got[urls[1]].file == "two.gz"
    assert got[urls[2]].file != got[urls[3]].file and got[urls[2]].file.endswith("/same.gz")
    for u, r in got.items():
        body = (tmp_path / "staged" / r.file).read_bytes()
        assert body == b"x" * 3_000_000 + u.removeprefix(root).encode()
        assert (r.bytes, r.sha256) == (len(body), hashlib.sha256(body).hexdigest())
    before = len(asked)
    assert {r.url: r for r in store.fetch(df, folder, "link").collect()} == got and len(asked) == before
    store.fetch(df, folder, "link", again=True)
    assert len(asked) == before + 4
    assert not list((tmp_path / "staged").rglob("*.part"))


def test_a_failing_url_leaves_no_file(spark, server, tmp_path):
    root, _ = server
    with pytest.raises(Exception, match="404"):
        store.fetch(spark.createDataFrame([(f"{root}/missing.gz",)], "url string"), f"file://{tmp_path}/staged")
    assert not list((tmp_path / "staged").rglob("missing.gz"))
    assert store.fetch(spark.createDataFrame([], "url string"), f"file://{tmp_path}/staged").count() == 0


def test_fetch_action(spark, server, tmp_path, monkeypatch):
    from textloom import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["--root", str(tmp_path), "data", "fetch", "archives", "-s", f'urls=["{server[0]}/a/b.zip"]', "-s", f"out=file://{tmp_path}/staged"])
    assert (tmp_path / "staged" / "b.zip").read_bytes().endswith(b"x/a/b.zip")


def test_packed_archives(spark, tmp_path):
    rows = spark.createDataFrame([("a.zip", "2.txt", "zwei", 0), ("a.zip", "1.txt", None, 0), ("b.zip", "d/ü.txt", "ü" * 100_000, 0), (None, "x", "x", 0), ("a.zip", None, "x", 0)], "archive string, member string, content string, url int")
    packed = {r.url.rsplit("/", 1)[-1]: r.members for r in store.pack(rows, f"file://{tmp_path}/made").collect()}
    assert packed == {"a.zip": 2, "b.zip": 1}
    found = {(r.archive.rsplit("/", 1)[-1], r.member): bytes(r.content).decode() for r in records.zip_members(spark, f"file://{tmp_path}/made").collect()}
    assert found == {("a.zip", "1.txt"): "", ("a.zip", "2.txt"): "zwei", ("b.zip", "d/ü.txt"): "ü" * 100_000}
