"""Files fetched by the executors into the store that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import url_file_name
from textloom.scratch import stored

CHUNK = 1 << 20
FETCHED = "url string, file string, bytes long, sha256 string"


def store_of(uri: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def save(uri: str, chunks) -> tuple[int, str]:
    """Write chunks to a file of the store, which appears only when it is whole; its bytes and SHA-256."""
    import hashlib

    store, path = store_of(uri)
    parent, _, name = path.rpartition("/")
    store.create_dir(parent, recursive=True)
    part = f"{parent}/.{name}.{uuid.uuid4().hex}.part"
    size, digest = 0, hashlib.sha256()
    with store.open_output_stream(part, compression=None) as f:
        for c in chunks:
            f.write(c)
            size += len(c)
            digest.update(c)
    store.move(part, path)
    return size, digest.hexdigest()


def chunks_of(url: str):
    """The bytes behind a web address, or of a file of any store, in chunks."""
    if url.split(":", 1)[0].lower() in ("http", "https", "ftp"):
        import urllib.request

        source = urllib.request.urlopen(url, timeout=600)
    else:
        store, path = store_of(url)
        source = store.open_input_stream(path, compression=None)
    with source as f:
        while chunk := f.read(CHUNK):
            yield bytes(chunk)


def fetch(urls: DataFrame, folder: str, url_col: str = "url", again: bool = False, tasks: int | None = None) -> DataFrame:
    """url, file, bytes, sha256: every distinct URL, staged below folder under its last path segment.

    Where several URLs end alike, each goes to a folder of its digest. Null and blank URLs have no row. Files that
    are there already are whole, so they are kept unless again is set; a task that is lost and repeated does no
    harm. A URL that fails ends the job after Spark's own retries. tasks: so many at a time, spread by URL.
    """
    spark = urls.sparkSession
    one = urls.select(F.col(f"`{url_col}`").cast("string").alias("url")).filter("trim(url) <> ''").distinct()
    named = one.withColumn("name", url_file_name(F.col("url")))
    alike = named.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit(True).alias("alike"))
    place = F.when(F.col("alike"), F.concat(F.md5(F.col("url").cast("binary")), F.lit("/"), "name")).otherwise(F.col("name"))
    todo = named.join(alike, "name", "left").select("url", place.alias("file")).repartition(tasks or spark.sparkContext.defaultParallelism, "url")

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for url, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{folder.rstrip('/')}/{file}"
                store, path = store_of(to)
                if not again and store.get_file_info(path).type == fs.FileType.File:
                    digest, size = hashlib.sha256(), 0
                    for c in chunks_of(to):
                        digest.update(c)
                        size += len(c)
                    row = (size, digest.hexdigest())
                else:
                    row = save(to, chunks_of(url))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (url, file, *row)], ["url", "file", "bytes", "sha256"])

    return stored(todo.mapInArrow(run, FETCHED))


def pack(rows: DataFrame, folder: str, archive: str = "archive", member: str = "member", content: str = "content") -> DataFrame:
    """url, members: a ZIP archive below folder for each value of archive, with a file per row in the order of the names.

    An archive is put together by one task, so give it no more rows than one task can hold. Null contents are empty
    files; rows without an archive or a name are left out.
    """
    kept = rows.select(F.col(archive).alias("archive"), F.col(member).alias("member"), F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")).alias("content")).filter("archive is not null and member is not null")

    def run(table):
        import io
        import zipfile

        import pyarrow as pa

        name = table.column("archive")[0].as_py()
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for m, c in sorted(zip(table.column("member").to_pylist(), table.column("content").to_pylist(), strict=True)):
                z.writestr(m, c)
        url = f"{folder.rstrip('/')}/{name}"
        save(url, [held.getvalue()])
        return pa.table({"url": [url], "members": pa.array([table.num_rows], pa.int64())})

    return stored(kept.groupBy("archive").applyInArrow(run, "url string, members long"))
