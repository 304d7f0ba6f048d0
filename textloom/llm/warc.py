"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

write_archives() puts one record per page into .warc.zst files; read_archives() loads each file's
dictionary from its leading skippable frame, decodes one frame per record, and validates frame,
version line, headers, lengths and digests before it returns the record.

Equal payloads of at least MIN_REVISIT_BYTES are stored once, under the smallest page_id; the
others become revisit records that refer to it. Digests are counted per (digest, salt) before
they are shuffled by digest. The shared ones go back to the pages by broadcast, if a count proves
them few, so that no payload is shuffled; otherwise to each (digest, salt), so a payload shared
by a third of all pages meets its pages in many tasks.

Archives are rolled at a bounded number of raw bytes, so a writer buffers, and a reader receives,
one bounded archive at a time (a record larger than the bound is an archive of its own). Each
task attempt writes files of its own; the manifest, written after the tasks succeeded, names the
files that count, so files of lost executors and repeated attempts are never read.

Defined results: a null html is an empty payload; a null page_id is a record without the page
header and never the target of a revisit; rows that repeat the smallest page_id with the same
payload are all responses; an empty table writes no archive; only the id, url and html columns
are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import bounded, checked_broadcast, materialize, salt_of, scratch_path, spread_back

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
DICT_SAMPLE_RECORDS = 200
MAX_BROADCAST_FILES = 1_000_000
#: Shared digests that are broadcast at most, at about 100 bytes each.
MAX_BROADCAST_DIGESTS = 1_000_000
SALTS = 64
LEVEL = 3
READ_BYTES = 1 << 12

# Fixed values of the formats
VERSION = b"WARC/1.1"
DICT_FRAME_MAGIC = 0x184D2A5D
DICT_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
FRAME_HEADER_BYTES = 18
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class WarcError(ValueError):
    """An archive or record that fails validation."""


def b32(hex_digest: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(hex_digest)).decode().rstrip("=")


def from_b32(label: str) -> str:
    kind, _, value = label.partition(":")
    if kind != "sha256":
        raise WarcError(f"digest {label}")
    return base64.b32decode(value + "=" * (-len(value) % 8)).hex()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one record: version line, headers, block, and two line ends."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", RECORD_DATE),
        ("WARC-Payload-Digest", b32(digest)),
        ("WARC-Block-Digest", b32(hashlib.sha256(block).hexdigest())),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if url:
        headers.append(("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        target = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
        headers += [("WARC-Refers-To", f"<urn:uuid:{target}>"), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Truncated", "length")]
    head = CRLF.join([VERSION, *(f"{k}: {v}".encode() for k, v in headers)])
    return head + CRLF * 2 + block + CRLF * 2


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, sep, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not sep or lines[0] != VERSION:
        raise WarcError("no version line or end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.decode().partition(":")
        if not colon or not k or k.lower() in headers:
            raise WarcError(f"header line {line[:80]!r}")
        headers[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if k not in headers:
            raise WarcError(f"no header {k}")
    if headers["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"type {headers['warc-type']}")
    length = headers["content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != CRLF * 2:
        raise WarcError("the block's length differs from Content-Length")
    block = rest[:-4]
    if hashlib.sha256(block).hexdigest() != from_b32(headers["warc-block-digest"]):
        raise WarcError("block digest")
    if headers["warc-type"] == "response" and (headers["warc-block-digest"] != headers["warc-payload-digest"] or headers["x-payload-length"] != length):
        raise WarcError("payload digest or length")
    return headers, block


def train_dictionary(samples: list[bytes]):
    """A dictionary for one archive from a bounded sample of its records, or None."""
    import zstandard

    samples = [s[:65536] for s in samples[:: max(1, len(samples) // DICT_SAMPLE_RECORDS)][:DICT_SAMPLE_RECORDS]]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICT_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def encode_archive(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame if there is one, then a frame per record."""
    import zstandard

    trained = train_dictionary(records)
    out = []
    if trained is not None:
        body = trained.as_bytes()
        out.append(struct.pack("<II", DICT_FRAME_MAGIC, len(body)) + body)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    out += [c.compress(r) for r in records]
    return b"".join(out)


def decode_archive(data: bytes):
    """Yield the bytes of each record of an archive."""
    import zstandard

    at, trained = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_FRAME_MAGIC:
        (n,) = struct.unpack_from("<I", data, 4)
        body = data[8 : 8 + n]
        if len(body) != n:
            raise WarcError("the dictionary frame is cut off")
        if body[:4] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        if body[:4] != DICT_MAGIC:
            raise WarcError("the leading frame holds no dictionary")
        at, trained = 8 + n, zstandard.ZstdCompressionDict(body)
    d = zstandard.ZstdDecompressor(dict_data=trained) if trained is not None else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 4] != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        size = zstandard.frame_content_size(view[at : at + FRAME_HEADER_BYTES])
        one, parts, start, step = d.decompressobj(), [], at, READ_BYTES
        while not one.eof:  # in slices, so that what is left over after a frame is short
            if at >= len(data):
                raise WarcError(f"the frame at byte {start} is cut off")
            parts.append(one.decompress(view[at : at + step]))
            at, step = min(len(data), at + step), step * 2
        at -= len(one.unused_data)
        record = b"".join(parts)
        if size >= 0 and len(record) != size:
            raise WarcError(f"the frame at byte {start} has {len(record)} bytes, not {size}")
        yield record


def _save(folder: str, name: str, data: bytes) -> None:
    """Write a file to the shared store: whole or not at all."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/.{name}.tmp") as f:
        f.write(data)
    store.move(f"{path}/.{name}.tmp", f"{path}/{name}")


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        stem, made, held, raw = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, [], 0

        def flush():
            nonlocal made, raw
            name = f"{stem}-{made:05d}.warc.zst"
            data = encode_archive(held)
            _save(folder, name, data)
            row = (name, len(held), len(data))
            made, raw = made + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "n_records", "bytes"])

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                record = build_record(page_id, url, payload, digest, refers_to)
                if held and raw + len(record) > archive_bytes:
                    yield flush()
                held.append(record)
                raw += len(record)
        if held:
            yield flush()

    return run


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) of every page."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    large = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), payload.alias("payload")).filter(F.octet_length("payload") >= MIN_REVISIT_BYTES)
    keys = large.select("page_id", F.sha2("payload", 256).alias("digest"), salt_of(F.col("page_id"), SALTS).alias("salt"))
    by_salt = keys.groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = by_salt.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1").drop("n")
    shared = materialize(shared, "shared")
    if bounded(shared, MAX_BROADCAST_DIGESTS):
        joined = rows.join(F.broadcast(shared.drop("salts")), "digest", "left")
    else:
        joined = spread_back(rows.withColumn("salt", salt_of(F.col("page_id"), SALTS)), "digest", "salt", shared)
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **cols: str) -> DataFrame:
    """Write every page as a record; returns the manifest (file, n_records, bytes)."""
    records = plan_records(pages, **cols)
    return materialize(records.mapInArrow(_writer(folder, archive_bytes), "file string, n_records long, bytes long"), "manifest")


def _reader(payloads: bool):
    def run(batches):
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for content, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for record in decode_archive(content):
                    h, block = parse_record(record)
                    number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), number("x-payload-length"), from_b32(h["warc-payload-digest"]), h["warc-type"], number("x-refers-to-page-id"), h.get("warc-target-uri"), block if payloads else None))
                if len(rows) != expected:
                    raise WarcError(f"an archive has {len(rows)} records, its manifest {expected}")
                for i in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000], strict=True), types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names."""
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = files.join(checked_broadcast(manifest.select("file", "n_records"), MAX_BROADCAST_FILES), "file").select("content", "n_records")
    return found.mapInArrow(_reader(payloads), RECORD_SCHEMA)


def roundtrip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write pages to archives and read the records back (without payloads)."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, **options)
    return read_archives(spark, folder, manifest, payloads=False).drop("url", "payload")
