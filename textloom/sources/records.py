"""JSON records, prepared sentence tables, retrieval corpora, archives and staging."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.sources.aes_zip import read_member

JSON_GLOB = "*.[jJ][sS][oO][nN]"
#: What a part of passages holds at most, of their compressed bytes on average.
PART_BYTES = 32_000_000


class MergeError(RuntimeError):
    """A split directory is missing or holds no records."""


def json_records(spark: SparkSession, folder: str) -> DataFrame:
    """file, pos, record (variant): the items of array files, and other files as one record."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=JSON_GLOB)
    return records_of(files.select(F.col("_metadata.file_name").alias("file"), "value"))


def records_of(files: DataFrame) -> DataFrame:
    """file, pos, record (variant) of whole JSON texts (file, value)."""
    rows = files.select("file", F.parse_json("value").alias("v"))
    spark = files.sparkSession
    arrays = rows.filter(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")))
    single = rows.filter(~F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))).select("file", F.lit(0).alias("pos"), F.col("v").alias("record"))
    items = arrays.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", "value")).select("file", "pos", F.col("value").alias("record"))
    return items.unionByName(single)


def missing_splits(spark: SparkSession, root: str, splits: tuple[str, ...]) -> list[str]:
    """The splits without a folder below root/dataset."""
    jvm = spark.sparkContext._jvm
    out = []
    for s in splits:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/dataset/{s}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out.append(s)
    return out


def merged_splits(spark: SparkSession, root: str, splits: tuple[str, ...] = ("dev", "test", "train")) -> DataFrame:
    """split, file, pos, record of all split folders; missing or empty ones are an error that names them all."""
    if missing := missing_splits(spark, root, splits):
        raise MergeError(f"no folder for {', '.join(missing)} below {root}/dataset")
    parts = {s: json_records(spark, f"{root}/dataset/{s}").withColumn("split", F.lit(s)) for s in splits}
    if empty := [s for s, part in parts.items() if part.isEmpty()]:
        raise MergeError(f"no records in {', '.join(empty)} below {root}/dataset")
    return reduce(DataFrame.unionByName, parts.values())


def prepared_sentences(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """tokens and labels (and partition columns) of prepared sentence files.

    lines: each record is one line, as tokens without line ends are written; files are then read in splits, else
    each whole by one task.
    """
    df = spark.read.csv(path, schema=schemas.PREPARED, header=True, multiLine=not lines, escape='"')
    df = df.withColumn("lang", F.regexp_extract(F.col("_metadata.file_path"), "(?:lang=|ner-)([^./]+)", 1)).withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), "(?:split=|ner-[^./]+\\.)([^./]+?)(?:/|\\.csv)", 1))
    return df.filter("sentence is not null and labels is not null").select("lang", "split", F.split("sentence", " ").alias("tokens"), F.split("labels", " ").alias("labels"))


def found_splits(sentences: DataFrame) -> list[str]:
    """The split names among prepared sentences, sorted; files without one are the base."""
    return [r[0] for r in sentences.select("split").filter("split <> ''").distinct().orderBy("split").collect()]


def topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.TOPICS)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.QRELS)


def passages(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Gzipped JSON lines do not split; parts spreads them after the read, to more parts where these would hold over PART_BYTES."""
    df = spark.read.json(path, schema=schemas.PASSAGES)
    if not parts:
        return df
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # lengths only, no contents
    return df.repartition(max(parts, -(-size // PART_BYTES)))


def safe_member(target: Path, name: str) -> Path:
    """Where an archive member goes; names that leave the target are an error."""
    to = (target / name).resolve()
    if not to.is_relative_to(target.resolve()):
        raise ValueError(f"member {name} leaves {target}")
    return to


def extract_zip(archive: Path, target: Path, password: str | None = None) -> Path:
    """Unpack an archive, plain or encrypted in either way; a member that leaves the target is an error before any is written."""
    secret = password.encode() if password else None
    with zipfile.ZipFile(archive) as z:
        places = [(m, safe_member(target, m.filename)) for m in z.infolist()]
        for m, to in places:
            if m.is_dir():
                to.mkdir(parents=True, exist_ok=True)
            else:
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(read_member(z, m, secret))
    return target


def zip_members(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """archive, member, content of the files in zip archives, read by the executors."""
    import io

    import pyarrow as pa

    secret = password.encode() if password else None

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.filename]), pa.array([read_member(z, m, secret)], pa.binary())], ["archive", "member", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, member string, content binary")


def url_file_name(url: str) -> str:
    return url.split("?", 1)[0].rstrip("/").rsplit("/", 1)[-1]


def download_archives(urls: list[str], target: Path, password: str | None = None) -> list[Path]:
    """Stage a set of zip archives and unpack each into a folder of its name."""
    return [extract_zip(a, target / a.stem, password) for a in download(urls, target)]


def target_dir(root: Path, dataset: str, config: str | None = None) -> Path:
    return root / dataset / config if config else root / dataset


def download(urls: list[str], target: Path, chunk: int = 8192) -> list[Path]:
    """Stage files by name; a file appears under its name only when it is complete."""
    target.mkdir(parents=True, exist_ok=True)
    out = []
    for url in urls:
        to = target / url_file_name(url)
        part = to.with_name(to.name + ".part")
        with urllib.request.urlopen(url) as r, part.open("wb") as f:
            shutil.copyfileobj(r, f, chunk)
        part.replace(to)
        out.append(to)
    return out
