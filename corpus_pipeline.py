"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import discard, load, materialize
from textloom.llm.decontamination import decontaminate
from textloom.llm.mixing import mixed
from textloom.llm.quality import quality_filter
from textloom.llm.sharding import assign_shards
from textloom.llm.similar import keep_one_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table.

    Each row is judged by itself: repeated rows alike, a null, empty or blank text fails, ids may be null or repeat.
    """
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a 5-word similarity of 0.8 or more, found by SimHash rings: the smallest id.

    Ties of an id go to the smallest hash of the text; of rows equal in id and text one stays; rows without
    an id all stay; texts without words are copies of each other.
    """
    return keep_one_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Rows are judged by their text: copies alike, with or without an id; a null or empty text stays.
    """
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once per epoch, so ids repeat from here on.

    Null languages and sources are leaves of their own; a text without words is in no epoch; rows equal in id
    and text are taken together.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, and its number in the whole order, a unique key.

    Null ids come first; rows that tie on id are ordered by checksum and size, and equal rows are interchangeable.
    """
    return assign_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Rings of fingerprints and seeded orders have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another.

    What a stage keeps is written once to the shared folder for the stages after it, which read it more than
    once, and deleted when the next stage's result is written. All stages take empty tables, columns of other
    names and very long texts.
    """
    docs, written = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
