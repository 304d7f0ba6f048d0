"""Entity chunks of BIO sequences and their precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.labels import IGNORE
from textloom.functions.text import let, once
from textloom.operators.classification import _div, argmax


def _type(label: Column) -> Column:
    return F.when(F.instr(label, "-") > 0, F.substring(label, F.instr(label, "-") + 1, F.length(label))).otherwise("")


def chunk_array(labels: str) -> Column:
    """array<struct<first, last, type>> of the entities in an array column of BIO labels, by the lenient start rule.

    An entity starts at a B-, after an O or at another type, and ends before the next start or O. These places
    are found as numbers (twice the place, and one more for a start); types are read where entities start.
    """
    array = F.col(labels)

    def place(x: Column, i: Column) -> Column:
        before = F.get(array, i - 1)
        start = (i == 0) | F.startswith(x, F.lit("B-")) | (x == "B") | (before == "O") | F.startswith(before, F.lit("O-")) | (_type(before) != _type(x))
        return F.when((x == "O") | F.startswith(x, F.lit("O-")), i * 2).when(start, i * 2 + 1).otherwise(-1)

    def entities(places: Column) -> Column:
        end = lambda j: F.coalesce(F.shiftright(F.get(places, j + 1), 1), F.size(array)) - 1
        one = lambda v, j: F.when(v % 2 == 1, F.struct(F.shiftright(v, 1).alias("first"), end(j).alias("last"), _type(F.get(array, F.shiftright(v, 1))).alias("type")))
        return F.filter(F.transform(places, one), lambda x: x.isNotNull())

    return let(F.filter(F.transform(array, place), lambda v: v >= 0), entities)


def chunks(sequences: DataFrame, keys: list[str], labels: str = "labels") -> DataFrame:
    """keys, first, last, type of the entities of each sequence (keys, array of labels)."""
    return sequences.select(*keys, F.explode(chunk_array(labels)).alias("e")).select(*keys, "e.first", "e.last", "e.type")


def entity_prf(sequences: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row: precision, recall, f1 over entities and accuracy over tokens of sequences with two arrays of labels.

    Everything is counted inside the row; one aggregation follows.
    """
    def keys(labels: str) -> Column:  # 64-bit digests, which sets are made of without boxing; structs would be compared pair by pair
        return once(F.transform(chunk_array(labels), lambda x: F.xxhash64(x["first"], x["last"], x["type"])))

    both = sequences.select(keys(gold).alias("g"), keys(pred).alias("p"), F.size(F.filter(F.arrays_zip(F.col(gold).alias("a"), F.col(pred).alias("b")), lambda x: x["a"] == x["b"])).alias("same"), F.size(gold).alias("n"))
    counted = both.select(F.size(F.array_intersect("g", "p")).alias("tp"), F.size("g").alias("ng"), F.size("p").alias("np"), "same", "n")
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "ng", "np", "same", "n")])
    tp, ng, np_ = (F.col(c) for c in ("tp", "ng", "np"))
    return total.select(_div(tp, np_).alias("precision"), _div(tp, ng).alias("recall"), _div(2.0 * tp, np_ + ng).alias("f1"), F.when(F.col("n") > 0, F.col("same") / F.col("n")).alias("accuracy"))


def aligned(df: DataFrame, keys: list[str], logits: str, label_ids: str, id2label: dict[int, str]) -> DataFrame:
    """keys, gold, pred: arrays of labels from logits (array per position) and label ids; IGNORE positions are left out."""
    names = F.create_map(*[F.lit(x) for kv in id2label.items() for x in kv])
    kept = F.filter(F.arrays_zip(F.col(logits).alias("p"), F.col(label_ids).alias("l")), lambda x: x["l"] != IGNORE)
    return df.select(*keys, F.transform(kept, lambda x: F.element_at(names, x["l"])).alias("gold"), F.transform(kept, lambda x: F.element_at(names, argmax(x["p"]))).alias("pred"))


def compute_metrics(df: DataFrame, logits: str, label_ids: str, id2label: dict[int, str]) -> dict[str, float]:
    """The hook of a training run: precision, recall, f1 and accuracy of predictions (one row) as numbers."""
    return {k: float(v or 0.0) for k, v in entity_prf(aligned(df, [], logits, label_ids, id2label)).first().asDict().items()}
