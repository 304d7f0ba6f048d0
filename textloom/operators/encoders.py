"""Label encoders: binary, multiclass and multilabel, as DataFrames and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.labels import sort_key
from textloom.sinks.writers import rolling_shard

TYPE_CODES = ("binary", "multilabel", "multiclass")


#: An encoder's labels become literals of its expressions; beyond so many, join `numbered` instead.
MAX_CLASSES = 10_000


def vocabulary(df: DataFrame, column: str, most: int = MAX_CLASSES) -> list:
    """Sorted distinct labels of a scalar or array column; more than most are an error, not a cut."""
    array = dict(df.dtypes)[column].startswith("array")
    values = df.select(F.explode(column).alias("v") if array else F.col(column).alias("v"))
    found = [r["v"] for r in values.filter("v is not null").distinct().orderBy("v").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} labels: join the table of numbered()")
    return found


def numbered(df: DataFrame, column: str) -> DataFrame:
    """label, id: the distinct labels of a scalar or array column in order, numbered from 0, however many there are."""
    array = dict(df.dtypes)[column].startswith("array")
    labels = df.select(F.explode(column).alias("label") if array else F.col(column).alias("label")).filter("label is not null").distinct()
    return rolling_shard(labels, ["label"], 1).select("label", F.col("shard").alias("id"))


def first_seen(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """label, id: the distinct labels of a scalar or array column, numbered as they first occur in order."""
    array = dict(df.dtypes)[column].startswith("array")
    value = F.posexplode(column) if array else F.posexplode(F.array(column))
    rows = df.select(F.struct(*order).alias("_o"), value.alias("_pos", "label")).filter("label is not null")
    first = rows.groupBy("label").agg(F.min(F.struct("_o", "_pos")).alias("_first"))
    g = first.agg(F.array_sort(F.collect_list(F.struct("_first", "label"))).alias("a"))  # a vocabulary, small by nature
    return g.select(F.posexplode("a").alias("id", "x")).select(F.col("x.label").alias("label"), "id")


def label_list(df: DataFrame, column: str = "labels") -> DataFrame:
    """label, id of BIO labels: O first, then by type and prefix; O is always there."""
    found = df.select(F.explode(column).alias("label")).union(df.sparkSession.range(1).select(F.lit("O"))).distinct()
    g = found.agg(F.array_sort(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_key(F.col("label")))], "label"))).alias("a"))
    return g.select(F.posexplode("a").alias("id", "x")).select(F.col("x.label").alias("label"), "id")


class Encoder:
    """labels -> vector and back over a fixed, ordered vocabulary."""

    code = ""

    def __init__(self, classes: list):
        self.classes = sorted(set(classes))
        self.num_labels = len(self.classes)

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> Encoder:
        return cls(vocabulary(df, column))

    def labels_to_ids(self) -> dict:
        return {c: i for i, c in enumerate(self.classes)}

    def ids_to_labels(self) -> dict:
        return dict(enumerate(self.classes))

    def _ids(self) -> Column:
        return F.create_map(*[F.lit(x) for kv in self.labels_to_ids().items() for x in kv])

    def _array(self) -> Column:
        return F.array(*[F.lit(c) for c in self.classes])


class MulticlassEncoder(Encoder):
    code = "multiclass"

    def vectorize(self, label: Column) -> Column:
        return F.element_at(self._ids(), label)

    def unvectorize(self, index: Column) -> Column:
        return F.element_at(self._array(), index + 1)


class BinaryEncoder(MulticlassEncoder):
    code = "binary"

    def __init__(self, classes: list):
        super().__init__(classes)
        if self.num_labels != 2:
            raise ValueError(f"a binary label has two values, not {self.num_labels}")
        self.num_labels = 1


class MultilabelEncoder(Encoder):
    code = "multilabel"

    def vectorize(self, labels: Column) -> Column:
        return F.transform(self._array(), lambda v: F.array_contains(labels, v).cast("int"))

    def unvectorize(self, vector: Column) -> Column:
        return F.filter(self._array(), lambda v, i: F.get(vector, i) == 1)


ENCODERS = {e.code: e for e in (BinaryEncoder, MultilabelEncoder, MulticlassEncoder)}
