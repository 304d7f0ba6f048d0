"""Hard negatives by one-dimensional distance keys.

Rows are augmented by one component, so that all have the same length and a larger inner product with an
anchor is a smaller distance to it. Each row stands at the nearest of some pivots, under the key (pivot,
distance to it), and the table is stored sorted by that key. By the triangle inequality the rows within r
of an anchor have keys within r of the anchor's own distance to each pivot: a search scans these intervals,
keeps the best, and widens r to the annulus beyond until the k-th best is no further than r, or nothing can
be left. The intervals are filters that the scan of the sorted files is pruned by; scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize, scratch_path

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT = 30
HIGH_PERCENT = 90
#: Pivots are fitted to about SAMPLE_ROWS rows, chosen by a digest of the id; every row is indexed.
SAMPLE_ROWS = 4096
MAX_PIVOTS = 64
ROWS_PER_PIVOT = 256
LLOYD_ROUNDS = 5
#: Anchors of one pass: they are broadcast, and each pass scans the index anew.
PASS_ANCHORS = 4096
PASS_BYTES = 32 << 20
BLOCK_ROWS = 2048
BLOCK_QUERIES = 512
BUFFER = 1 << 20
#: Beyond this a square would leave the range of doubles.
LARGEST = 1e140

_VECTORS = "id long, label long, v array<double>, norm2 double"
_INDEX = f"{_VECTORS}, pivot int, dist double"
_FOUND = "query int, id long, score long"
_EXACT = 2.0**53
_MOST = 2**63 - 1


# ---- vectors


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """(rows, dim) of lists; shorter ones are filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lists), dim))
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _quantized(scale: float):
    """Batches of (id, label, v) with each component x turned into floor(scale x), and the sum of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            flat = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            offsets = v.offsets.to_numpy() - v.offsets[0].as_py()
            sums = np.concatenate([[0.0], np.cumsum(flat * flat)])
            exact = sums[-1] < _EXACT  # else differences of sums would not be the sums
            norm2 = sums[offsets[1:]] - sums[offsets[:-1]] if exact else np.array([float((flat[i:j] * flat[i:j]).sum()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)), pa.array(norm2)], ["id", "label", "v", "norm2"])

    return run


def _products(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer-valued rows, as float64 while all are below 2^53; else as int64 held to its range."""
    if exact:
        return a @ x.T
    whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(x).T, -_MOST, _MOST).astype(np.int64)


@dataclass
class Space:
    """What all keys share: dimension, largest squared length, pivots (with their augmented component)."""

    dim: int
    most: float
    pivots: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))

    @property
    def exact(self) -> bool:
        return self.most < _EXACT

    @property
    def slack(self) -> float:
        """More than the rounding of any distance."""
        return 1e-6 * math.sqrt(self.most) + 1e-9

    def augmented(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(self.most - norm2, 0))[:, None]], 1)

    def to_pivots(self, rows: np.ndarray) -> np.ndarray:
        """Distances of augmented rows to all pivots."""
        d2 = (rows * rows).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * rows @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def distance(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor of squared length norm2 to a row of that score."""
        return np.sqrt(np.maximum(norm2 + self.most - 2 * np.asarray(score, float), 0))


def _fitted(space: Space, sample: np.ndarray, norm2: np.ndarray, n: int) -> np.ndarray:
    """Pivots by some rounds of Lloyd's method over the sample, from evenly spaced rows of it."""
    rows = space.augmented(sample, norm2)
    k = min(MAX_PIVOTS, max(1, n // ROWS_PER_PIVOT), max(1, len(rows)))
    if not len(rows):
        return np.zeros((1, space.dim + 1))
    space.pivots = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(LLOYD_ROUNDS):
        near = space.to_pivots(rows).argmin(1)
        for p in np.unique(near):
            space.pivots[p] = rows[near == p].mean(0)
    return space.pivots


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            d = space.to_pivots(space.augmented(_matrix(b.column(2), space.dim), b.column(3).to_numpy()))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["id", "label", "v", "norm2", "pivot", "dist"])

    return run


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows with one id that of the smallest label and vector; ids are compared first, vectors only where some repeat."""
    repeated = rows.groupBy("id").count().filter("count > 1")
    if repeated.isEmpty():
        return rows
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m"))
    return one.select("id", "m.label", "m.v")


def build_index(rows: DataFrame, scale: float) -> tuple[DataFrame, Space, np.ndarray, np.ndarray]:
    """(the table sorted by (pivot, dist), its space, the sample's vectors and labels) of rows (id, label, v)."""
    spark = rows.sparkSession
    vectors = materialize(_one_per_id(rows).mapInArrow(_quantized(scale), _VECTORS), "vectors")
    n, dim, most = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    space = Space(max(dim, 1), most)
    chosen = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS).toArrow()
    sample = _matrix(chosen.column("v").combine_chunks(), space.dim) if chosen.num_rows else np.zeros((0, space.dim))
    order = np.argsort(chosen.column("id").to_numpy())
    sample, norm2, labels = sample[order], chosen.column("norm2").to_numpy()[order], chosen.column("label").to_numpy()[order]
    space.pivots = _fitted(space, sample, norm2, n)
    keyed = vectors.mapInArrow(_keyed(spark.sparkContext.broadcast(space)), _INDEX)
    path = scratch_path(spark, "distance-keys")
    # ids part runs of equal keys, so that a third of all rows being one vector makes no large file
    keyed.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id").write.option("parquet.block.size", 8 << 20).parquet(path)
    index = spark.read.schema(keyed.schema).parquet(path)
    index.__dict__["scratch_path"] = path
    discard(vectors)
    return index, space, sample, labels


# ---- searches


@dataclass
class Queries:
    """Searches of one pass: anchors by number, the label to have or not to have, the bounds of the score."""

    vectors: np.ndarray  # of the anchors
    norm2: np.ndarray
    ids: np.ndarray
    anchor: np.ndarray  # of each query
    label: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int

    def matches(self, q: np.ndarray, scores: np.ndarray, labels: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Which rows queries q may take; scores are (q, rows)."""
        fit = (labels[None, :] == self.label[q][:, None]) == self.same
        fit &= (scores >= self.low[q][:, None]) & (scores <= self.high[q][:, None])
        return fit if ids is None else fit & (ids[None, :] != self.ids[self.anchor[q]][:, None])


class Found:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [np.zeros((3, 0), np.int64)]
        self.size, self.last = 0, np.full(n, -_MOST, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.rows.append(np.stack([q, score.astype(np.int64), ids]))
        self.size += len(q)
        if self.size > BUFFER or len(self.rows) > 64:
            self.reduce()

    def reduce(self) -> np.ndarray:
        q, s, i = np.concatenate(self.rows, 1)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, s, i = (x[rank < self.k] for x in (q, s, i))
        full = rank[rank < self.k] == self.k - 1
        self.last[q[full]] = s[full]
        self.rows, self.size = [np.stack([q, s, i])], 0
        return self.rows[0]


def _scan(shared):
    """Rows of the index in key order to the best of each query among those in its annulus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, queries, dist, seen, reach, known = shared.value
        found, near = Found(len(queries.anchor), queries.k), space.distance(queries.norm2[queries.anchor], queries.high)
        found.last = np.maximum(found.last, known)  # what an earlier round has found need not be found again
        for b in batches:
            ids, labels, pivot, key = (b.column(c).to_numpy() for c in ("id", "label", "pivot", "dist"))
            x = _matrix(b.column("v"), space.dim)
            cuts = np.unique(np.concatenate([[0, len(ids)], np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(ids), BLOCK_ROWS)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                at = dist[queries.anchor, pivot[i]]
                low, high = key[i:j].min(), key[i:j].max()
                due = (at - reach <= high) & (at + reach >= low) & ~((at - seen <= low) & (at + seen >= high)) & (high >= near - at - space.slack)
                due = np.flatnonzero(due)
                for s in range(0, len(due), BLOCK_QUERIES):
                    q = due[s : s + BLOCK_QUERIES]
                    anchors, of = np.unique(queries.anchor[q], return_inverse=True)
                    scores = _products(queries.vectors[anchors], x[i:j], space.exact)[of]
                    away = np.abs(key[i:j][None, :] - at[q][:, None])
                    fit = (away <= reach[q][:, None]) & (away > seen[q][:, None]) & (scores >= found.last[q][:, None])
                    r, c = np.nonzero(fit & queries.matches(q, scores, labels[i:j], ids[i:j]))
                    if len(r):
                        found.add(q[r], scores[r, c], ids[i:j][c])
        q, score, i = found.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i), pa.array(score)], ["query", "id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def _start(space: Space, queries: Queries, sample: np.ndarray, labels: np.ndarray, furthest: np.ndarray) -> np.ndarray:
    """First radii: the distance of the sample's best match, else a quarter of the furthest."""
    radius = furthest / 4
    for s in range(0, len(radius), BLOCK_QUERIES):
        q = np.arange(s, min(s + BLOCK_QUERIES, len(radius)))
        scores = _products(queries.vectors[queries.anchor[q]], sample, space.exact)
        own = space.distance(queries.norm2[queries.anchor[q]][:, None], scores)
        fit = queries.matches(q, scores, labels, None) & (own > space.slack)  # the anchor may be in the sample itself
        nearest = np.where(fit, own, np.inf).min(1, initial=np.inf)
        radius[q] = np.where(np.isfinite(nearest), nearest, radius[q])
    return radius


def search(spark: SparkSession, index: DataFrame, space: Space, queries: Queries, sample: np.ndarray, labels: np.ndarray) -> DataFrame:
    """query, id, score, rank: the k best of each query, certified. The driver holds a radius and a score per query."""
    norm2 = queries.norm2[queries.anchor]
    whole = np.sqrt(norm2) + math.sqrt(space.most)
    furthest = np.where(np.isfinite(queries.low), np.minimum(space.distance(norm2, np.where(np.isfinite(queries.low), queries.low, 0)), whole), whole) + space.slack
    rows = [np.zeros((0, space.dim + 1))] if not len(queries.vectors) else [np.concatenate([queries.vectors, np.zeros((len(queries.vectors), 1))], 1)]
    dist = space.to_pivots(rows[0])
    seen, reach = np.full(len(norm2), -1.0), np.minimum(_start(space, queries, sample, labels, furthest) + space.slack, furthest)
    known, found = np.full(len(norm2), -_MOST, np.int64), None
    while True:
        pending = reach > seen
        if not pending.any():
            return found if found is not None else spark.createDataFrame([], f"{_FOUND}, rank int")
        near, far = (dist[queries.anchor][pending] + sign * reach[pending][:, None] for sign in (-1, 1))
        wanted = reduce(or_, [(F.col("pivot") == p) & F.col("dist").between(float(a), float(z)) for p, (a, z) in enumerate(zip(near.min(0), far.max(0), strict=True))])
        context = spark.sparkContext.broadcast((space, queries, dist, seen, np.where(pending, reach, -1.0), known))
        new = index.filter(wanted).select("id", "label", "pivot", "dist", "v").mapInArrow(_scan(context), _FOUND)
        merged = materialize(_best(new if found is None else new.unionByName(found.drop("rank")), queries.k), "found")
        if found is not None:
            discard(found)
        found = merged
        count = np.zeros(len(norm2), np.int64)
        for q, n, last in found.groupBy("query").agg(F.count("*"), F.min("score")).toLocalIterator():
            count[q], known[q] = n, last if n == queries.k else -_MOST
        full = count == queries.k
        bound = space.distance(norm2, np.where(full, known, 0)) + space.slack
        seen = np.where(pending, reach, seen)
        # a full query is done when its last match lies within what was seen, any query when nothing lies beyond
        reach = np.where(full, np.maximum(np.minimum(bound, furthest), seen), np.minimum(2 * seen, furthest))


# ---- the operator


def _anchors(index: DataFrame, is_anchor: Column, dim: int) -> Iterator[list]:
    """The anchors in key order, in lists of bounded size."""
    most, held = max(1, min(PASS_ANCHORS, PASS_BYTES // (8 * dim))), []
    for r in index.filter(is_anchor).select("id", "label", "v", "norm2").orderBy("pivot", "dist", "id").toLocalIterator():
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, scale: float = 1.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is a condition on the column `id`. Components x become floor(scale x); scores are inner products.
    Of each anchor the `positives` best other rows of its label, and for each of those the `negatives` best
    rows of other labels whose score lies between low and high percent of the positive's; higher scores first,
    equal ones by smaller id; all where there are fewer. Rows with a null id, label or vector or with a null or
    non-finite component (1e140 counts as such) take no part; of rows with one id that of the smallest label and vector does. Shorter
    vectors are filled with zeros. Scores beyond 64 bits are held to their range. Equal vectors are rows of
    their own. Other columns are not read. Without rows or anchors the result is empty.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST)))  # NaN is above all numbers
    index, space, sample, labels = build_index(rows, scale)
    out, done = scratch_path(spark, "hard-negatives"), 0
    for held in _anchors(index, is_anchor, space.dim):
        ids, of, norm2 = (np.array([r[c] for r in held]) for c in ("id", "label", "norm2"))
        vectors = np.zeros((len(held), space.dim))
        for i, r in enumerate(held):
            vectors[i, : len(r["v"])] = r["v"]
        every = np.arange(len(held))
        near = search(spark, index, space, Queries(vectors, norm2, ids, every, of, True, np.full(len(held), -np.inf), np.full(len(held), np.inf), positives), sample, labels)
        pairs = near.orderBy("query", "rank").collect()  # at most `positives` for each anchor of the pass
        anchor, score = np.array([r["query"] for r in pairs], np.int64), [r["score"] for r in pairs]
        floor, ceiling = (np.array(x, float) for x in ([-(-low * s // 100) for s in score], [high * s // 100 for s in score]))
        far = search(spark, index, space, Queries(vectors, norm2, ids, anchor, of[anchor], False, floor, ceiling, negatives), sample, labels)
        named = [(i, int(ids[r["query"]]), r["id"], r["score"]) for i, r in enumerate(pairs)]
        slots = F.broadcast(spark.createDataFrame(named, "query int, anchor_id long, positive_id long, positive_score long"))  # as many as pairs
        far.join(slots, "query").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{out}/pass={done}")
        for used in (near, far):
            if "scratch_path" in used.__dict__:
                discard(used)
        done += 1
    discard(index)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(f"{out}/*") if done else spark.createDataFrame([], schema)
