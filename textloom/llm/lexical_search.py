"""Ranked lexical search as a blocked sparse matrix product.

The items of one pass make a sparse matrix of term multiplicities, rows items, columns terms. Documents are
read once into rows of (term, occurrences) over those terms; their impacts, 64-bit integers, make the other
matrix in blocks of documents. A block's product is built item by item as Gustavson does it: the postings of
an item's terms are scaled and merged into one dense row of scores. Of each row the best are kept from block
to block, so a task gives no more than k rows an item, and a window over those gives the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize, scratch_path

TOP_K = 10
#: Bytes of item texts in one pass: their terms are broadcast, and the pass reads the documents once.
PASS_BYTES = 16 << 20
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 1 << 20
SLICE_BYTES = 1 << 20
SCALE = 1_000_000_000
SLOPE_PERCENT = 90
SATURATION = 8

#: ASCII letters in lower case and digits stand for themselves, as all bytes of other characters do; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in slices of bounded size."""
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


# ---- documents over the terms of the items


def _counted(shared):
    """Batches of (doc_id, text) to doc_id, n, terms, tfs: the number of all terms, and the items' terms with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        get, none = number.get, repeat(-1)

        def row(text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
            n, seen = 0, []
            for ts in terms_of(text or b""):
                n += len(ts)
                ids = np.fromiter(map(get, ts, none), np.int64, len(ts))
                seen.append(np.unique(ids[ids >= 0], return_counts=True))
            if len(seen) == 1:
                return n, *seen[0]
            ids, at = np.unique(np.concatenate([s[0] for s in seen]) if seen else np.zeros(0, np.int64), return_inverse=True)
            return n, ids, np.bincount(at, np.concatenate([s[1] for s in seen]) if seen else None, len(ids)).astype(np.int64)

        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), BLOCK_DOCS):
                rows = [row(t) for t in texts[i : i + BLOCK_DOCS]]
                ends = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]).astype(kind))) for k, kind in ((1, np.int32), (2, np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(rows)), pa.array([r[0] for r in rows], pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


# ---- the product


def _lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document: 10 + (90 n N) div L."""
    most = int(n.max(initial=0))
    if SLOPE_PERCENT * most * docs < 2**63:
        return 100 - SLOPE_PERCENT + (SLOPE_PERCENT * n * docs) // max(total, 1)
    return np.array([100 - SLOPE_PERCENT + (SLOPE_PERCENT * int(x) * docs) // max(total, 1) for x in n], np.int64)


class Best:
    """The k best (score, doc_id) of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.score, self.doc = np.zeros((items, k), np.int64), np.full((items, k), _LAST, np.int64)

    def add(self, i: int, scores: np.ndarray, docs: np.ndarray) -> None:
        last = self.score[i, -1]
        new = np.flatnonzero((scores > last) | ((scores == last) & (docs < self.doc[i, -1]) & (scores > 0)))
        if len(new):
            s, d = np.concatenate([self.score[i], scores[new]]), np.concatenate([self.doc[i], docs[new]])
            best = np.lexsort((d, -s))[: self.score.shape[1]]
            self.score[i], self.doc[i] = s[best], d[best]


def _ranked(shared, docs: int, total: int, k: int):
    """Batches of (doc_id, n, terms, tfs) to the k best documents of each item in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, columns, times, weights = shared.value  # the items' rows of the multiplicity matrix, and the terms' weights
        items = len(starts) - 1
        best = Best(items, k)
        for b in batches:
            for at in _parts(b.column("terms")):
                part = b.slice(*at)
                terms, tfs = part.column("terms"), part.column("tfs")
                size = np.diff(terms.offsets.to_numpy())
                term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), size)
                m = _lengths(part.column("n").to_numpy(), docs, total)
                impact = weights[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
                order = np.argsort(term, kind="stable")  # term-document rows, compressed
                doc, impact, row = doc[order], impact[order], np.searchsorted(term[order], np.arange(len(weights) + 1))
                names = part.column("doc_id").fill_null(_LAST).to_numpy()
                for i in range(items):
                    mine = columns[starts[i] : starts[i + 1]]
                    acc = np.zeros(part.num_rows, np.int64)
                    for t, x in zip(mine, times[starts[i] : starts[i + 1]], strict=True):
                        s, e = row[t], row[t + 1]
                        if e > s:  # a document stands once in a term's row, so plain indexing adds it
                            acc[doc[s:e]] += impact[s:e] * x
                    best.add(i, acc, names)
        item, rank = np.nonzero(best.score > 0)
        found = pa.array(best.doc[item, rank])
        named = pc.if_else(pc.equal(found, _LAST), None, found)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), named, pa.array(best.score[item, rank])], ["item", "doc_id", "score"])

    return run


def _parts(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with bounded postings."""
    ends, start = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py(), 0
    while start < len(lists):
        done = int(ends[start - 1]) if start else 0
        stop = min(start + BLOCK_DOCS, max(start + 1, int(np.searchsorted(ends, done + BLOCK_POSTINGS, "right"))), len(lists))
        yield start, stop - start
        start = stop


# ---- passes over the items


def _passes(items: DataFrame, pass_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items in order of id, as lists of (item_id, text) of about pass_bytes, read one partition at a time; items of one id stay together."""
    held, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        if size + len(r["text"]) > pass_bytes and held and held[-1][0] != r["item_id"]:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"].encode()))
        size += len(r["text"])
    if held:
        yield held


def _multiplicities(held: list[tuple[int, bytes]], counted: bool) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, terms, and the compressed rows: starts, columns, times) of a pass's items; rows of one id are one item."""
    number: dict[bytes, int] = {}
    rows: dict[int, dict[int, int]] = {}
    for item, text in held:
        row = rows.setdefault(item, {})
        for ts in terms_of(text):
            for t in ts:
                c = number.setdefault(t, len(number))
                row[c] = row.get(c, 0) + 1 if counted else 1
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows.values()])]).astype(np.int64)
    flat = [x for r in rows.values() for x in r.items()]
    return list(rows), list(number), starts, np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", counted: bool = False, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 of each item.

    A term is a run of letters, digits and non-ASCII characters, A-Z in lower case. An item's terms count once
    each, or with counted as often as they occur. Equal scores go by smaller doc_id, null ids last; rows that
    tie on both are interchangeable. Every row is a document of its own, whether its id repeats or not, and
    counts in the statistics; null, empty and termless texts have no score. Items without id are left out,
    rows of one item_id are one item. Other columns are not read. Without documents or items the result is
    empty. Items are taken in passes of about pass_bytes of their texts, each of which reads all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    queries = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).filter("item_id is not null and text is not null")
    out, done = scratch_path(spark, "ranked"), 0
    for held in _passes(queries, pass_bytes):
        ids, terms, starts, columns, times = _multiplicities(held, counted)
        context = spark.sparkContext
        seen = materialize(rows.mapInArrow(_counted(context.broadcast(terms)), "doc_id long, n long, terms array<int>, tfs array<long>"), "item-terms")
        sums = seen.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = np.zeros(len(terms), np.int64)
        for r in seen.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # no more rows than the pass has terms
            df[r[0]] = r[1]
        weights = np.array([math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        best = seen.mapInArrow(_ranked(context.broadcast((starts, columns, times, weights)), sums["docs"], sums["total"], k), "item int, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = best.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item int, item_id long"))  # the items of the pass
        top.join(names, "item").select("item_id", "rank", "doc_id", "score").write.parquet(f"{out}/pass={done}")
        discard(seen)
        done += 1
    schema = "item_id long, rank int, doc_id long, score long"
    return spark.read.schema(schema).parquet(f"{out}/*") if done else spark.createDataFrame([], schema)
