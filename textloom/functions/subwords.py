"""Sub-words of given words by the longest piece of a vocabulary table, and windows over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary is held by every Python worker.
MAX_PIECES = 1_000_000
#: Words that a worker remembers.
CACHED_WORDS = 200_000
#: Rows that a worker holds as Python objects at a time, whatever the size of a batch.
ROWS = 64


def longest_pieces(word: str, ids: dict[str, int], longest: int, inner: str, unknown: int) -> list[int]:
    """Ids of the longest pieces from left to right; the unknown id alone where a place has none."""
    out, at = [], 0
    while at < len(word):
        prefix = inner if at else ""
        end = next((e for e in range(min(len(word), at + longest), at, -1) if prefix + word[at:e] in ids), None)
        if end is None:
            return [unknown]
        out.append(ids[prefix + word[at:end]])
        at = end
    return out


def with_subwords(df: DataFrame, tokens: str, vocabulary: DataFrame, inner: str = "##", unknown: int = 0, pieces: str | None = None) -> DataFrame:
    """df with piece_ids and word_ids: the pieces of an array of words, and the place of each one's word.

    vocabulary: piece, id; pieces inside a word begin with `inner`. Words are looked up once per worker and
    remembered. Null or empty words have no pieces, a null array none. pieces names a third column, the pieces
    as written (null for the unknown id). A worker holds the words of ROWS rows at a time.
    """
    spark = df.sparkSession
    known_pieces = vocabulary.select("piece", "id").filter("piece is not null and id is not null")
    if (n := known_pieces.count()) > MAX_PIECES:
        raise ValueError(f"a vocabulary of {n} pieces; at most {MAX_PIECES} are held in memory")
    shared = spark.sparkContext.broadcast({r[0]: r[1] for r in known_pieces.toLocalIterator()})
    wanted = ["piece_ids", "word_ids", *([pieces] if pieces else [])]
    kinds = [pa.int32(), pa.int32(), pa.string()][: len(wanted)]

    @F.arrow_udf("struct<piece_ids:array<int>,word_ids:array<int>" + (",pieces:array<string>>" if pieces else ">"))
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, known = shared.value, {}
        longest = max(map(len, ids), default=0)
        written = {i: p for p, i in ids.items()} if pieces else {}
        for batch in parts:
            for at in range(0, max(len(batch), 1), ROWS):  # the whole batch as Python's strings would not fit a worker
                found, places, ends = [], [], [0]
                for words in batch.slice(at, ROWS).to_pylist():
                    for i, w in enumerate(words or ()):
                        if w and w not in known:
                            if len(known) >= CACHED_WORDS:
                                known.clear()
                            known[w] = longest_pieces(w, ids, longest, inner, unknown)
                        got = known[w] if w else []
                        found += got
                        places += [i] * len(got)
                    ends.append(len(found))
                columns = [found, places, [written.get(i) for i in found] if pieces else None]
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, k)) for c, k in zip(columns, kinds, strict=False)]
                yield pa.StructArray.from_arrays(lists, ["piece_ids", "word_ids", "pieces"][: len(lists)])

    made = dict(zip(wanted, ("piece_ids", "word_ids", "pieces"), strict=False))
    return df.withColumn("_sub", split(F.col(tokens))).withColumns({c: F.col(f"_sub.{f}") for c, f in made.items()}).drop("_sub")


def windows(ids: Column, length: int, overlap: int = 0) -> Column:
    """array<array>: slices of at most length ids, each beginning with the last `overlap` of the one before; one, if all fit."""
    if not 0 <= overlap < length:
        raise ValueError("windows must go on: 0 <= overlap < length")
    step = length - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size(ids) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(ids, k * step + 1, F.lit(length)))
