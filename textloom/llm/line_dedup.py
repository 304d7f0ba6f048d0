"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

The distinct line hashes with their document counts are dealt to shards by hash; each shard is one row of
a small table: the level bits of a minimal perfect hash, an array of fingerprints and an array of counts.
Documents never join lines. While all arrays together stay under a bound they are broadcast and every
document looks its lines up where it stands. Beyond it the arrays travel to the narrow line hashes: each
shard's arrays head the sorted stream of the hashes dealt to it, salted so that a line of a third of all
documents is looked up in many tasks, and only hits come back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, fresh, materialize

MIN_DOCS = 10
MIN_CHARS = 1
SHARD_KEYS = 1 << 17
GAMMA = 1.5
BROADCAST_BYTES = 64 << 20
SALTS = 16
BLOCK_LINES = 1 << 18

_WHITE = b" \t\n\x0b\x0c\r"
_DROPPED = "h1 long, h2 long"
_INDEX = "shard int, n long, sizes binary, bits binary, fingerprints binary, counts binary"


def line_keys(text: bytes) -> list[bytes]:
    """The keys of the lines of a UTF-8 text: ASCII white space stripped, A-Z lower-cased."""
    return [x.strip(_WHITE).lower() for x in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def digests(keys: Iterable[bytes]) -> np.ndarray:
    """(n, 2) of int64: the 128-bit hashes of keys."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


# ---- the minimal perfect hash of a shard


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of levels of bits: a key stands at its first level where no other key met it."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones  # bits in the words before; made on loading, not stored

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        """h1, h2: uint64 halves of distinct keys."""
        sizes, words, level = [], [], 0
        while len(h1):
            size = max(64, -(-int(gamma * len(h1)) // 64) * 64)
            at = _slots(h1, h2, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            h1, h2, level = h1[left], h2[left], level + 1
        return cls(np.array(sizes, "<i8"), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each key among all; -1 or any place for a key that is not in the set."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + _slots(h1[left], h2[left], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left, base = left[~hit], base + int(size)
        return out


class Shard:
    """Counts of the keys of one shard; 0 for any other key, as its fingerprint differs."""

    def __init__(self, sizes: bytes, bits: bytes, fingerprints: bytes, counts: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, "<u8"))
        self.fingerprints, self.counts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u2")

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.hash.lookup(h1, h2)
        found = at >= 0
        found[found] = self.fingerprints[at[found]] == h2[found]
        return np.where(found, self.counts[np.where(found, at, 0)], 0) if len(self.counts) else np.zeros(len(h1), np.uint16)


def _build_shard(keys: pa.Table) -> pa.Table:
    h1, h2, n = (keys.column(c).to_numpy() for c in ("h1", "h2", "n"))
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    made = PerfectHash.build(h1, h2)
    at = made.lookup(h1, h2)
    fingerprints, counts = np.zeros(len(h1), "<u8"), np.zeros(len(h1), "<u2")
    fingerprints[at], counts[at] = h2, np.minimum(n, 65535)
    row = {"shard": [keys.column("shard")[0].as_py()], "n": [len(h1)], "sizes": [made.sizes.tobytes()], "bits": [made.words.tobytes()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()]}
    return pa.table({"shard": pa.array(row["shard"], pa.int32()), "n": pa.array(row["n"], pa.int64())} | {k: pa.array(row[k], pa.binary()) for k in ("sizes", "bits", "fingerprints", "counts")})


# ---- hashes of lines, and the index over them


def _hashed(min_chars: int):
    """Batches of a text column to the distinct line hashes of each text (h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t is not None:
                    found = digests({k for k in line_keys(t) if long_enough(k, min_chars)})
                    out.append(found)
                    size += len(found)
                if size > BLOCK_LINES:
                    yield _pairs(np.concatenate(out))
                    out, size = [], 0
            if size:
                yield _pairs(np.concatenate(out))

    return run


def _pairs(h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1)], ["h1", "h2"])


def line_counts(docs: DataFrame, text_col: str = "text", min_docs: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n: the hashes of the lines that at least min_docs rows of docs hold, with that number.

    A row counts once for a line, repeated rows each for themselves; a line of a third of all rows is
    summed before the shuffle.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_hashed(min_chars), _DROPPED)
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)


def line_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(a row per shard: shard, n, sizes, bits, fingerprints, counts; the number of shards) over (h1, h2, n).

    About ten bytes a key; counts end at 65535. Shards are even, as keys go by hash, so each is built in one
    task's memory.
    """
    counts = materialize(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))
    dealt = counts.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "n")
    index = materialize(dealt.groupBy("shard").applyInArrow(_build_shard, _INDEX), "line-index")
    discard(counts)
    return index, shards


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return h1 % shards  # as pmod: numpy's remainder has the sign of the divisor


def _probe(loaded: dict[int, Shard], shards: int, h: np.ndarray) -> np.ndarray:
    """The document count of each hash (0: not in the index)."""
    out, of = np.zeros(len(h), np.int64), _shard_of(h[:, 0], shards)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        if shard := loaded.get(int(of[part[0]])):
            out[part] = shard.count(*(np.ascontiguousarray(h[part, i]).view(np.uint64) for i in (0, 1)))
    return out


def _cleaned(texts: list[bytes | None], drop, min_chars: int, names: list[str]) -> pa.RecordBatch:
    """text, n_lines, n_dropped of texts; drop: digests of all lines (n, 2) to flags."""
    lines = [(t or b"").split(b"\n") for t in texts]
    keys = [x.strip(_WHITE).lower() for ls in lines for x in ls]
    flags = drop(digests(keys)) & np.fromiter((long_enough(k, min_chars) for k in keys), bool, len(keys))
    kept, gone, at = [], [], 0
    for ls in lines:
        bad = flags[at : at + len(ls)]
        at += len(ls)
        n = int(bad.sum())
        gone.append(n)
        kept.append(b"\n".join(ls) if not n else b"\n".join([x for x, no in zip(ls, bad.tolist(), strict=True) if not no]))
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(x) for x in lines], pa.int64()), pa.array(gone, pa.int64())], names)


def _blocks(texts: list[bytes | None], chars: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _with_index(shared, shards: int, min_docs: int, min_chars: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {s: Shard(*arrays) for s, *arrays in shared.value}
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for i, j in _blocks(texts):
                yield _replaced(b.slice(i, j - i), at, _cleaned(texts[i:j], lambda h: _probe(loaded, shards, h) >= min_docs, min_chars, ["t", "n", "d"]))

    return run


def _replaced(b: pa.RecordBatch, at: int, made: pa.RecordBatch) -> pa.RecordBatch:
    columns = [*b.columns[:at], made.column(0), *b.columns[at + 1 :], made.column(1), made.column(2)]
    return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])


def _with_hits(min_chars: int, at: int):
    """As _with_index, for rows whose last two columns are the halves of the hashes to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            hits, width = [b.column(b.num_columns - k).to_pylist() for k in (2, 1)], b.num_columns - 2
            plain = pa.RecordBatch.from_arrays(b.columns[:width], [str(i) for i in range(width)])
            for i in range(len(texts)):
                bad = set(zip(hits[0][i] or (), hits[1][i] or (), strict=True))
                yield _replaced(plain.slice(i, 1), at, _cleaned(texts[i : i + 1], lambda h, bad=bad: np.fromiter(((x, y) in bad for x, y in h.tolist()), bool, len(h)), min_chars, ["t", "n", "d"]))

    return run


def _text_hashes(min_chars: int):
    """Batches of a text column to (t1, t2, h1, h2): the hash of the text, and its distinct line hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                if t:
                    h = digests({k for k in line_keys(t) if long_enough(k, min_chars)})
                    own = np.broadcast_to(digests([t]), (len(h), 2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for x in (own, h) for i in (0, 1)], ["t1", "t2", "h1", "h2"])

    return run


def _own_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the text, with the halves of its hash after it."""
    for b in batches:
        h = digests([t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(h[:, i])) for i in (0, 1))], [str(i) for i in range(b.num_columns + 2)])


def _streamed(shards: int, min_docs: int):
    """Sorted rows of shards, the arrays of each before its line hashes, to the hashes that are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict[int, Shard] = {}
        for b in batches:
            kinds = b.column("kind").to_numpy()
            heads = np.flatnonzero(kinds == 0)
            for i, j in zip([0, *(heads + 1)], [*heads, b.num_rows], strict=True):
                if j > i:
                    h = np.stack([b.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in ("h1", "h2")], 1).astype(np.int64)
                    bad = pa.array(_probe(current, shards, h) >= min_docs)
                    yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i).filter(bad) for c in ("t1", "t2", "h1", "h2")], ["t1", "t2", "h1", "h2"])
                if j < b.num_rows:
                    current = {b.column("shard")[j].as_py(): Shard(*(b.column(c)[j].as_py() for c in ("sizes", "bits", "fingerprints", "counts")))}

    return run


def _hits(docs: DataFrame, text_col: str, index: DataFrame, shards: int, min_docs: int, min_chars: int, salts: int) -> DataFrame:
    """t1, t2, a1, a2: of each text that loses lines their hashes, found where its lines' shards are."""
    lines = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_text_hashes(min_chars), "t1 long, t2 long, h1 long, h2 long")
    none = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "bits", "fingerprints", "counts")]
    salted = lines.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("t1", "t2"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "t1", "t2", "h1", "h2", *none)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "h1", "h2")]
    heads = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), *nothing, "sizes", "bits", "fingerprints", "counts")
    dealt = heads.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = dealt.mapInArrow(_streamed(shards, min_docs), "t1 long, t2 long, h1 long, h2 long")
    each = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("h"))
    return each.select("t1", "t2", F.col("h.h1").alias("a1"), F.col("h.h2").alias("a2"))


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """docs with the text lacking the lines that min_docs or more rows hold, and n_lines, n_dropped.

    Lines are compared by key (ASCII white space at the ends stripped, A-Z lower-cased); keys of fewer than
    min_chars code points stay. All of a dropped key's lines go, in every row; the other lines stay as they
    are, in order, joined by \\n. A null text is an empty one, which is one empty line; a text that loses all
    its lines becomes empty. Repeated rows, ids equal or null, are documents of their own. The other columns
    pass through whatever they are called, but columns named n_lines and n_dropped are replaced. An empty
    table gives an empty one. Keys are known by 128-bit hashes; a line that is not in the index is told by a
    64-bit fingerprint.
    """
    base = docs.drop("n_lines", "n_dropped")
    index, shards = line_index(line_counts(base, text_col, min_docs, min_chars))
    at, types = base.columns.index(text_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    schema = f"{types}, n_lines long, n_dropped long"
    size = index.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in ("sizes", "bits", "fingerprints", "counts"))), F.lit(0))).first()[0]
    if size <= broadcast_bytes:  # the driver holds no more than that
        arrays = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in index.select("shard", "sizes", "bits", "fingerprints", "counts").toLocalIterator()]
        discard(index)
        return base.mapInArrow(_with_index(base.sparkSession.sparkContext.broadcast(arrays), shards, min_docs, min_chars, at), schema)
    hits = materialize(_hits(base, text_col, index, shards, min_docs, min_chars, salts), "line-hits")
    discard(index)
    text, t1, t2, a1, a2 = fresh(base, "text", "t1", "t2", "a1", "a2")
    keyed = base.withColumn(text, F.col(f"`{text_col}`"))
    keyed = keyed.mapInArrow(_own_hash, f"{types}, `{text}` string, `{t1}` long, `{t2}` long").drop(text)
    joined = keyed.join(hits, (F.col(t1) == hits["t1"]) & (F.col(t2) == hits["t2"]), "left").select(*[keyed[f"`{c}`"] for c in base.columns], hits["a1"].alias(a1), hits["a2"].alias(a2))
    return joined.mapInArrow(_with_hits(min_chars, at), schema)
