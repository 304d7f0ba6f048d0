"""Near-duplicates by SimHash at a similarity of 0.8: wide fingerprints, pigeonring candidates, exact check.

A document is the set of its SHINGLE-word shingles (words as in simhash; fewer words: the whole
sequence). Two sets of Jaccard similarity J differ in a share acos(2 J / (1 + J)) / pi of their
SimHash bits: 15 % at 0.8, which is 10 of 64 bits, too many for keys of one 64-bit ring. So the
fingerprint is wider: a ring of `segments` segments of `width` bits each.

Candidates. Of a pair within the bound (MAX_SHARE of the bits), chains of consecutive segments that
keep to proportional budgets exist: i segments differ in at most i * MAX_SHARE * width bits. A chain
starts where a whole segment is equal (the join key), and its next 64 bits are checked segment by
segment against the budgets. What passes meets the full Hamming check, and what passes that the
exact Jaccard similarity of the sets. The first budget allows a few bits but the key none, so the
ring is given so many segments that a pair of exactly 0.8 has no equal one, or no chain from it, with a chance
of at most MISS; it falls quickly for more similar pairs and within groups. Keys grow
with the logarithm of the number of fingerprints and the segments with them, so the work for a
document grows as its 0.24th power.

Hot keys. The nodes of keys with about HOT nodes or more are dense: groups of near copies, and texts
that are not quite so similar. Their pairs are not listed. First every dense node is compared with
one centre of its hot keys, in STAR_ROUNDS rounds, which joins most of a group. Then all pairs of
dense nodes in different components that can reach the similarity are found by prefix filtering, an
exact way: of two sets with n <= m shingles that link, in an order of all shingles the first
n - ceil(2 n * NUM / (NUM + DEN)) + 1 of the one and m - ceil(m * NUM / DEN) + 1 of the other share
one, and the first that they share leaves enough of both behind it (Chaudhuri, Ganti and Kaushik,
2006; Xiao et al., 2008). What many dense texts have in common
comes last in that order, so texts that differ each in their own way share no key.

Defined results: equal sets are one node, so documents without words are copies of each other; a
row is a node by its text, also where rows repeat a doc_id; component_id is the smallest doc_id that
is not null; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checked_broadcast, keep, materialize, salt_of, scratch, spread_back
from textloom.llm.components import components
from textloom.llm.simhash import BITS, bit_counts, first_of, labelled, lower_words, rows_to_drop, without

SHINGLE = 5
NUM, DEN = 4, 5
#: The share of bits in which sets of the least similarity differ, and the Hamming bound above it.
FLIP = math.acos(2 * NUM / (NUM + DEN)) / math.pi
MAX_SHARE = 0.2
MISS = 0.03
#: The share of equal segments of a true pair from which a chain keeps to its budgets.
CHAIN_KEPT = 0.96
#: Keys of about so many nodes are hot; they are counted on one of SAMPLED nodes.
HOT = 32
SAMPLED = 4
STAR_ROUNDS = 2
#: Shingles that come last in the order of dense sets: those of LATE or more of a share of 1 / LATE_SAMPLED of the sets,
#: the most frequent ones up to MAX_LATE, told by a bitmap of 2^LATE_BITS places (strangers in it change the order alike for all).
LATE, LATE_SAMPLED, MAX_LATE, LATE_BITS = 4, 8, 200_000, 22
MAX_BROADCAST = 300_000
SALTS = 16


@dataclass(frozen=True)
class Ring:
    """A fingerprint's geometry: `segments` segments of `width` bits in whole 64-bit lanes."""

    width: int
    segments: int

    @property
    def lanes(self) -> int:
        return -(-self.width * self.segments // BITS)

    def budgets(self) -> list[tuple[int, int]]:
        """(bits after the key, most of them that may differ) at each segment of a chain within the next lane."""
        ends = [*range(self.width, BITS, self.width), BITS]
        return [(e, int(MAX_SHARE * (self.width + e))) for e in ends]


def ring_for(n: int) -> Ring:
    """The ring for n fingerprints: up to four strangers a key, and segments enough for MISS."""
    width = min(32, max(10, math.ceil(math.log2(max(n, 2))) - 2))
    found = CHAIN_KEPT * (1 - FLIP) ** width
    return Ring(width, math.ceil(math.log(MISS) / math.log1p(-found)))


def _word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return lower_words(docs, id_col, text_col).select("doc_id", "text_key", F.expr("transform(w, x -> xxhash64(x))").alias("h"))


def _mixed(x):
    """Hashes whose every bit depends on all bits of x."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(hashes):
    """The sorted set of hashes of the shingles of a text with these word hashes."""
    import numpy as np

    n = len(hashes)
    if not n:
        return hashes
    k = min(n, SHINGLE)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = _mixed(total + hashes[i : n - k + 1 + i] * np.uint64(2 * k + 1))
    return np.unique(total)


def _rows(column):
    """The int64 lists of an Arrow column as unsigned NumPy arrays."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.asarray(column.offsets.to_numpy()) - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _node(shingles) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _as_lists(rows):
    import numpy as np

    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat))


def fingerprint(shingles, lanes: int):
    """The SimHash of a set of shingle hashes in that many 64-bit lanes."""
    import numpy as np

    if not len(shingles):
        return np.zeros(lanes, dtype=np.uint64)
    lane = _mixed(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    ones = np.zeros(lanes * BITS, dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1020):
            ones += bit_counts(_mixed(_mixed(shingles[at : at + 1020, None] * lane[None, :])))
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def _printer(lanes: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(h) for h in _rows(b.column(2))]
            columns = [b.column(0), b.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, _as_lists([fingerprint(s, lanes) for s in sets])], ["doc_id", "text_key", "node", "n", "fp"])

    return run


def _setter(batches):
    """Sets by half of each hash, which is enough to count what two sets share."""
    import numpy as np

    for b in batches:
        sets = [shingle_set(h) for h in _rows(b.column(2))]
        halves = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _as_lists(halves)], ["node", "s"])


def chains(nodes: DataFrame, ring: Ring) -> DataFrame:
    """k (a segment and its bits), chain (the 64 bits after it on the ring) and the other columns, for each segment."""

    def lane(at: str) -> str:
        word = f"cast({at} div {BITS} as int)"
        return f"(shiftrightunsigned(fp[{word}], cast({at} % {BITS} as int)) | if({at} % {BITS} = 0, 0L, shiftleft(fp[({word} + 1) % {ring.lanes}], cast({BITS} - {at} % {BITS} as int))))"

    total = ring.lanes * BITS
    key = f"shiftleft(cast(i as bigint), 40) | ({lane(f'(i * {ring.width})')} & {(1 << ring.width) - 1}L)"
    after = lane(f"((i * {ring.width} + {ring.width}) % {total})")
    each = F.expr(f"transform(sequence(0, {ring.segments - 1}), i -> named_struct('k', {key}, 'chain', {after}))")
    others = [c for c in nodes.columns if c != "fp"]
    return nodes.select(*others, F.explode(each).alias("x")).select("x.k", "x.chain", *others)


def _chain_kept(ring: Ring, a: str, b: str) -> Column:
    differ, ok = F.col(a).bitwiseXOR(F.col(b)), F.lit(True)
    for bits, most in ring.budgets():
        mask = (1 << bits) - 1 if bits < BITS else -1
        ok = ok & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= most)
    return ok


def _scanner(ring: Ring):
    """Pairs of each key of rows sorted by k, not both dense (ids below zero), whose chains keep to the budgets."""

    def run(batches):
        import numpy as np

        budgets = [(np.uint64((1 << bits) - 1), most) for bits, most in ring.budgets()]
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            k, chain, node = rows
            chain, dense, found = chain.view(np.uint64), node < 0, []
            for lag in range(1, len(k)):
                equal = k[lag:] == k[:-lag]
                if not equal.any():
                    break
                at = np.nonzero(equal & ~(dense[lag:] & dense[:-lag]))[0]
                differ = chain[at + lag] ^ chain[at]
                for mask, most in budgets:
                    ok = np.bitwise_count(differ & mask) <= most
                    at, differ = at[ok], differ[ok]
                found.append(np.stack([node[at], node[at + lag]]))
            pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            if pairs.size:
                pairs = np.unique(np.sort(np.where(pairs < 0, -1 - pairs, pairs), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])
            first = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            held = [x[first:] for x in rows]

    return run


def _prefixes(late):
    """x, id, n, c and at: the first shingles of each set in the order, and their places."""

    def run(batches):
        import numpy as np

        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.asarray(b.column(2).offsets.to_numpy()) - b.column(2).offsets[0].as_py()
            out = []
            for i in range(b.num_rows):
                s = flat[ends[i] : ends[i + 1]]
                n = len(s)
                place = s.view(np.uint32) & np.uint32((1 << LATE_BITS) - 1)
                is_late = (late.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                order = np.lexsort((s, is_late))
                probe = n - -(-n * NUM // DEN) + 1
                out.append((s[order[:probe]], np.full(probe, i), np.full(probe, n), np.arange(probe)))
            if out:
                x, row, n, at = (np.concatenate(y) for y in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), b.column(0).take(pa.array(row)), pa.array(n, pa.int32()), b.column(1).take(pa.array(row)), pa.array(at, pa.int32())], ["x", "id", "n", "c", "at"])

    return run


def _late_bitmap(sets: DataFrame):
    import numpy as np

    some = sets.filter(F.pmod(F.xxhash64("id"), F.lit(LATE_SAMPLED)) == 0).select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("m"))
    bits = np.zeros(1 << (LATE_BITS - 3), dtype=np.uint8)
    for r in some.filter(F.col("m") >= LATE).orderBy(F.desc("m"), "x").limit(MAX_LATE).select("x").collect():
        place = r["x"] & ((1 << LATE_BITS) - 1)
        bits[place >> 3] |= 1 << (place & 7)
    return sets.sparkSession.sparkContext.broadcast(bits)


def dense_pairs(sets: DataFrame, found: DataFrame | None) -> DataFrame:
    """Pairs (u, v) of the sets (id, s) in different components that may reach the similarity; none that does is passed over."""
    rows = _with_component(sets, found).select("id", "c", "s")
    keys = materialize(rows.mapInArrow(_prefixes(_late_bitmap(sets)), "x int, id long, n int, c long, at int"), "prefixes")
    other = keys.select("x", *[F.col(a).alias(f"{a}2") for a in ("id", "n", "c", "at")])
    order = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("id") < F.col("id2")))
    shared = F.expr(f"((n + n2) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}")  # at least, of sets that link
    room = (F.col("n") - F.col("at") >= shared) & (F.col("n2") - F.col("at2") >= shared)
    short = F.col("at") <= F.expr(f"n - (2 * n * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}")
    met = keys.filter(short).join(other, "x").filter(order & (F.col("c") != F.col("c2")) & (F.col("n") * DEN >= F.col("n2") * NUM) & room)
    return met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct()


def _with_both(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """pairs (u, v) with the named columns of values (id, ...) for either side, however often an id occurs."""
    rows = pairs.withColumns({"us": salt_of(F.col("v"), SALTS), "vs": salt_of(F.col("u"), SALTS)})
    for side, other in (("u", "v"), ("v", "u")):
        salts = pairs.groupBy(side).agg(F.collect_set(salt_of(F.col(other), SALTS)).alias("salts"))
        own = salts.join(values.select(F.col("id").alias(side), *[F.col(x).alias(f"{side}_{x}") for x in names]), side)
        rows = spread_back(rows, side, f"{side}s", own, "inner")
    return rows


def _with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("c", F.col("id"))
    found = found.select(F.col("node").alias("id"), "component")
    return rows.join(checked_broadcast(found, MAX_BROADCAST), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def links(docs: DataFrame, nodes: DataFrame, ring: Ring, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between the ids of the nodes (id, node, n, fp, one: the doc_id of one document), enough for their components."""

    def sets_of(some: DataFrame) -> DataFrame:
        """id and s of the nodes (id, node, one): from one document of each."""
        one = checked_broadcast(some.select(F.col("one").alias("_tl_one")).distinct(), MAX_BROADCAST)
        texts = docs.join(one, F.col(f"`{id_col}`").cast("long").eqNullSafe(one["_tl_one"]), "left_semi")
        sets = _word_hashes(texts, id_col, text_col).mapInArrow(_setter, "node long, s array<int>")
        return materialize(sets.join(checked_broadcast(some.select("id", "node"), MAX_BROADCAST), "node").select("id", "s").dropDuplicates(["id"]), "sets")

    def verified(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (u, v) within the Hamming bound whose sets reach the similarity."""
        both = _with_both(materialize(pairs, "candidates"), nodes, "fp", "n")
        fit = (F.col("u_n") * DEN >= F.col("v_n") * NUM) & (F.col("v_n") * DEN >= F.col("u_n") * NUM)
        bits = F.expr("aggregate(zip_with(u_fp, v_fp, (a, b) -> cast(bit_count(a ^ b) as int)), 0, (x, y) -> x + y)")
        near = materialize(both.filter(fit & (bits <= int(MAX_SHARE * ring.lanes * BITS))).select("u", "v"), "near")
        if sets is None:
            paired = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            sets = sets_of(materialize(nodes.join(checked_broadcast(paired, MAX_BROADCAST), "id", "left_semi").select("id", "node", "one"), "paired"))
        shared = F.size(F.array_intersect("u_s", "v_s"))
        return materialize(_with_both(near, sets, "s").filter(shared * (NUM + DEN) >= (F.size("u_s") + F.size("v_s")) * NUM).select("u", "v"), "links")

    keyed = chains(nodes.filter("n > 0").select("id", "fp"), ring)
    # hot keys are told by one of SAMPLED nodes, which decides the way a key's pairs are found and nothing else
    sampled = keyed.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).groupBy("k").agg(F.count("*").alias("m"))
    hot = materialize(sampled.filter(F.col("m") * SAMPLED >= HOT).select("k"), "hot")
    out, scan = [], keyed
    if not hot.isEmpty():
        hot = checked_broadcast(hot, MAX_BROADCAST)
        members = materialize(keyed.join(hot, "k", "left_semi"), "members")
        # a node whose keys are those of many others is in the middle of its group
        sizes = checked_broadcast(materialize(members.groupBy("k").agg(F.count("*").alias("m")), "sizes"), MAX_BROADCAST)
        middle = materialize(members.join(sizes, "k").groupBy("id").agg(F.sum("m").alias("score")), "middle")
        sets = sets_of(materialize(nodes.join(checked_broadcast(middle, MAX_BROADCAST), "id", "left_semi").select("id", "node", "one"), "dense"))
        members = materialize(members.join(checked_broadcast(middle, MAX_BROADCAST), "id").select("k", "chain", "id", "score"), "members")
        # each key has a centre, and each node is compared with one of the centres it shares a key with: first
        # with the one most in the middle, then with any of another component
        found = None
        for turn in range(STAR_ROUNDS):
            now = _with_component(members, found)
            order = F.struct((-F.col("score")).alias("s"), "id") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "id").alias("s"), "id")
            centre = F.min_by(F.struct(F.col("id").alias("v"), F.col("chain").alias("chain2"), F.col("c").alias("c2"), order.alias("o")), order)
            centres = materialize(now.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), centre.alias("v")).filter("lo != hi").select("k", "v.*"), "centres")
            near = now.join(checked_broadcast(centres, MAX_BROADCAST), "k").filter((F.col("c") != F.col("c2")) & _chain_kept(ring, "chain", "chain2"))
            out.append(verified(near.groupBy(F.col("id").alias("u")).agg(F.min_by("v", "o").alias("v")), sets))
            found = components(reduce(DataFrame.unionByName, out))
        out.append(verified(dense_pairs(sets, found), sets))
        # all pairs of a hot key are pairs of dense nodes; ids below zero tell these to the scan
        dense = checked_broadcast(middle.select("id", F.lit(True).alias("dense")), MAX_BROADCAST)
        scan = keyed.join(hot, "k", "left_anti").join(dense, "id", "left").withColumn("id", F.when(F.col("dense"), -1 - F.col("id")).otherwise(F.col("id")))
    pairs = scan.select("k", "chain", "id").repartition("k").sortWithinPartitions("k").mapInArrow(_scanner(ring), "u long, v long")
    return reduce(DataFrame.unionByName, [*out, verified(pairs.distinct())])


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, node, component_id and gone of every row."""
    ring = ring_for(docs.count())
    prints = _word_hashes(docs, id_col, text_col).mapInArrow(_printer(ring.lanes), "doc_id long, text_key long, node long, n int, fp array<bigint>")
    prints = materialize(prints, "fingerprints").withColumn("salt", salt_of(F.col("doc_id"), SALTS))
    by_salt = prints.groupBy("node", "salt").agg(first_of().alias("first"), F.min("doc_id").alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    nodes = by_salt.groupBy("node").agg(F.min("first").alias("first"), F.min("one").alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.collect_set("salt").alias("salts"))
    # numbers given once and stored: they are shorter than hashes where they are sent about
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    found = components(links(docs, nodes.select("id", "node", "n", "fp", "one"), ring, id_col, text_col))
    return labelled(prints.drop("n", "fp"), nodes.select("id", "node", "first", "salts"), found, "node", "id").drop("salt")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every row."""
    return grouped(docs, id_col, text_col).select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group of near-duplicates: the one with the smallest id."""
    with scratch(docs.sparkSession):
        drop = keep(rows_to_drop(grouped(docs, id_col, text_col)))
    return without(docs, drop, id_col, text_col)
