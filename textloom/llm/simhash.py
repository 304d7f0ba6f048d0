"""SimHash near-duplicates: 64-bit fingerprints linked at small Hamming distance by pigeonring filtering.

Fingerprints. Words are maximal runs of other than ASCII white space of the text with A-Z
lower-cased; features are its word shingles, repeats included (fewer words: the whole sequence).
The JVM hashes them (XXH64, seed 42); NumPy takes the bit majorities of each hash list.

Candidates. Exact copies share a fingerprint and are one node. The 64 bits are a ring of segments.
If two fingerprints differ in at most MAX_BITS bits, then from some segment on, every chain of i
consecutive segments differs in at most i * MAX_BITS / segments bits (Qin and Xiao, 2018). Where
that budget is below one the chain is equal, which is the join key; the rest of the chain is
checked on each candidate before the full Hamming check. More fingerprints take more and smaller
segments (segments_for), which makes the keys longer: 24, 28 or 30 bits.

Hot keys. A key with more than MAX_BUCKET fingerprints, which is where its pairs outnumber
1 + BITS values a fingerprint, emits no pairs. Its fingerprints go to an exact way of linear size:
two of them are within two bits just if some value is within one bit of both, so each emits itself
and its 64 one-bit neighbours, and all that share a value link to the smallest. No pair of a large
group is listed and none is lost.

Components of the links come from components(); the answer goes back to the documents through
(fingerprint, salt), as copies may be a third of all rows.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a row
is a node by its text, so a doc_id that rows repeat under different texts has the component of each;
component_id is the smallest doc_id that is not null, or null if there is none; an empty table gives
an empty table; only the id and text columns are read. keep_one() keeps, of each group, the row with
the smallest id (ties: smallest text hash; equal rows: one of them) and every row without an id, and
loses no text that nothing kept stands for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checked_broadcast, fresh, keep, materialize, salt_of, scratch, spread_back, words
from textloom.llm.components import components

SHINGLE = 3
MAX_BITS = 2
BITS = 64
#: n fingerprints of a key list n (n - 1) / 2 pairs, or n (1 + BITS) values the other way.
MAX_BUCKET = 2 * (1 + BITS)
#: Fingerprints up to which a number of segments keeps the mean key at 16 or below.
SEGMENTS_UP_TO = ((8, 16 << 24), (16, 16 << 28))
MOST_SEGMENTS = 32
MAX_BROADCAST_IDS = 2_000_000
SALTS = 64


def bit_counts(hashes):
    """How many of the hashes (rows of one or more 64-bit lanes) have each bit set."""
    import numpy as np

    rows = hashes.reshape(len(hashes), -1)
    ones = np.zeros(rows.shape[1] * BITS, dtype=np.int64)
    for at in range(0, len(rows), 255):  # 255 rows at most, so that sums fit bytes
        part = np.ascontiguousarray(rows[at : at + 255]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return ones


def _majorities(batches):
    import numpy as np

    for b in batches:
        column = b.column(2)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        ends = np.asarray(column.offsets.to_numpy()) - column.offsets[0].as_py()
        out = np.zeros(b.num_rows, dtype=np.uint64)
        for i in range(b.num_rows):
            lo, hi = ends[i], ends[i + 1]
            if hi > lo:
                out[i] = np.packbits(2 * bit_counts(flat[lo:hi]) > hi - lo, bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64), pa.int64())], ["doc_id", "text_key", "fp"])


def text_key(text_col: str) -> Column:
    """A 64-bit hash that tells rows of one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def lower_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key and w, the words of the text with A-Z lower-cased."""
    ascii_lower = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), words(ascii_lower).alias("w"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long)."""
    parts = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(shingle))
    hashed = lower_words(docs, id_col, text_col).select(
        "doc_id",
        "text_key",
        F.expr(
            f"case when size(w) = 0 then array() when size(w) < {shingle} then array(xxhash64(array_join(w, ' '))) "
            f"else transform(slice(w, 1, size(w) - {shingle - 1}), (x, i) -> xxhash64(concat_ws(' ', {parts}))) end"
        ).alias("h"),
    )
    return hashed.mapInArrow(_majorities, "doc_id long, text_key long, fp long")


def _mask(first: int, count: int, segments: int) -> int:
    """The bits of `count` segments of the ring from `first` on, as a signed long."""
    width = BITS // segments
    m = 0
    for s in range(first, first + count):
        m |= ((1 << width) - 1) << (width * (s % segments))
    return m - (1 << 64) if m >> 63 else m


def chain_budgets(segments: int, max_bits: int = MAX_BITS) -> list[int]:
    """Most differing bits in the first i segments of a chain, for i from 1 on."""
    return [i * max_bits // segments for i in range(1, segments + 1)]


def segments_for(n: int) -> int:
    """The number of ring segments for n fingerprints."""
    return next((s for s, most in SEGMENTS_UP_TO if n <= most), MOST_SEGMENTS)


def ring_keys(nodes: DataFrame, segments: int, max_bits: int = MAX_BITS) -> DataFrame:
    """ring (the chain's first segment), key (its bits that must be equal) and fp."""
    equal = chain_budgets(segments, max_bits).count(0)
    keys = [F.struct(F.lit(s).alias("ring"), F.col("fp").bitwiseAND(F.lit(_mask(s, equal, segments))).alias("key")) for s in range(segments)]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.ring", "k.key", "fp")


def ring_links(keyed: DataFrame, segments: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) among the fingerprints of each key: chains within budget, then the full Hamming check."""
    budgets = chain_budgets(segments, max_bits)
    other = keyed.select("ring", "key", F.col("fp").alias("fp2"))
    differ = F.col("fp").bitwiseXOR(F.col("fp2"))
    chain = F.lit(True)
    for i in range(budgets.count(0) + 1, segments):
        by_ring = F.element_at(F.array(*[F.lit(_mask(s, i, segments)) for s in range(segments)]), F.col("ring") + 1)
        chain = chain & (F.bit_count(differ.bitwiseAND(by_ring)) <= budgets[i - 1])
    near = keyed.join(other, ["ring", "key"]).filter((F.col("fp") < F.col("fp2")) & chain & (F.bit_count(differ) <= max_bits))
    return near.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))


def neighbour_links(members: DataFrame) -> DataFrame:
    """Links (u, v) that join any two fingerprints within two bits: each to the smallest that shares a one-bit neighbour."""
    values = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(BITS)]]
    around = members.select("fp", F.explode(F.array(*values)).alias("value")).withColumn("salt", salt_of(F.col("fp"), SALTS))
    by_salt = around.groupBy("value", "salt").agg(F.min("fp").alias("v"))
    least = by_salt.groupBy("value").agg(F.min("v").alias("v"), F.collect_set("salt").alias("salts"))
    return spread_back(around, "value", "salt", least, "inner").filter("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def links(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp, enough for their components."""
    if max_bits != 2:
        raise ValueError("the way of hot keys is exact for two bits; similar.py serves wider bounds")
    segments = segments or segments_for(nodes.count())
    keyed = materialize(ring_keys(nodes, segments, max_bits), "keyed")
    sizes = keyed.groupBy("ring", "key").agg(F.count("*").alias("n")).filter("n > 1")
    cold = keyed.join(sizes.filter(F.col("n") <= max_bucket).select("ring", "key"), ["ring", "key"], "left_semi")
    hot = sizes.filter(F.col("n") > max_bucket).select("ring", "key")
    members = keyed.join(hot, ["ring", "key"], "left_semi").select("fp").distinct()
    return ring_links(cold, segments, max_bits).unionByName(neighbour_links(members))


def labelled(rows: DataFrame, nodes: DataFrame, found: DataFrame, key: str, node_id: str | None = None) -> DataFrame:
    """rows with component_id and gone (whether keep_one() drops the row).

    rows has doc_id, text_key, salt and key; nodes has key, first (its least (doc_id, text_key)) and
    salts; found has the node and component of those that reach a smaller one, by node_id or else key.
    """
    node_id = node_id or key
    found = found.select(F.col("node").alias(node_id), "component")
    placed = materialize(nodes.join(found, node_id, "left").select(key, "first", "salts", F.coalesce("component", node_id).alias("c")), "placed")
    least = placed.groupBy("c").agg(F.min("first").alias("first"))
    answer = placed.drop("first").join(least, "c").select(key, "first", "salts")
    out = spread_back(rows, key, "salt", answer, "inner")
    gone = F.coalesce((F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_key") != F.col("first.text_key")), F.lit(False))
    return out.withColumns({"component_id": F.col("first.doc_id"), "gone": gone}).drop("first")


def first_of() -> Column:
    """The aggregate that finds the least (doc_id, text_key) of rows with an id."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_key, fp, component_id and gone of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints").withColumn("salt", salt_of(F.col("doc_id"), SALTS))
    by_salt = prints.groupBy("fp", "salt").agg(first_of().alias("first"))
    nodes = materialize(by_salt.groupBy("fp").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts")), "nodes")
    return labelled(prints, nodes, components(links(nodes.select("fp"), **options)), "fp").drop("salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    found = grouped(docs, id_col, text_col, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group of near-duplicates: the one with the smallest id."""
    with scratch(docs.sparkSession):
        drop = keep(rows_to_drop(grouped(docs, id_col, text_col)))
    return without(docs, drop, id_col, text_col)


def rows_to_drop(groups: DataFrame) -> DataFrame:
    """The (id, text hash) pairs of groups (doc_id, text_key, gone) that go, and those that several rows have."""
    pairs = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_tl_id"), F.col("text_key").alias("_tl_key")).agg(F.max("gone").alias("gone"), F.count("*").alias("n"))
    return materialize(pairs.filter("gone or n > 1").select("_tl_id", "_tl_key", "gone"), "drop")


def without(docs: DataFrame, out: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that rows_to_drop() does not drop, one of each that are equal in id and text.

    The pairs are broadcast up to MAX_BROADCAST_IDS counted ones, so that the texts need no shuffle; beyond
    that the join shuffles.
    """
    (key,) = fresh(docs, "text_key")
    keyed = docs.withColumn(key, text_key(text_col))

    def same_row(other: DataFrame) -> Column:
        return (keyed[id_col].cast("long") == other["_tl_id"]) & (keyed[key] == other["_tl_key"])

    drop = checked_broadcast(out.select("_tl_id", "_tl_key"), MAX_BROADCAST_IDS)
    kept = keyed.join(drop, same_row(drop), "left_anti")
    repeated = out.filter("not gone").select("_tl_id", "_tl_key")
    if not repeated.isEmpty():
        repeated = checked_broadcast(repeated, MAX_BROADCAST_IDS)
        kept = kept.unionByName(keyed.join(repeated, same_row(repeated), "left_semi").dropDuplicates([id_col, key]))
    return kept.drop(key)
