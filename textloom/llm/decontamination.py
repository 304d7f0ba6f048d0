"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case alphanumeric tokens. A fixed mask keeps some token positions of a span and
ignores the rest, so a seed survives substitutions at the ignored places. Seeds of every position
of the benchmark are joined with those of the documents; each hit fixes an alignment of a document
to an item, and the overlap around it is verified token by token.

What counts: MIN_OVERLAP aligned tokens of which MIN_MATCH or more agree; of an item with fewer tokens
all of it, with as large a share; of an item with fewer than LEAST_LOOSE tokens every token; and an item
of fewer than LEAST_PASSAGE tokens must be the whole text. The masks are lossless: whichever tokens of
such an overlap are substituted, one of the masks has a seed left in it (the tests try all patterns),
so every overlap that counts is found, to a hash collision. Items shorter than LEAST_LOOSE have seeds
of all their tokens.

Places of one text with the same tokens around them, as far as an overlap reaches, give the same overlaps:
the first of them stands for all, of an item before the join and of a document after it. So a text of one
repeated token or line is verified against an item of the same kind in a few alignments, not in as many as
there are pairs of places.

A bitmap of the token pairs that start the benchmark's seeds passes over positions that cannot
join before they are hashed. Everything is built-in expressions. Documents are worked on by the hash
of their text, so copies share their hits, and rows without an id or with a repeated one are told
apart. The benchmark's seeds and tokens are broadcast if a count proves them to be small, otherwise
the joins shuffle, that of the seeds with salts. Verification reads only the documents with a hit, through a semi join on the text
hashes: broadcast up to MAX_BROADCAST_IDS counted ones, and a shuffle join beyond.

Defined results: null and empty texts and items hit nothing; an item_id that repeats counts once, by
its best text; items without an id are not reported, nor do they contaminate; repeated documents, and
those without an id, are each reported and dropped; an empty documents or benchmark table gives
no hits; extra columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded, checked_broadcast, fresh, keep, materialize, salt_of, scratch

#: Fixed masks: 1 keeps the token at that place, 0 ignores it. All keep the first two tokens, which is what the
#: gate looks at. Together they keep a seed in every overlap of 12 to 20 tokens with a fifth of them substituted.
MASKS = ("1111011", "1110100011", "11000011011", "1110111")
MIN_OVERLAP = 20
MIN_MATCH = 0.8
LEAST_LOOSE = 12
LEAST_PASSAGE = 6
SHORTEST_SPAN = min(map(len, MASKS))
MAX_BROADCAST_SEEDS = 1_000_000
#: Tokens of the benchmark that are broadcast at most, at eight bytes each.
MAX_BROADCAST_TOKENS = 20_000_000
MAX_BROADCAST_IDS = 2_000_000
SALTS = 16
BLOCK = 256
GATE_BITS = 20
#: How far an overlap may begin before a seed in it.
REACH = MIN_OVERLAP - SHORTEST_SPAN
#: The tokens around position i, which decide what is found there, and how many of them stand before it.
AROUND = f"xxhash64(least(i, {REACH}), slice(t, greatest(1, i + 1 - {REACH}), least(i, {REACH}) + {MIN_OVERLAP}))"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _hashed(df: DataFrame, key: Column, text_col: str, out: str) -> DataFrame:
    """out (the key) and t, the 64-bit hashes of the tokens."""
    split = df.select(key.alias(out), tokens(F.col(f"`{text_col}`")).alias("w"))
    return split.select(out, F.expr("transform(w, x -> xxhash64(x))").alias("t"))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


#: The place in the gate of the two tokens from position i on.
PAIR = f"((t[i] ^ shiftrightunsigned(t[i + 1], 9)) & {(1 << GATE_BITS) - 1})"


def _shapes(lengths: list[int]) -> list[tuple[str, str]]:
    """(what must hold at position i, the seed there): the masks, and all tokens of short items of these lengths."""
    shapes = []
    for k, mask in enumerate(MASKS):
        kept = ", ".join(f"t[i + {j}]" for j, bit in enumerate(mask) if bit == "1")
        shapes.append((f"i + {len(mask)} <= size(t)", f"xxhash64({k}, {kept})"))
    for n in lengths:
        kept = ", ".join(f"t[i + {j}]" for j in range(n))
        whole = f"i + {n} <= size(t)" if n >= LEAST_PASSAGE else f"i = 0 and size(t) = {n}"
        shapes.append((whole, f"xxhash64({100 + n}, {kept})"))
    return shapes


def pair_gate(hashed: DataFrame) -> str:
    """Places of one text with the same tokens around them, as far as an overlap reaches, give the same overlaps:
the first of them stands for all, of an item before the join and of a document after it. So a text of one
repeated token or line is verified against an item of the same kind in a few alignments, not in as many as
there are pairs of places.

A bitmap of the token pairs at which the benchmark's seeds start, as longs in text: 2^GATE_BITS bits, whatever its size."""
    at = hashed.filter("size(t) > 1").select(F.explode(F.expr(f"transform(slice(t, 1, size(t) - 1), (x, i) -> {PAIR})")).alias("p"))
    rows = at.groupBy(F.expr("cast(shiftright(p, 6) as int)").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).collect()
    found = {r["k"]: r["v"] for r in rows}
    return ",".join(str(found.get(k, 0)) for k in range(1 << (GATE_BITS - 6)))


def _seeds(hashed: DataFrame, id_name: str, at: str, lengths: list[int], gate: str | None = None) -> DataFrame:
    """(id, at, around, seed) for each shape and each position that has it; around: what stands there, see AROUND.

    With a gate, positions whose first two tokens start no seed of the benchmark are passed over
    before their seeds are hashed; equal seeds have equal pairs, so none that could join is lost.
    """
    rows, test = hashed.filter("size(t) > 0"), "sequence(0, size(t) - 1)"
    if gate is not None:
        # one literal that the optimizer turns into an array, once
        rows = rows.withColumn("bits", F.split(F.lit(gate), ",").cast("array<bigint>"))
        test = f"filter({test}, i -> size(t) = 1 or (i + 1 < size(t) and getbit(bits[cast(shiftright({PAIR}, 6) as int)], cast({PAIR} & 63 as int)) = 1))"
    each = ", ".join(f"if({holds}, {seed}, null)" for holds, seed in _shapes(lengths))
    here = f"array(named_struct('at', i, 'around', {AROUND}, 'seeds', filter(array({each}), x -> x is not null)))"
    places = f"flatten(transform({test}, i -> filter({here}, x -> size(x.seeds) > 0)))"
    rows = rows.select(id_name, F.explode(F.expr(places)).alias("s"))
    return rows.select(id_name, F.col("s.at").alias(at), F.col("s.around").alias("around"), F.explode("s.seeds").alias("seed"))


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """doc_key (the text's hash), item_id, n_match, n_window and first_token of every overlap that counts."""
    items = _hashed(benchmark.filter(F.col(f"`{item_col}`").isNotNull()), F.col(f"`{item_col}`"), item_text, "item_id").filter("size(t) > 0")
    items = materialize(items.dropDuplicates(["item_id", "t"]).withColumn("item_key", F.xxhash64("t")), "items")
    texts = materialize(items.dropDuplicates(["item_key"]).select("item_key", "t"), "benchmark")
    lengths = sorted(r[0] for r in texts.filter(F.size("t") < LEAST_LOOSE).select(F.size("t")).distinct().collect())  # fewer than LEAST_LOOSE
    seeds = _seeds(texts, "item_key", "item_at", lengths).groupBy("item_key", "seed", "around").agg(F.min("item_at").alias("item_at"))
    seeds = materialize(seeds.drop("around"), "seeds")
    d = _hashed(docs, text_hash(text_col), text_col, "doc_key")
    found = _seeds(d, "doc_key", "doc_at", lengths, pair_gate(texts))
    if bounded(seeds, MAX_BROADCAST_SEEDS):
        hits = found.join(F.broadcast(seeds), "seed")
    else:
        # a seed of many documents is dealt over SALTS tasks; the benchmark's rows are repeated for each
        dealt = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", salt_of(F.col("doc_key"), SALTS)).join(dealt, ["seed", "salt"])
    # summed where the join is: the places of a repeated line meet an item's few different places, and one of each stays
    hits = materialize(hits.groupBy("doc_key", "item_key", "item_at", "around").agg(F.min("doc_at").alias("doc_at")).drop("around"), "hits")

    # only texts with a hit go on, in blocks of tokens that overlap by the reach of a window,
    # so that a hit carries a bounded piece of its text however long the text is
    reach = REACH
    (key,) = fresh(docs, "hit")
    with_hit = checked_broadcast(materialize(hits.select(F.col("doc_key").alias(key)).distinct(), "with_hit"), MAX_BROADCAST_IDS)
    again = _hashed(docs.join(with_hit, text_hash(text_col) == with_hit[key], "left_semi"), text_hash(text_col), text_col, "doc_key")
    pieces = again.filter("size(t) > 0").select(
        "doc_key",
        F.posexplode(F.expr(f"transform(sequence(0, (size(t) - 1) div {BLOCK}), k -> slice(t, greatest(1, k * {BLOCK} + 1 - {reach}), {BLOCK + MIN_OVERLAP} + least(k * {BLOCK}, {reach})))")).alias("block", "bt"),
    )
    pieces = pieces.groupBy("doc_key", "block").agg(F.first("bt").alias("bt"))  # copies are one text
    near = hits.withColumn("block", F.expr(f"cast(doc_at div {BLOCK} as int)")).join(pieces, ["doc_key", "block"])
    near = near.withColumn("d_left", F.least("doc_at", F.lit(reach))).withColumn("local", F.expr(f"doc_at - greatest(0, block * {BLOCK} - {reach})"))
    cut = near.select("doc_key", "item_key", "doc_at", "item_at", "d_left", F.expr(f"slice(bt, local + 1 - d_left, {MIN_OVERLAP} + d_left)").alias("dt"))
    n_tokens = texts.agg(F.sum(F.size("t"))).first()[0] or 0
    both = cut.join(F.broadcast(texts) if n_tokens <= MAX_BROADCAST_TOKENS else texts, "item_key").withColumnRenamed("t", "it")
    both = both.withColumn("left", F.least("d_left", "item_at")).withColumn("need", F.least(F.lit(MIN_OVERLAP), F.size("it")))
    both = both.withColumn("span", F.least(F.size("dt") - F.col("d_left") + F.col("left"), F.size("it") - F.col("item_at") + F.col("left"), F.lit(MIN_OVERLAP) + F.col("left")))
    both = both.withColumn("m", F.expr("transform(sequence(1, span), j -> int(dt[d_left - left + j - 1] = it[item_at - left + j - 1]))"))
    both = both.withColumn("agree", F.expr("if(span < need, array(), transform(sequence(1, span - need + 1), s -> aggregate(slice(m, s, need), 0, (a, x) -> a + x)))"))
    least = F.when(F.size("it") < LEAST_LOOSE, F.col("need")).otherwise(F.ceil(F.col("need") * MIN_MATCH))
    both = both.withColumn("least", least.cast("int")).withColumn("start", F.expr("array_position(transform(agree, x -> x >= least), true)"))
    best = both.filter("start > 0").select("doc_key", "item_key", F.array_max("agree").alias("best"), "need", (F.col("doc_at") - F.col("left") + F.col("start") - 1).alias("first"))
    best = best.groupBy("doc_key", "item_key").agg(F.max("best").alias("best"), F.min("need").alias("need"), F.min("first").alias("first"))
    named = best.join(checked_broadcast(items.select("item_key", "item_id"), MAX_BROADCAST_SEEDS), "item_key")
    return named.groupBy("doc_key", "item_id").agg(F.max("best").alias("n_match"), F.min("need").alias("n_window"), F.min("first").cast("int").alias("first_token"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs and item_id with an overlap that counts: doc_id, item_id, the most tokens of a window that agree, its length, and where the first such window starts."""
    with scratch(docs.sparkSession):
        found = keep(materialize(_found(docs, benchmark, text_col, item_col, item_text), "found"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(text_col).alias("doc_key"))
    return rows.join(checked_broadcast(found, MAX_BROADCAST_IDS), "doc_key").select("doc_id", "item_id", "n_match", "n_window", "first_token")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs without an overlap with the benchmark, with their columns."""
    (bad,) = fresh(docs, "bad")
    with scratch(docs.sparkSession):
        found = keep(materialize(_found(docs, benchmark, text_col, item_col, item_text).select(F.col("doc_key").alias(bad)).distinct(), "found"))
    found = checked_broadcast(found, MAX_BROADCAST_IDS)
    return docs.join(found, text_hash(text_col) == found[bad], "left_anti")
