"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree domain - language - source whose leaves hold token counts. A token budget is
propagated from the root by the children's weights; a leaf can give at most max_epochs times its
tokens. What a child cannot give goes to its siblings, by weight, and only what the whole subtree
cannot give goes to the siblings of its parent. Each leaf then takes whole epochs and, of one
more epoch in an order of its own, the prefix of documents up to its budget of tokens; the last
document is taken if its first token is within the budget.

One pass over the texts writes a narrow table of ids and token counts, on which everything is
decided; a second one yields the documents. The tree is solved level by level with window functions
over siblings, however many leaves there are.

An epoch's order is that of a seeded 64-bit hash of the id. The prefix needs no global sort: the
hash range of a leaf is cut into 2^LEVEL_BITS equal parts, whose sums (pre-aggregated before the
shuffle) locate the part with the cut; that one is cut up again, and of the last part, one of
2^(LEVEL_BITS * CUT_LEVELS), the documents are ordered. So no task orders more than that of a leaf, or sees
more than 2^LEVEL_BITS sums of it, and a leaf may have a third of all rows.

Defined results: null domain, language or source is a leaf of its own; null text has no tokens;
documents without tokens are never taken; rows without an id are ordered by the hash of their text;
rows that tie in the order are ordered by their text's hash, and rows equal in id and text are taken
together; weights missing from the table are the mean of their siblings', or equal; an empty
table gives an empty table; extra columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded, checked_broadcast, fresh, keep, materialize, scratch, words

MAX_EPOCHS = 4
LEVEL_BITS, CUT_LEVELS = 8, 3
#: Rows of the plan (one per leaf) and of the last parts that are broadcast at most; beyond them the joins shuffle.
MAX_BROADCAST = 1_000_000
SEED = 2611
PATH = ["_d", "_l", "_s"]


@dataclass(frozen=True)
class Mixture:
    """Weights by path, e.g. {("web",): 2, ("web", "en"): 3}; a share of the available tokens as budget."""

    weights: dict
    share: float = 1.0
    max_epochs: int = MAX_EPOCHS
    seed: int = SEED


#: Production mixture: domains and languages evened out, sources alike.
PRODUCTION = Mixture({("curated",): 1.0, ("web",): 3.0, ("forum",): 1.0, ("web", "en"): 2.0, ("curated", "en"): 2.0, ("forum", "en"): 2.0}, share=0.9)


def domain_of(source: Column) -> Column:
    """The domain of a source: its number in threes of five, as a stated rule."""
    n = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % 5
    return F.when(n <= 2, "web").when(n == 3, "curated").when(n == 4, "forum")


def _with(a: DataFrame, b: DataFrame, depth: int = len(PATH), how: str = "inner", broadcast: bool = False) -> DataFrame:
    """a with the columns of b, a table of one row per path; nulls are paths of their own."""
    other = [f"{c}_of" for c in PATH[:depth]]
    b = b.withColumnsRenamed(dict(zip(PATH[:depth], other, strict=True)))
    same = F.lit(True)
    for c, o in zip(PATH[:depth], other, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    return a.join(F.broadcast(b) if broadcast else b, same, how).drop(*other)


def _small(df: DataFrame) -> bool:
    return bounded(df, MAX_BROADCAST)


def waterfill(children: DataFrame, depth: int) -> DataFrame:
    """children (path, cap, weight, parent's budget) with budget: shares by weight, none above its cap, shortages to siblings."""
    siblings = Window.partitionBy(*PATH[: depth - 1]) if depth > 1 else Window.partitionBy(F.lit(0))
    weight = F.when(F.col("cap") > 0, F.col("weight")).otherwise(0.0)
    rows = children.withColumn("weight", weight).withColumn("open", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
    rows = rows.withColumn("left", F.least("parent", F.sum("open").over(siblings)))
    rows = rows.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    # siblings in the order in which a rising level fills them; the level of the first that it does not fill holds for the rest
    order = siblings.orderBy(F.col("ratio").asc_nulls_last(), *PATH[:depth])
    filled = F.coalesce(F.sum("open").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.when(F.col("weight") > 0, (F.col("left") - filled) / ahead))
    rows = rows.withColumn("full", F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False)))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(siblings)
    budget = F.when(F.col("full"), F.col("cap")).when(F.col("weight") > 0, F.greatest(level * F.col("weight"), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("budget", budget).select(*PATH[:depth], "budget")


def _weights(spark: SparkSession, mixture: Mixture, depth: int) -> DataFrame:
    rows = [(*path, float(w)) for path, w in mixture.weights.items() if len(path) == depth]
    return spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in PATH[:depth]), "weight double"]))


def solve(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """Tokens to take (take) from each leaf (path) that has n tokens."""
    spark = leaves.sparkSession
    caps = leaves.withColumn("cap", F.col("n").cast("double") * mixture.max_epochs)
    budgets = leaves.agg((F.sum("n") * F.lit(float(mixture.share))).alias("budget"))
    budgets = budgets.select(F.least("budget", F.lit(mixture.max_epochs / mixture.share if mixture.share else 0.0) * F.col("budget")).alias("budget"))
    for depth in range(1, len(PATH) + 1):
        nodes = caps.groupBy(*PATH[:depth]).agg(F.sum("cap").alias("cap"))
        nodes = _with(nodes, _weights(spark, mixture, depth), depth, "left", True)  # the mixture's own table
        siblings = Window.partitionBy(*PATH[: depth - 1]) if depth > 1 else Window.partitionBy(F.lit(0))
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.avg("weight").over(siblings), F.lit(1.0)))
        parents = budgets.withColumnRenamed("budget", "parent")
        nodes = _with(nodes, parents, depth - 1) if depth > 1 else nodes.join(F.broadcast(parents))  # one row
        budgets = waterfill(nodes, depth)
    return budgets.select(*PATH, F.floor(F.col("budget") + 1e-6).cast("long").alias("take"))


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the last epoch of each leaf ends.

    rows: path, rest (tokens to take), h, key, tie, tok. Returns (path, cut): the last part, by the first bits
    of h, and the rows (path, h, key, tie) of these parts that are taken.
    """
    now = rows.filter("rest > 0")
    for level in range(1, CUT_LEVELS + 1):
        now = now.withColumn("part", F.shiftright("h", 64 - LEVEL_BITS * level))
        sums = now.groupBy(*PATH, "part", "rest").agg(F.sum("tok").alias("n"))
        before = Window.partitionBy(*PATH).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        cuts = ahead.filter("before < rest and before + n >= rest").select(*PATH, F.col("part").alias("cut"), (F.col("rest") - F.col("before")).alias("rest"))
        cuts = materialize(cuts, "cuts")
        now = _with(now.drop("rest"), cuts, broadcast=_small(cuts)).filter(F.col("part") == F.col("cut")).drop("part", "cut")
        now = materialize(now, "part")
    # rows equal in id and text have one place
    places = now.groupBy(*PATH, "rest", "h", "key", "tie").agg(F.sum("tok").alias("tok"))
    before = Window.partitionBy(*PATH).orderBy("h", "key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = places.withColumn("before", F.coalesce(F.sum("tok").over(before), F.lit(0))).filter("before < rest")
    return cuts, materialize(taken.select(*PATH, "h", "key", "tie"), "taken")


def mixed(docs: DataFrame, mixture: Mixture = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None, epoch_col: str | None = None) -> DataFrame:
    """The documents of the mixture, once for each epoch that takes them."""
    text = F.col(f"`{text_col}`")
    domain = domain_of(F.col("source")) if domain is None else domain
    tie = F.xxhash64(F.coalesce(text, F.lit("")))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), tie)
    path = [domain, F.col("lang"), F.col("source")]
    def order(full: Column, k: Column) -> Column:
        return F.xxhash64(F.lit(mixture.seed), full, k)

    with scratch(docs.sparkSession):
        narrow = docs.select(*[p.alias(c) for p, c in zip(path, PATH, strict=True)], key.alias("key"), tie.alias("tie"), F.size(words(text)).cast("long").alias("tok"))
        narrow = materialize(narrow.filter("tok > 0"), "sizes")
        leaves = materialize(narrow.groupBy(*PATH).agg(F.sum("tok").alias("n")), "leaves")
        plan = _with(leaves, solve(leaves, mixture)).select(*PATH, F.expr("take div n").alias("full"), F.expr("take % n").alias("rest"))
        plan = keep(materialize(plan, "plan"))
        cuts, taken = map(keep, _cut(_with(narrow, plan, broadcast=_small(plan)).withColumn("h", order(F.col("full"), F.col("key"))).drop("full")))

    # the documents: those before the cut, those of the cut's part that are taken, and whole epochs
    names = dict(zip([*PATH, "key", "tie", "h"], fresh(docs, "domain", "lang", "source", "key", "tie", "hash"), strict=True))
    (end, full, epoch, place) = fresh(docs, "cut", "full", "epoch", "place")
    decided = _with(plan, cuts.select(*PATH, "cut"), how="left").select(*[F.col(c).alias(names[c]) for c in PATH], F.col("full").alias(full), F.col("cut").alias(end))
    decided = checked_broadcast(decided, MAX_BROADCAST)
    rows = docs.filter(text.rlike("[^\\x20\\x09-\\x0D]")).withColumns({**{names[c]: p for p, c in zip(path, PATH, strict=True)}, names["key"]: key, names["tie"]: tie})
    same_leaf = F.lit(True)
    for c in PATH:
        same_leaf = same_leaf & rows[names[c]].eqNullSafe(decided[names[c]])
    rows = rows.join(decided, same_leaf).drop(*[decided[names[c]] for c in PATH])
    rows = rows.withColumn(names["h"], order(F.col(full), F.col(names["key"])))
    at = F.shiftright(F.col(names["h"]), 64 - LEVEL_BITS * CUT_LEVELS)
    last = taken.select(*[F.col(c).alias(f"{names[c]}2") for c in names], F.lit(True).alias(place))
    last = checked_broadcast(last, MAX_BROADCAST)
    same_place = F.lit(True)
    for c in ("h", "key", "tie", *PATH):
        same_place = same_place & rows[names[c]].eqNullSafe(last[f"{names[c]}2"])
    rows = rows.join(last, same_place, "left")
    more = (F.col(end).isNotNull() & (at < F.col(end))) | F.col(place).isNotNull()
    epochs = F.col(full) + more.cast("long")
    out = [*[F.col(f"`{c}`") for c in docs.columns], *([F.col(epoch).alias(epoch_col)] if epoch_col else [])]
    return rows.filter(epochs > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1))).select(*out)
