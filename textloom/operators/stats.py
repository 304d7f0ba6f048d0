"""Label statistics of sentence tables (lang, [split,] tokens, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.scratch import stored
from textloom.sinks.writers import rolling_shard


#: A label is a column of the pivoted statistics; beyond so many, read `label_counts` instead.
MAX_TAGS = 2_000


def tags(sentences: DataFrame) -> list[str]:
    """Distinct labels but O, sorted, to name the pivot's columns; more than MAX_TAGS are an error, not a cut."""
    rows = sentences.select(F.explode(F.array_distinct("labels")).alias("l")).filter("l <> 'O'").distinct().orderBy("l").limit(MAX_TAGS + 1).collect()
    if len(rows) > MAX_TAGS:
        raise ValueError(f"there are more than {MAX_TAGS} labels: use label_counts()")
    return [r["l"] for r in rows]


def label_counts(sentences: DataFrame, by: list[str]) -> DataFrame:
    return sentences.select(*by, F.explode("labels").alias("label")).filter("label <> 'O'").groupBy(*by, "label").agg(F.count("*").alias("n"))


def label_stats(sentences: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """by, sentences, tokens and a zero-filled column per tag.

    Without columns the tags are those there are: one pass counts them per group, beside a mark per sentence that
    carries its tokens, and the small table of these counts is stored and pivoted.
    """
    if columns is None:
        marked = sentences.select(*by, F.size("tokens").alias("_t"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter("labels", lambda x: x != "O"))).alias("_l"))
        counted = stored(marked.groupBy(*by, "_l").agg(F.count("*").alias("_n"), F.sum("_t").alias("_t")))
        found = [r[0] for r in counted.select("_l").filter("_l is not null").distinct().orderBy("_l").collect()]  # the columns of the result
        one = lambda c, t: F.coalesce(F.sum(F.when(F.col("_l").isNull() if t is None else F.col("_l") == t, F.col(c))), F.lit(0))
        return counted.groupBy(*by).agg(one("_n", None).alias("sentences"), one("_t", None).alias("tokens"), *[one("_n", t).alias(t) for t in found])
    count = lambda t: F.coalesce(F.sum(F.size(F.filter("labels", lambda x: x == t))), F.lit(0)).alias(t)
    return sentences.groupBy(*by).agg(F.count("*").alias("sentences"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"), *[count(t) for t in columns])


def two_level_stats(sentences: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(lang) and (lang, split) totals in one pass of grouping sets."""
    columns = tags(sentences) if columns is None else columns
    pre = label_stats(sentences, ["lang", "split"], columns)
    g = pre.groupingSets([["lang"], ["lang", "split"]], "lang", "split")
    return g.agg(*[F.sum(c).alias(c) for c in ("sentences", "tokens", *columns)], F.grouping_id().alias("level"))


def counters(files: DataFrame, by: list[str], file: str = "file") -> DataFrame:
    """Files and rows per group, and in all (group columns null): what a run reports."""
    return files.rollup(*by).agg(F.countDistinct(file).alias("files"), F.count("*").alias("rows"), F.grouping_id().alias("level")).filter(f"level in (0, {(1 << len(by)) - 1})").drop("level")


def report_lines(stats: DataFrame, order: list[str]) -> DataFrame:
    """ord, line: the lines of text_table() as rows, the first with the names, made where the rows are."""
    texts = stats.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(stats.columns)], F.struct(*order).alias("o"))
    n = len(stats.columns)
    widths = texts.agg(*[F.greatest(F.coalesce(F.max(F.length(f"c{i}")), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, c in enumerate(stats.columns)])
    numbered = rolling_shard(texts, ["o"], 1).withColumn("ord", F.col("shard") + 1)
    names = stats.sparkSession.range(1).select(F.lit(0).alias("ord"), *[F.lit(c).alias(f"c{i}") for i, c in enumerate(stats.columns)])
    rows = numbered.select("ord", *[f"c{i}" for i in range(n)]).unionByName(names).crossJoin(F.broadcast(widths))  # one row of widths
    padded = [F.rpad(f"c{i}", F.col(f"w{i}"), F.lit(" ")) if i == 0 else F.lpad(f"c{i}", F.col(f"w{i}"), F.lit(" ")) for i in range(n)]
    return rows.select("ord", F.concat_ws("  ", *padded).alias("line"))


def text_table(stats: DataFrame) -> list[str]:
    """Aligned lines of a stats table (a bounded report)."""
    rows = [stats.columns, *[["" if v is None else str(v) for v in r] for r in stats.collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return ["  ".join(v.ljust(w) if i == 0 else v.rjust(w) for i, (v, w) in enumerate(zip(r, width, strict=True))) for r in rows]
