"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression on the row itself, so the operator is one scan without a
shuffle, and the table of rules becomes a single boolean projection. No user functions.

Defined results: null or empty text has no words, all counts are 0 and it fails the word-count
rule; repeated rows are judged separately and alike; an empty table gives an empty table; columns
of other names are untouched whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import NON_WORD, fresh, words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 3

#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in that is for with was be it on as are by this from or an "
    "der die das und ist von mit den nicht ein eine zu im auf sich dem des auch "
    "le la les des et en un une est que qui dans pour pas sur par au du de "
    "el los las una y con por se del al no es lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while least <= measure <= most; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. Measures are the names of quality_measures().
RULES = (
    Rule("word_count_upper", "n_words", most=10_000_000),
    Rule("mean_word_length", "mean_word_length", least=2.0, most=20.0),
    Rule("symbol_word_ratio", "symbol_word_ratio", most=0.25),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("stop_word_ratio", "stop_word_ratio", least=0.02),
    Rule("duplicate_line_ratio", "dup_line_ratio", most=0.5),
    Rule("alphabetic_word_ratio", "alpha_ratio", least=0.6),
)


def _n_repeat_words(df: DataFrame, w: str, n: str, out: str) -> DataFrame:
    """Words inside a 3-word window that occurs at least twice in the text.

    Windows are compared by a 64-bit hash of their words; only texts with an equal pair go on to
    sort (hash, position). Each step is a column of its own so that no lambda recomputes it, and
    the last depends on the partition id: the optimizer then pushes no later filter below these
    steps, which would nest them inside each other's lambdas.
    """
    h, win, srt, pos = fresh(df, "wh", "win", "srt", "pos")
    df = df.withColumn(h, F.expr(f"transform(`{w}`, x -> xxhash64(x))"))
    df = df.withColumn(
        win,
        F.expr(f"if(`{n}` < {REPEAT_WINDOW}, array(), transform(slice(`{h}`, 1, greatest(`{n}` - 2, 0)), (x, i) -> xxhash64(x, `{h}`[i + 1], `{h}`[i + 2])))"),
    )
    df = df.withColumn(
        srt,
        F.expr(f"if(size(array_distinct(`{win}`)) = size(`{win}`), array(), sort_array(transform(`{win}`, (x, i) -> named_struct('h', x, 'p', i))))"),
    )
    df = df.withColumn(
        pos,
        F.expr(f"sort_array(transform(filter(transform(`{srt}`, (x, i) -> named_struct('p', x.p, 'd', coalesce(x.h = get(`{srt}`, i + 1).h, false) or coalesce(x.h = get(`{srt}`, i - 1).h, false))), x -> x.d), x -> x.p))"),
    )
    total = f"aggregate(transform(`{pos}`, (p, i) -> least({REPEAT_WINDOW}, coalesce(get(`{pos}`, i + 1) - p, {REPEAT_WINDOW}))), 0L, (a, x) -> a + x)"
    total = f"if(spark_partition_id() < 0, 0L, {total})"
    return df.withColumn(out, F.expr(total)).drop(h, win, srt, pos)


def quality_measures(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the measures as columns under fresh names, and the map from measure to column."""
    names = ["text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_alpha"]
    c = dict(zip(names, fresh(df, *names), strict=True))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = df.withColumn(c["words"], words(F.col(f"`{text_col}`")))
    df = df.withColumn(c["lines"], F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{NON_WORD[1:]}")))
    bytes_left = [F.octet_length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS]
    df = df.withColumns(
        {
            c["n_words"]: F.size(c["words"]).cast("long"),
            c["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
            c["n_symbols"]: (F.octet_length(text) * len(SYMBOLS) - sum(bytes_left[1:], bytes_left[0])).cast("long"),
            c["n_lines"]: F.size(c["lines"]).cast("long"),
            c["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
            c["n_stop_words"]: F.size(F.filter(c["words"], lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            c["n_alpha"]: F.size(F.filter(c["words"], lambda x: x.rlike("\\p{L}"))).cast("long"),
        }
    )
    df = _n_repeat_words(df, c["words"], c["n_words"], c["n_repeat_words"])
    return df, c


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def compile_rules(rules: tuple[Rule, ...], c: dict[str, str]) -> Column:
    """The rules as one boolean expression over the measures."""
    measures = {
        "n_words": F.col(c["n_words"]),
        "n_stop_words": F.col(c["n_stop_words"]),
        "mean_word_length": _ratio(c["word_chars"], c["n_words"]),
        "symbol_word_ratio": _ratio(c["n_symbols"], c["n_words"]),
        "stop_word_ratio": _ratio(c["n_stop_words"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_word_ratio": _ratio(c["n_repeat_words"], c["n_words"]),
        "alpha_ratio": _ratio(c["n_alpha"], c["n_words"]),
    }
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (measures[r.measure] >= r.least)
        if r.most is not None:
            ok = ok & (measures[r.measure] <= r.most)
    return ok


def base_failed(c: dict[str, str]) -> Column:
    return (F.col(c["n_words"]) < 50) | (100 * F.col(c["n_repeat_words"]) > 50 * F.col(c["n_words"]))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the base measures, base_failed and kept."""
    df, c = quality_measures(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    failed = base_failed(c)
    return df.select(
        "doc_id",
        *[F.col(c[x]).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & compile_rules(rules, c)).alias("kept"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns."""
    columns = docs.columns
    df, c = quality_measures(docs, text_col)
    (kept,) = fresh(df, "kept")
    df = df.withColumn(kept, ~base_failed(c) & compile_rules(rules, c))
    return df.filter(F.col(kept)).select(*[f"`{x}`" for x in columns])
