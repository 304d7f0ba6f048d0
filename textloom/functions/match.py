"""Keyword and expression matching compiled to JVM regular expressions at plan time.

A word is lower-case, mixed or upper; `\\b` and `\\w` are Unicode. A trailing `*` is a prefix.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let


#: Beyond so many patterns a text is first searched for any of them at once.
FEW_PATTERNS = 16


def _quoted(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_pattern(word: str) -> str:
    return f"\\b{_quoted(word[:-1])}\\w*\\b" if word.endswith("*") else f"\\b{_quoted(word)}\\b"


def keyword_regex(keyword: str, case_mode: str = "reference") -> str:
    """reference: always case-insensitive; documented: only keywords without upper-case letters are."""
    insensitive = case_mode == "reference" or keyword.islower()
    return ("(?iU)" if insensitive else "(?U)") + word_pattern(keyword)


def phrase_regex(keyword: str) -> str:
    """A whole keyword or phrase: all-lower ignores case, anything else does not."""
    return ("(?iU)" if keyword.islower() else "(?U)") + f"\\b{_quoted(keyword)}\\b"


def expression_regex(expression: str) -> str:
    """Words in order with white space between; ignores case if every word is lower-case."""
    words = expression.split()
    return ("(?iU)" if all(w.islower() for w in words) else "(?U)") + "\\s+".join(map(word_pattern, words))


def _any_of(patterns: list[str], flags: str) -> str:
    return flags + "(?:" + "|".join(patterns) + ")"


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a keyword occurs; one alternation per case class instead of one scan per keyword."""
    lower = [f"\\b{_quoted(k)}\\b" for k in keywords if k.islower()]
    other = [f"\\b{_quoted(k)}\\b" for k in keywords if not k.islower()]
    tests = [text.rlike(_any_of(p, f)) for p, f in ((lower, "(?iU)"), (other, "(?U)")) if p]
    return reduce(or_, tests, F.lit(False)) if tests else F.lit(False)


def coarse_any(text: Column, keywords: list[str]) -> Column:
    """A cheap superset of a match: some keyword's stem occurs, in any case. Put before the exact test."""
    stems = {(w[:-1] if w.endswith("*") else w).lower() for k in keywords for w in k.split()[:1]}
    return let(F.lower(text), lambda low: reduce(or_, [low.contains(s) for s in sorted(stems)])) if stems else F.lit(False)


def _matches(text: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """array<struct<category, match>> of (category, match, pattern) found in text.

    Few patterns are each searched for. With many, texts without any are told first by one alternation per set
    of flags.
    """
    none = F.expr("cast(array() as array<struct<category:string,match:string>>)")
    if not patterns:
        return none
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(m).alias("match"))) for c, m, p in patterns]))
    if len(patterns) <= FEW_PATTERNS:
        return found
    by_flags: dict[str, list[str]] = {}
    for _, _, p in patterns:
        flags, _, rest = p.partition(")")
        by_flags.setdefault(flags + ")", []).append(rest)
    return F.when(reduce(or_, [text.rlike(_any_of(ps, flags)) for flags, ps in by_flags.items()]), found).otherwise(none)


def keyword_matches(text: Column, categories: dict[str, list[str]], case_mode: str = "reference") -> Column:
    """array<struct<category, match>> in the order of the table; match is the keyword without `*`."""
    return _matches(text, [(c, k.removesuffix("*"), keyword_regex(k, case_mode)) for c, ks in categories.items() for k in ks])


def expression_matches(text: Column, categories: dict[str, list[str]]) -> Column:
    """array<struct<category, match>>; match is the expression as written."""
    return _matches(text, [(c, e, expression_regex(e)) for c, es in categories.items() for e in es])


def matched_categories(text: Column, categories: dict[str, list[str]]) -> Column:
    """array<string> of the categories with any keyword in text."""
    return F.array_compact(F.array(*[F.when(contains_any(text, ks), F.lit(c)) for c, ks in categories.items()]))


def coarse_prefix_phrase(expression: str) -> str:
    """Index-side superset of an expression: every word a prefix, adjacent and in order."""
    return "(?iU)" + "\\s+".join(f"\\b{_quoted(w.removesuffix('*'))}\\w*\\b" for w in expression.split())
