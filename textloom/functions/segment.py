"""Sentences and words of raw text by a table of rules, as JVM expressions.

A sentence can end after one of . ! ? … and up to three closing quotes or brackets before white space, and always
ends at a line end. It does not end where

1. the mark is a single dot after an abbreviation of the list, in any case;
2. the mark is a single dot after a single letter (an initial);
3. the mark is a single dot after a number, and what follows begins with a digit or a lower-case letter (ordinals, dates);
4. what follows begins with a lower-case letter, after any opening quotes or brackets;
5. a bracket or a paired quotation mark of the same line is still open (“ closes in a line with „, else it opens).

Rules 1 to 4 look at the two sides of a place, rule 5 at the sum of openings and closings before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import let, once, strip

#: Abbreviations before which and after which a sentence goes on; callers may give lists of their own.
ABBREVIATIONS = {
    "en": ("dr", "mr", "mrs", "ms", "prof", "st", "vs", "no", "e.g", "i.e", "cf", "fig", "vol"),
    "de": ("dr", "hr", "fr", "prof", "nr", "str", "z.b", "bzw", "ca", "vgl", "usw"),
    "fr": ("m", "mme", "mlle", "dr", "prof", "p.ex", "cf", "env", "vol"),
    "sl": ("dr", "g", "ga", "gdč", "prof", "mag", "npr", "oz", "str", "št", "t.i", "sv"),
}

_OPEN, _CLOSE = "(\\[{„«", ")\\]}»”"
#: A place where a sentence may end.
PLACE = "([.!?…][)\\]}\"'»”’]{0,3}\\s+)"
_LOWER_NEXT = "^[(\\[{„«“\"'‘]*\\p{Ll}"


def _dotted(words: str) -> str:
    """The end of a part: a single dot after one of words, and closing marks."""
    return f"(?U)(^|[^\\w.])({words})\\.[)\\]}}\"'»”’]{{0,3}}\\s*$"


def _length_without(c: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(c, f"[{chars}]", ""))


def sentences(text: Column, abbreviations: tuple[str, ...] | None = None) -> Column:
    """array<string>: the sentences of text, without white space at the ends; none of a null or blank text."""
    words = sorted({a for known in ABBREVIATIONS.values() for a in known} if abbreviations is None else set(abbreviations))
    quoted = "|".join("\\Q" + w.lower() + "\\E" for w in words)

    def of_line(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, "(?U)" + PLACE, "$1\x00"), "\x00")
        return let(parts, lambda p: joined(p, F.when(F.contains(line, F.lit("„")), "”").otherwise("«")))

    def joined(parts: Column, low: Column) -> Column:
        balance = F.transform(parts, lambda p: let(F.replace(p, F.lit("“"), low), lambda x: _length_without(x, _CLOSE) - _length_without(x, _OPEN)))
        # running sums, as an array of one more than the parts
        sums = F.aggregate(balance, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(sums, lambda s: F.split(F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(ends(p, F.get(parts, i + 1), F.get(s, i + 1)), "\x00").otherwise(""))), ""), "\x00"))

    def ends(part: Column, after: Column, depth: Column) -> Column:
        goes_on = F.lower(part).rlike(_dotted(quoted)) if words else F.lit(False)
        goes_on = goes_on | part.rlike(_dotted("\\p{L}")) | (part.rlike(_dotted("[0-9]+")) & after.rlike("^[0-9\\p{Ll}]"))
        return ~(goes_on | after.rlike(_LOWER_NEXT) | (depth > 0))

    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    found = F.transform(F.flatten(F.transform(lines, of_line)), strip)
    return F.coalesce(F.filter(once(found), lambda s: s != ""), F.expr("cast(array() as array<string>)"))


def words(sentence: Column) -> Column:
    """Numbers with inner points, words with inner hyphens, apostrophes, dots and at-signs, runs of dots, other signs one by one."""
    return F.regexp_extract_all(sentence, F.lit("(?U)\\d+(?:[.,:]\\d+)+|[\\w@]+(?:[-'’.@][\\w@]+)*|\\.{2,}|[^\\w\\s]"), F.lit(0))
