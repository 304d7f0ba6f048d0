"""Text expressions with Unicode semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first line of a broadcast transcript (station, date, programme, time).
BROADCAST_HEADER = r"(?U)^[\p{Nd}\p{Lu}\s]+(?:[,\s]+)?(?:\s*(\d{1,2}\.\s*\d{1,2}\.\s*\d{4})(?:[,\s]+)?(?:\s*\p{Lu}{2,}[\p{Nd}\p{Lu}\s]+(?:[,\s]+)?(?:\s*\d{1,2}[:.]\d{2})?)?)?\s*$"

#: Every line end that Python's splitlines() knows.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"

#: What (?U)\\s stands for. Trimming by it costs a fraction of a regular expression, which is felt for every line and label.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(c: Column) -> Column:
    """c, in a form that the optimizer does not copy into the lambdas that use it, where it would be computed for every element."""
    return F.when(F.spark_partition_id() < 0, F.lit(None)).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.trim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """Nothing but Unicode white space; looks no further than the first other character."""
    return F.ltrim(c, F.lit(WHITE)) == ""


def split_space(c: Column) -> Column:
    """Tokens between runs of Unicode white space."""
    return F.array_remove(F.split(c, "(?U)\\s+"), "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def join_title(title: Column, body: Column) -> Column:
    """title, an empty line and body; body alone if it starts with title."""
    return F.when(F.startswith(body, title), body).otherwise(F.concat(title, F.lit("\n\n"), body))


def without_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), strip(F.substring(text, F.length(prefix) + 1, F.length(text)))).otherwise(text)


def without_broadcast_header(media_type: Column, body: Column) -> Column:
    ls = F.split(body, "\n")
    header = media_type.isin("tv", "radio") & (F.size(ls) > 1) & ls[0].rlike(BROADCAST_HEADER)
    return F.when(header, F.array_join(F.slice(ls, F.lit(2), F.size(ls)), "\n")).otherwise(body)


def url_file_name(url: Column) -> Column:
    """Last path segment, without query and trailing slash."""
    return F.substring_index(F.regexp_replace(F.substring_index(url, "?", 1), "/+$", ""), "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*$", "")


def shard_name(dataset: str, number: Column) -> Column:
    return F.concat(F.lit(dataset + "-"), F.format_string("%02d", number))
