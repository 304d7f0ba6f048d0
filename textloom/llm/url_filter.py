"""Temporal URL filters: dated list entries as validity intervals, joined as of the fetch time.

A list is a log of dated entries (list_name, kind, key, action, listed_at): action `block` or
`allow` puts a key on the list, `remove` takes it off. Entries of a (list, kind, key) become
half-open intervals [listed_at, next listed_at). A capture is evaluated against the entries whose
interval holds its fetch time. Kinds: `host` (that host), `domain` (it and every host below) and
`prefix` (host and leading path segments; without any, all paths of that host). The most specific active entry decides (longest key),
and block before allow at equal length.

URLs and list keys take the same normal form before anything else: the host in lower case without
user, port, a trailing dot and one leading `www.`; the path as it stands, case included, without
empty segments, query and fragment. A key may be written with a scheme. URLs become candidate keys
by built-in expressions: the host, its parent domains, and the leading path segments, as many as
the longest prefix key of the list has. Captures meet the intervals on the key.
The list is broadcast if a count proves it small; otherwise captures keep a salt in the key and
the list's rows are repeated per salt, so a host with a third of all captures is dealt over SALTS
tasks.

Defined results: a null or unparsable URL and a null fetch time match nothing and are not blocked;
an entry without a kind, key or date is no entry; entries of one key and instant: block wins over
allow, allow over remove; repeated captures are each returned; empty captures give an empty table, an empty list blocks nothing; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded, salt_of

MAX_BROADCAST_ENTRIES = 500_000
SALTS = 16


def normal_host(host: Column) -> Column:
    """Lower case, without trailing dots and one leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(host), "\\.+$", ""), "^www\\.", "")


def host_of(url: Column) -> Column:
    return normal_host(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def segments_of(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def normal_key(kind: Column, key: Column) -> Column:
    """A list key in the form that candidate_keys() gives: a host, or a host and path segments."""
    plain = F.regexp_replace(F.trim(key), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = normal_host(F.regexp_extract(plain, "^(?:[^/@?#]*@)?([^/:?#]*)", 1))
    path = segments_of(F.regexp_extract(plain, "^[^/?#]*(/[^?#]*)", 1))
    return F.when(kind == "prefix", F.array_join(F.concat(F.array(host), path), "/")).otherwise(host)


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, kind, key (normal), action, valid_from, valid_to (null: open); removals only end intervals."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    normal = entries.select("list_name", "kind", normal_key(F.col("kind"), F.col("key")).alias("key"), "action", "listed_at")
    # one row per key and instant before the window, so that repeated entries cost no sort
    dated = normal.filter("key != '' and kind is not null and listed_at is not null").groupBy("list_name", "kind", "key", "listed_at").agg(F.max(rank).alias("r"))
    w = Window.partitionBy("list_name", "kind", "key").orderBy("listed_at")
    spans = dated.withColumn("valid_to", F.lead("listed_at").over(w)).filter("r > 0")
    return spans.select("list_name", "kind", "key", F.when(F.col("r") == 2, "block").otherwise("allow").alias("action"), F.col("listed_at").alias("valid_from"), "valid_to")


def candidate_keys(host: Column, path: Column, segments_at_most: int) -> Column:
    """array<struct<kind, key>> of the list keys that could name the URL; prefixes have at most so many segments."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n - i + 1), ".").alias("key")))
    segments = segments_of(path)
    m = F.least(F.size(segments), F.lit(segments_at_most))
    prefixes = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.concat(F.array(host), F.slice(segments, F.lit(1), i)), "/").alias("key")))
    none = F.expr("cast(array() as array<struct<kind:string,key:string>>)")
    return F.when(host != "", F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))), domains, prefixes)).otherwise(none)


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """page_id, url, fetched_at, blocked, matched list, kind and key, and since when."""
    spans = intervals(entries)
    rows = captures.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").alias("fetched_at"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    # a key for the capture row itself: explode and best match come back together by it
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    small = bounded(entries, MAX_BROADCAST_ENTRIES)
    salts = 1 if small else SALTS
    longest = entries.filter("kind = 'prefix'").agg(F.max(F.size(F.split(normal_key(F.col("kind"), F.col("key")), "/")) - 1)).first()[0] or 0
    cand = keyed.select("page_id", "url", "fetched_at", "row", salt_of(F.col("row"), salts).alias("salt"), F.explode_outer(candidate_keys(F.col("host"), F.coalesce(path_of(F.col("url")), F.lit("")), longest)).alias("c"))
    cand = cand.select("page_id", "url", "fetched_at", "row", "salt", F.col("c.kind").alias("ckind"), F.col("c.key").alias("ckey"))
    if small:
        dealt = F.broadcast(spans.withColumn("vsalt", F.lit(0)))
    else:
        dealt = spans.withColumn("vsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = (cand.ckind == dealt.kind) & (cand.ckey == dealt.key) & (cand.salt == dealt.vsalt) & (dealt.valid_from <= cand.fetched_at) & (dealt.valid_to.isNull() | (cand.fetched_at < dealt.valid_to))
    met = cand.join(dealt, active, "left")
    order = F.struct(F.length("key").alias("n"), F.when(F.col("action") == "block", 1).otherwise(0).alias("b"), "kind", "list_name", "key", "action", "valid_from")
    best = met.groupBy("row", "page_id", "url", "fetched_at").agg(F.max(F.when(F.col("key").isNotNull(), order)).alias("best"))
    return best.select(
        "page_id",
        "url",
        "fetched_at",
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.list_name").alias("list_name"),
        F.col("best.kind").alias("kind"),
        F.col("best.key").alias("key"),
        F.col("best.valid_from").alias("listed_at"),
    )
