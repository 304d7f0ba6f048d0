"""A remote search index as a Spark data source: one input partition per time slice.

Options: url, user, password (else SEARCH_URL, SEARCH_USER, SEARCH_PASSWORD of the driver), start,
end, days, limit (page size), offset, limit_total, timeout, retries, query (a JSON object of the
filter) or keywords and expressions (JSON lists, turned into its clauses). Pages follow the sort
values of the last hit, with the id as tie-break, until a slice is exhausted, so no hit is lost or
doubled between pages whatever the index's result window is. Comparisons of `created` and lists of
`media` are pushed into the request by search_index() where the session allows it.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGE = 10_000
TIMEOUT = 60.0
RETRIES = 4
SORT = [{"created": "asc"}, {"uuid": "asc"}]
SCHEMA = "slice_start string, uuid string, created string, media string, source string, total long"
COMPARED = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


@dataclass
class Slice(InputPartition):
    start: str
    end: str


def slices(start: str, end: str, days: int) -> list[Slice]:
    """Half-open slices, inclusive of an empty last one when the step divides the range."""
    at, last, out = datetime.fromisoformat(start), datetime.fromisoformat(end), []
    while at <= last:
        out.append(Slice(at.isoformat(), min(at + timedelta(days=days), last).isoformat()))
        at += timedelta(days=days)
    return out


def keyword_clause(keyword: str) -> dict:
    """A term, or a prefix if it ends with an asterisk."""
    return {"prefix": {"text": keyword[:-1]}} if keyword.endswith("*") else {"match": {"text": keyword}}


def phrase_clause(phrase: str) -> dict:
    return {"match_phrase": {"text": phrase}}


def expression_clause(expression: str) -> dict:
    """Adjacent words in order, each a prefix."""
    words = [{"span_multi": {"match": {"prefix": {"text": {"value": w.removesuffix("*")}}}}} for w in expression.split()]
    return {"span_near": {"slop": 0, "in_order": True, "clauses": words}}


def any_of(clauses: list[dict]) -> dict:
    return {"bool": {"should": clauses, "minimum_should_match": 1}}


def query_of(keywords: list[str] = (), expressions: list[str] = ()) -> dict | None:
    """The filter of texts with any of the keywords or expressions."""
    clauses = [*map(keyword_clause, keywords), *(expression_clause(e) for e in expressions if e.split())]
    return any_of(clauses) if clauses else None


def request_body(options: dict, part: Slice, after: list | None = None, filters: list[dict] = ()) -> dict:
    wanted = [{"range": {"created": {"gte": part.start, "lt": part.end}}}, *filters]
    if options.get("query"):
        wanted.append(json.loads(options["query"]))
    named = query_of(json.loads(options.get("keywords") or "[]"), json.loads(options.get("expressions") or "[]"))
    if named:
        wanted.append(named)
    body = {"size": int(options.get("limit", PAGE)), "sort": SORT, "track_total_hits": True, "query": {"bool": {"filter": wanted}}}
    if after is not None:
        return body | {"search_after": after}
    return body | {"from": int(options.get("offset", 0))}


def post(url: str, body: dict, user: str = "", password: str = "", timeout: float = TIMEOUT, retries: int = RETRIES) -> dict:
    """The answer as JSON; busy and unreachable servers are tried again after growing pauses, other errors are raised."""
    headers = {"Content-Type": "application/json"}
    if user:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
    for turn in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as r:
                return json.load(r)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            status = getattr(e, "code", None)
            if turn == retries or (status is not None and status < 500 and status != 429):
                raise
            time.sleep(min(30.0, 0.5 * 2**turn))
    raise AssertionError


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {"url": os.environ.get("SEARCH_URL", "http://localhost:9200"), "user": os.environ.get("SEARCH_USER", ""), "password": os.environ.get("SEARCH_PASSWORD", ""), **options}
        self.filters: list[dict] = []

    def partitions(self):
        return slices(self.options["start"], self.options["end"], int(self.options.get("days", 10)))

    def read(self, partition):
        o, after, sent = self.options, None, 0
        most = int(o["limit_total"]) if "limit_total" in o else None
        while True:
            body = request_body(o, partition, after, self.filters)
            hits = post(o["url"], body, o["user"], o["password"], float(o.get("timeout", TIMEOUT)), int(o.get("retries", RETRIES))).get("hits", {})
            page = hits.get("hits", [])
            for h in page:
                if most is not None and sent >= most:
                    return
                found = h["_source"]
                media = found.get("media") or {}
                yield (partition.start, found.get("uuid"), found.get("created"), media.get("uuid"), json.dumps(found, ensure_ascii=False), hits.get("total", {}).get("value", 0))
                sent += 1
            if len(page) < body["size"]:
                return
            after = page[-1].get("sort") or [page[-1]["_source"].get("created"), page[-1]["_source"].get("uuid")]


class PushingReader(SearchReader):
    """A reader that takes filters; a session must allow that (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters: list[Filter]):
        """Take comparisons of created and values of media; hand back the rest."""
        for f in filters:
            if type(f) in COMPARED and f.attribute == ("created",):
                self.filters.append({"range": {"created": {COMPARED[type(f)]: f.value}}})
            elif isinstance(f, EqualTo) and f.attribute == ("media",):
                self.filters.append({"terms": {"media.uuid": [f.value]}})
            elif isinstance(f, In) and f.attribute == ("media",):
                self.filters.append({"terms": {"media.uuid": list(f.value)}})
            else:
                yield f


class SearchStreamReader(DataSourceStreamReader):
    """The index as a stream: an offset is the end of the slices read so far, so a batch can be asked for again as it was.

    A batch takes the slices that have ended since the last one, up to `end` or to the present. Slices count from
    `start`; the rest of a slice is left for later. Documents that come into a slice after it was read are seen
    only with lookback=N, which reads the N slices before again; dedup by uuid removes what was there already.
    """

    def __init__(self, options: dict):
        self.batch = SearchReader(options)
        self.start, self.days = datetime.fromisoformat(options["start"]), int(options.get("days", 10))

    def _offset(self, n: int) -> dict:
        return {"until": (self.start + timedelta(days=self.days * n)).isoformat()}

    def initialOffset(self) -> dict:
        return self._offset(0)

    def latestOffset(self) -> dict:
        end = self.batch.options.get("end")
        last = datetime.fromisoformat(end) if end else datetime.now()
        return self._offset(max(0, (last - self.start) // timedelta(days=self.days)))

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        step = timedelta(days=self.days)
        at, last, out = datetime.fromisoformat(start["until"]), datetime.fromisoformat(end["until"]), []
        if at < last:
            at = max(self.start, at - step * int(self.batch.options.get("lookback", 0)))
        while at < last:
            out.append(Slice(at.isoformat(), (at + step).isoformat()))
            at += step
        return out

    def read(self, partition):
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: an index keeps what was read."""


class SearchSource(DataSource):
    """spark.dataSource.register(SearchSource); spark.read.format("search_index")"""

    @classmethod
    def name(cls) -> str:
        return "search_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SearchReader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SearchStreamReader(dict(self.options))


def search_stream(spark: SparkSession, **options: str) -> DataFrame:
    """The slices of the index as a stream."""
    spark.dataSource.register(SearchSource)
    return spark.readStream.format("search_index").options(**options).load()


def search_index(spark: SparkSession, **options: str) -> DataFrame:
    """The index as a DataFrame, with filters pushed into its requests if the session allows it."""
    spark.dataSource.register(SearchSource)
    allowed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("search_index").options(pushdown=allowed, **options).load()
