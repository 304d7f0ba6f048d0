"""Counters of a run, taken while its sink writes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def sentence_counters(labels: str = "labels", ord_: str = "ord") -> dict[str, Column]:
    """rows, files (by the first sentence of each), tokens and labelled tokens of sentence rows."""
    return {"rows": F.count(F.lit(1)), "files": F.count_if(F.col(ord_) == 0), "tokens": F.coalesce(F.sum(F.size(labels)), F.lit(0)), "labelled": F.coalesce(F.sum(F.size(F.filter(labels, lambda x: x != "O"))), F.lit(0))}


def observed(df: DataFrame, counters: dict[str, Column], sink: Callable[[DataFrame], None]) -> dict[str, Any]:
    """Run sink over df and give the counters of the rows it took, from the same job: aggregates without distinct.

    The sink reads the frame once; a sink that reads it again counts its first reading.
    """
    seen = Observation()
    sink(df.observe(seen, *[c.alias(n) for n, c in counters.items()]))
    return seen.get
