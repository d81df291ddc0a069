"""Counters and histograms of pipeline runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.vocabulary import DURATION_BUCKETS


def counters(rows: DataFrame, by: str, conditions: Mapping[str, Column]) -> DataFrame:
    """A count of each condition, in one pass."""
    return rows.groupBy(by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def histogram(rows: DataFrame, by: str, seconds: str, buckets: Sequence[float] = DURATION_BUCKETS) -> DataFrame:
    """(by, le, count, total, sum): cumulative counts of values up to each bound, and all at +Inf."""
    bounds = [(f"{b:g}", F.count_if(F.col(seconds) <= b)) for b in buckets] + [("+Inf", F.count(seconds))]
    wide = rows.groupBy(by).agg(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in bounds]), F.array(*[c for _, c in bounds])).alias("m"), F.count(seconds).alias("total"), F.sum(seconds).alias("sum"))
    return wide.select(by, F.explode("m").alias("le", "count"), "total", "sum")
