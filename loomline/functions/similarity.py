"""Similarities of titles, vectors and times."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens by all distinct tokens; 0 if either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number.

    A bit of ``rises`` is 0 where a row's value rises; adding carries each match of
    the next token to the first rise above it. A step takes len(b) / 64 machine words.
    """
    where: dict[str, int] = {}
    for k, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << k
    every = (1 << len(b)) - 1
    rises = every
    for x in a:
        met = rises & where.get(x, 0)
        rises = (rises + met | rises - met) & every
    return len(b) - rises.bit_count()


@F.pandas_udf(T.DoubleType())
def token_order(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of tokens by the longer length; 0 if either has none."""
    return pd.Series([lcs_length(x, y) / max(len(x), len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)])


def time_distance_ms(a: Column, b: Column) -> Column:
    return F.abs(F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp")))


def dot(a: Column, b: Column) -> Column:
    """Inner product, added up from the left in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors. Empty ones, unequal lengths and zero vectors raise. Give norms that are at hand."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    return (
        F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.raise_error(F.lit("vectors must be of one length, not empty")).cast("double"))
        .when((na == 0) | (nb == 0), F.raise_error(F.lit("a zero vector has no direction")).cast("double"))
        .otherwise(dot(a, b) / (na * nb))
    )
