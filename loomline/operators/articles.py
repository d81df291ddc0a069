"""The article table: keyed upserts where the last writer wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(incoming: DataFrame, current: DataFrame | None = None, *, key: str = "canonical_url", seen_col: str = "discovered_at", seq_col: str = "seq", payload: Sequence[str] = ()) -> DataFrame:
    """One row per key: first_discovered_at, last_seen_at and the payload of the row seen last.

    Ties go to the later arrival, nulls overwrite. first_seq is that of the first
    arrival. ``current`` is a table this function gave; its rows come before all
    incoming ones.
    """
    cols = list(payload)
    new = incoming.select(key, F.col(seen_col).alias("low"), F.col(seen_col).alias("high"), F.lit(1).alias("_age"), F.col(seq_col).alias("_seq"), F.col(seq_col).alias("_first"), F.struct(*cols).alias("p"))
    if current is not None:
        old = current.select(key, F.col("first_discovered_at").alias("low"), F.col("last_seen_at").alias("high"), F.lit(0).alias("_age"), F.col("last_seq").alias("_seq"), F.col("first_seq").alias("_first"), F.struct(*cols).alias("p"))
        new = old.unionByName(new)
    merged = new.groupBy(key).agg(F.min("low").alias("first_discovered_at"), F.max("high").alias("last_seen_at"), F.max_by("p", F.struct("high", "_age", "_seq")).alias("p"), F.max_by("_seq", F.struct("high", "_age", "_seq")).alias("last_seq"), F.min_by("_first", F.struct("_age", "_seq")).alias("first_seq"))
    return merged.select(key, "first_discovered_at", "last_seen_at", "first_seq", "last_seq", "p.*")
