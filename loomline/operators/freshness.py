"""Freshness of articles against a fixed clock."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.vocabulary import MISSING_DATE_POLICIES


@dataclass(frozen=True)
class FreshnessPolicy:
    """Both bounds are inclusive."""

    max_age_ms: int = 24 * 3_600_000
    max_future_skew_ms: int = 5 * 60_000
    missing_published_at: str = "reject"

    def __post_init__(self):
        for bound in (self.max_age_ms, self.max_future_skew_ms):
            if not math.isfinite(bound) or bound < 0:
                raise ValueError("bounds are finite and not negative")
        if self.missing_published_at not in MISSING_DATE_POLICIES:
            raise ValueError(f"missing_published_at is one of {MISSING_DATE_POLICIES}")


def freshness(published: Column, discovered: Column, now_ms: int, policy: FreshnessPolicy) -> Column:
    """struct<accepted,classification,timestamp_basis,evaluated_at,age_ms>."""
    fall_back = policy.missing_published_at == "use-discovered-at"
    published, discovered = published.cast("timestamp"), discovered.cast("timestamp")
    at = F.coalesce(published, discovered) if fall_back else published
    basis = F.when(published.isNotNull(), "published-at").otherwise(F.lit("discovered-at") if fall_back else F.lit(None).cast("string"))
    age = F.lit(now_ms) - F.unix_millis(at)
    kind = F.when(at.isNull(), "missing-published-at").when(age < -policy.max_future_skew_ms, "future-published-at").when(age > policy.max_age_ms, "stale").otherwise("fresh")
    return F.struct((kind == "fresh").alias("accepted"), kind.alias("classification"), basis.alias("timestamp_basis"), at.alias("evaluated_at"), age.alias("age_ms"))


def classify_freshness(articles: DataFrame, now_ms: int, policy: FreshnessPolicy = FreshnessPolicy(), *, published_col: str = "published_at", discovered_col: str = "discovered_at") -> DataFrame:
    """articles with a column ``freshness``."""
    return articles.withColumn("freshness", freshness(F.col(published_col), F.col(discovered_col), now_ms, policy))
