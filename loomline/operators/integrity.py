"""Assertions as tables of violations, which have to be empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.graph import dealt, settle

FEW = 10_000  # targets that every task may hold


def missing_references(rows: DataFrame, key: str, targets: DataFrame, target_key: str, rule: str) -> DataFrame:
    """(rule, key) of rows whose key is no target's."""
    rows, there = rows.where(F.col(key).isNotNull()).select(key), targets.select(F.col(target_key).alias("_t"))
    if there.count() <= FEW:
        there = F.broadcast(there)
    else:
        rows, there = dealt((rows, [key]), (there, ["_t"]))
    lost = rows.join(there, F.col(key) == F.col("_t"), "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated_keys(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """(rule, key) of keys that more than one row has."""
    return dealt((rows.select(*keys), keys))[0].groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"))


def failing(rows: DataFrame, key: str, good, rule: str) -> DataFrame:
    """(rule, key) of rows for which a condition isn't true."""
    return rows.where(~F.coalesce(good, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def story_violations(stories: DataFrame, memberships: DataFrame) -> DataFrame:
    """Violations of the story tables: one membership per article, one seed per story and it is the story's, scores in [0, 1], ordered intervals.

    Both are written first, as each rule reads them.
    """
    stories, memberships = settle(stories), settle(memberships)
    seeds = memberships.where("kind = 'SEED'")
    matched = memberships.where("kind = 'MATCHED'")
    seeded, named = dealt((seeds.select("story_id", "article_id"), ["story_id"]), (stories.select("story_id", "seed_article_id"), ["story_id"]))
    wrong_seed = seeded.join(named, "story_id").where("article_id <> seed_article_id")
    return (
        repeated_keys(memberships, ["article_id"], "one-story-per-article")
        .unionByName(repeated_keys(seeds, ["story_id"], "one-seed-per-story"))
        .unionByName(missing_references(memberships, "story_id", stories, "story_id", "membership-of-a-story"))
        .unionByName(missing_references(stories, "story_id", seeds, "story_id", "story-has-a-seed"))
        .unionByName(wrong_seed.select(F.lit("seed-is-the-storys").alias("rule"), F.col("story_id").alias("key")))
        .unionByName(failing(matched, "article_id", F.col("score").between(0, 1), "score-in-unit-interval"))
        .unionByName(failing(stories.where("first_ms IS NOT NULL"), "story_id", F.col("first_ms") <= F.col("last_ms"), "interval-ordered"))
    )
