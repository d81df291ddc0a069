"""Seed stories written by several writers: what is new is added, what is there already is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.capabilities import seed_replays
from loomline.operators.graph import settle
from loomline.sources.buckets import BucketTable

STORY = ("story_id", "seed_article_id", "representative_article_id", "canonical_title", "clustering_version")


def commit_seeds(table: BucketTable, inputs: DataFrame, *, writer: str, batch: int) -> DataFrame | None:
    """(story_id, outcome new|replayed|conflict, differs) of seed stories that a writer wants to add; None if its batch was done before.

    inputs: story_id (one row each), seed_article_id, canonical_title,
    clustering_version. table: by story_id. If another writer adds stories
    meanwhile, they are read again, and what both add is a replay or a conflict of
    the later one; nothing that is there is changed.
    """
    said: list[DataFrame] = []

    def add(rows: DataFrame, current: DataFrame | None) -> DataFrame:
        new = rows.withColumn("representative_article_id", F.col("seed_article_id")).select(*STORY)
        there = current if current is not None else new.limit(0)
        members = there.select("story_id", F.col("seed_article_id").alias("article_id"), F.lit("SEED").alias("kind"), "clustering_version")
        said.append(settle(seed_replays(rows, there, members)))
        return there.unionByName(new.join(said[-1].where("outcome = 'new'"), "story_id", "left_semi"))

    done = table.merge(lambda _: inputs, add, writer=writer, batch=batch)
    return (said[-1] if said else None) if done else None
