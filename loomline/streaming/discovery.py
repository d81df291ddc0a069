"""Discovery as a stream: landed batches to articles, once each.

A micro-batch is normalised, judged for freshness against one clock, freed of
duplicates and merged into the article table. A job id is handled once: retries
fall to ``dropDuplicatesWithinWatermark``, and batch numbers that were done are
skipped, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import articles, dedup, freshness, normalize
from loomline.sources.buckets import BucketTable
from loomline.sources.tables import Table

PAYLOAD = ["title", "url", "source_id", "source_name", "source_type", "publisher_name", "publisher_id", "external_id", "published_at", "author", "summary", "category", "metadata"]


@dataclass
class Outcome:
    """What became of a batch."""

    articles: DataFrame
    duplicates: DataFrame
    rejects: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def discover(raw: DataFrame, now_ms: int, policy: freshness.FreshnessPolicy = freshness.FreshnessPolicy(), *, batch_col: str | None = None) -> Outcome:
    """The discovery steps over raw rows (source, payload as VARIANT; fetched_at; seq, distinct and in order of arrival)."""
    normalized = normalize.normalize_articles(raw)
    accepted, rejects = normalize.split(normalized)
    fresh = freshness.classify_freshness(accepted, now_ms, policy)
    flat = fresh.where("freshness.accepted").select("seq", *([batch_col] if batch_col else []), "canonical_url", "discovered_at", *[c for c in PAYLOAD if not c.startswith(("source_", "publisher_"))], *[F.col(f"source.{c}").alias(f"source_{c}") for c in ("id", "name", "type")], F.col("publisher.name").alias("publisher_name"), F.col("publisher.id").alias("publisher_id"))
    keyed = flat.withColumn("keys", dedup.article_keys(F.col("source_id"), F.col("external_id"), F.col("canonical_url"), F.col("publisher_name"), F.col("title")))
    judged = dedup.ordered_dedup(keyed, batch_col=batch_col)
    unique = flat.join(judged.where("status = 'unique'").select("seq"), "seq")
    counted = normalized.agg(F.count("*").alias("fetched"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")).first().asDict()
    kept = judged.groupBy("status").count().collect()
    counts = counted | {"normalized": counted["fetched"] - counted["rejected"], "fresh": sum(r["count"] for r in kept)} | {r["status"]: r["count"] for r in kept}
    stale = fresh.where("NOT freshness.accepted").select("seq", F.col("freshness.classification").alias("reject_reason"))
    return Outcome(unique, judged.where("status = 'duplicate'"), rejects.select("seq", "reject_reason").unionByName(stale), counts)


def merge_into(table: BucketTable, now: Callable[[], int], policy: freshness.FreshnessPolicy = freshness.FreshnessPolicy(), *, writer: str = "discovery") -> Callable[[DataFrame, int], None]:
    """As ``merge_batch``, into a table by buckets of the URL: what is written goes with the batch, several streams may write, each by a name of its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            clock, last = now(), batch.agg(F.max("seq")).first()[0]
            found = lambda version: discover(batch.withColumn("seq", F.col("seq") + version.facts.get("next_seq", 0)), clock, policy).articles.withColumn("batch_id", F.lit(batch_id))
            ahead = lambda version: {"next_seq": version.facts.get("next_seq", 0) + (0 if last is None else last + 1)}
            table.merge(found, lambda rows, current: articles.upsert(rows, current, payload=[*PAYLOAD, "batch_id"]), writer=writer, batch=batch_id, facts=ahead)
        finally:
            batch.unpersist()

    return run


def merge_batch(table: Table, now: Callable[[], int], policy: freshness.FreshnessPolicy = freshness.FreshnessPolicy()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts a batch's unique articles; the clock is read once a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            current = table.read()
            if current is not None and not current.where(F.col("batch_id") >= batch_id).isEmpty():
                return  # done before a restart
            base = 0 if current is None else (current.agg(F.max("last_seq")).first()[0] or 0) + 1
            found = discover(batch.withColumn("seq", F.col("seq") + base), now(), policy)
            merged = articles.upsert(found.articles.withColumn("batch_id", F.lit(batch_id)), current, payload=[*PAYLOAD, "batch_id"])
            table.replace(merged)
        finally:
            batch.unpersist()

    return run


def start(landed: DataFrame, table: Table | BucketTable, checkpoint: str, now: Callable[[], int], *, job_col: str = "job_id", time_col: str = "fetched_at", retry_window: str = "1 day", **trigger) -> StreamingQuery:
    """Run discovery over a stream of raw rows; a job id seen within the window is not handled again."""
    once = landed.withWatermark(time_col, retry_window).dropDuplicatesWithinWatermark([job_col, "seq"])
    return once.writeStream.foreachBatch((merge_into if isinstance(table, BucketTable) else merge_batch)(table, now)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
