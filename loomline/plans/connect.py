"""Queries over landed responses: the log of fetches and the articles, by the data source, batch and stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.graph import settle, shared_folder
from loomline.operators.observed import Collected, Pass, bounds
from loomline.plans.common import table
from loomline.plans.ingest import feed_body, provider_body
from loomline.sources import connector, feeds

SOURCES = feeds.registry([feeds.FeedConfig("feed-a", "Feed A", "https://a.example.org/rss"), feeds.FeedConfig("feed-b", "Feed B", "https://b.example.org/atom")])
ROUNDS = 3


def _scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/loomline-steps/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _rounds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Every page as a response of one of four sources, one of them unknown, in three rounds; some fetches failed."""
    k = F.col("page_id")
    source = F.when(k % 6 < 3, "gnews").when(k % 6 == 3, "feed-a").when(k % 6 == 4, "feed-b").otherwise("feed-z")
    failed = F.when(k % 13 == 2, "timeout").when(k % 17 == 3, "network")
    status = F.when(failed.isNull(), F.when(k % 19 == 4, 404).when(k % 23 == 5, 503).otherwise(200))
    rows = table(spark, sf_dir, "pages").select("page_id", source.alias("source_id"), k.cast("string").alias("fetch_id"), F.timestamp_seconds(k + 1_704_067_200).alias("fetched_at"), failed.alias("error_kind"), status.alias("status"), F.when(k % 6 < 3, provider_body()).otherwise(feed_body()).alias("body"))
    return [rows.where(k % ROUNDS == n).drop("page_id") for n in range(ROUNDS)]


def _log(read: DataFrame) -> DataFrame:
    return connector.fetch_log(read).withColumn("fetched_s", F.unix_seconds("fetched_at")).drop("fetched_at")


def source_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all fetches that have landed."""
    connector.register(spark)
    path = _scratch(spark, "landed")
    for n, rows in enumerate(_rounds(spark, sf_dir)):
        connector.land(rows, path, n)
    return _log(connector.read_responses(spark.read.format(connector.FORMAT).load(path), SOURCES))


def source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of all fetches, taken by a stream that is stopped and started again between the rounds."""
    connector.register(spark)
    path, out, state = (_scratch(spark, n) for n in ("landed", "articles", "offsets"))
    for n, rows in enumerate(_rounds(spark, sf_dir)):
        connector.land(rows, path, n)
        if n > 0:  # the first start finds two rounds
            read = connector.read_responses(spark.readStream.format(connector.FORMAT).load(path), SOURCES)
            articles = read.select("source_id", "source_name", "batch", "fetch_id", F.explode("articles").alias("a")).select("source_id", "source_name", "batch", "fetch_id", "a.pos", "a.payload")
            articles.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).withColumn("v", F.parse_json("payload"))
    text = lambda path: F.try_variant_get("v", path, "string")
    return rows.select("source_id", "source_name", "batch", "fetch_id", "pos", text("$.externalId").alias("external_id"), text("$.url").alias("url"), text("$.publisher.name").alias("publisher_name"))


KINDS = ("click", "view", "purchase", "signup", "error")


def fetch_pass() -> Pass:
    """Jobs by source and outcome and articles by source, over a log of fetches."""
    out = Pass("fetches").by("source_id", [*SOURCES, "feed-z"], F.col("source_id"), ("articles_fetched_total", None, F.col("fetched")))
    for status in ("completed", "failed"):
        out.by("source_id", [*SOURCES, "feed-z"], F.col("source_id"), ("discovery_jobs_total", F.col("outcome") == status, None), status=status)
    return out


def metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals seen while the log of fetches is written, and while events are: as durations of fetches, a kind of event for a source."""
    collected = Collected()
    fetches, seen = fetch_pass().attach(source_fetches(spark, sf_dir))
    settle(fetches)
    collected.add(fetch_pass().read(seen.get))
    durations = Pass("durations")
    for kind in KINDS:
        durations.histogram("source_fetch_duration_seconds", F.round(F.col("value") * 100) / 400, F.col("event_type") == kind, source_id=kind)
    events, seen = durations.attach(table(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    settle(events)
    collected.add(durations.read(seen.get))
    return collected.frame(spark).withColumn("value", F.round("value", 4))


QUERIES = {"source_fetches": source_fetches, "source_stream": source_stream, "metric_totals": metric_totals}

ROUND = """
WITH p AS (SELECT *, page_id AS k, CASE WHEN page_id % 6 < 3 THEN 'gnews' WHEN page_id % 6 = 3 THEN 'feed-a' WHEN page_id % 6 = 4 THEN 'feed-b' ELSE 'feed-z' END AS source_id,
  CASE WHEN page_id % 13 = 2 THEN 'timeout' WHEN page_id % 17 = 3 THEN 'network' END AS failed FROM pages),
s AS (SELECT *, CASE WHEN failed IS NULL THEN CASE WHEN k % 19 = 4 THEN 404 WHEN k % 23 = 5 THEN 503 ELSE 200 END END AS status FROM p),
r AS (SELECT *, coalesce(failed, CASE WHEN status <> 200 THEN 'http' WHEN source_id = 'feed-z' THEN NULL
  WHEN source_id = 'gnews' THEN CASE k % 4 WHEN 0 THEN 'invalid-json' WHEN 1 THEN 'invalid-response' END WHEN k % 3 = 2 THEN 'invalid-xml' END) AS kind FROM s),
n AS (SELECT *, CASE WHEN kind IS NOT NULL OR source_id = 'feed-z' THEN 0 WHEN source_id = 'gnews' OR k % 3 = 0 THEN 2 ELSE 1 END AS fetched FROM r)
"""

BOUNDS = ", ".join(f"({b}, '{b:g}')" for b in bounds("source_fetch_duration_seconds"))

SQL = {
    "metric_totals": ROUND
    + f""", l AS (SELECT *, CASE WHEN kind IS NULL AND source_id <> 'feed-z' THEN 'completed' ELSE 'failed' END AS outcome FROM n),
i AS (SELECT * FROM (VALUES ('gnews'), ('feed-a'), ('feed-b'), ('feed-z')) v(id)), e AS (SELECT event_type AS id, round(value * 100) / 400 AS s FROM events WHERE value IS NOT NULL),
t AS (SELECT unnest({list(KINDS)}) AS id)
SELECT 'articles_fetched_total' AS metric, 'source_id=' || id AS labels, NULL AS le, CAST(coalesce(sum(fetched), 0) AS DOUBLE) AS value FROM i LEFT JOIN l ON source_id = id GROUP BY id
UNION ALL SELECT 'discovery_jobs_total', 'source_id=' || id || ',status=' || o, NULL, CAST(count(source_id) AS DOUBLE) FROM i CROSS JOIN (VALUES ('completed'), ('failed')) w(o) LEFT JOIN l ON source_id = id AND outcome = o GROUP BY id, o
UNION ALL SELECT 'source_fetch_duration_seconds_bucket', 'source_id=' || t.id, le, CAST(count(s) AS DOUBLE) FROM t CROSS JOIN (VALUES {BOUNDS}, (CAST('Infinity' AS DOUBLE), '+Inf')) b(most, le) LEFT JOIN e ON e.id = t.id AND s <= most GROUP BY t.id, le
UNION ALL SELECT 'source_fetch_duration_seconds_count', 'source_id=' || t.id, NULL, CAST(count(s) AS DOUBLE) FROM t LEFT JOIN e USING (id) GROUP BY t.id
UNION ALL SELECT 'source_fetch_duration_seconds_sum', 'source_id=' || t.id, NULL, coalesce(round(sum(s), 4), 0) FROM t LEFT JOIN e USING (id) GROUP BY t.id""",
    "source_fetches": ROUND
    + """
SELECT source_id, k % 3 AS batch, CAST(k AS VARCHAR) AS fetch_id, 1704067200 + k AS fetched_s, CASE WHEN kind IS NULL AND source_id <> 'feed-z' THEN 'completed' ELSE 'failed' END AS outcome, kind, status,
  CASE WHEN source_id = 'feed-z' THEN 'unsupported-source' WHEN kind = 'timeout' THEN 'source-timeout' WHEN kind = 'network' THEN 'source-network' WHEN kind = 'http' THEN CASE status WHEN 503 THEN 'source-http-retryable' ELSE 'source-http-terminal' END
    WHEN kind IS NOT NULL THEN 'source-invalid-payload' END AS reason,
  CASE WHEN source_id = 'feed-z' THEN false WHEN kind IS NOT NULL THEN kind IN ('timeout', 'network') OR (kind = 'http' AND status = 503) END AS retryable,
  fetched, fetched > 0 AND source_id = 'gnews' AND k % 4 = 3 AS truncated FROM n""",
    "source_stream": ROUND
    + """
SELECT source_id, CASE source_id WHEN 'gnews' THEN 'GNews' WHEN 'feed-a' THEN 'Feed A' ELSE 'Feed B' END AS source_name, k % 3 AS batch, CAST(k AS VARCHAR) AS fetch_id, pos,
  CASE WHEN source_id = 'gnews' THEN CAST(k AS VARCHAR) WHEN pos = 0 THEN 'g' || k END AS external_id, CASE WHEN source_id = 'gnews' OR pos = 0 THEN url END AS url,
  CASE WHEN source_id = 'gnews' THEN 'S' ELSE 'Feed ' || k END AS publisher_name FROM n, (VALUES (0), (1)) v(pos) WHERE pos < fetched""",
}
