import json

import pytest
from pyspark.sql import functions as F

from loomline.sources import connector, feeds

SOURCES = feeds.registry([feeds.FeedConfig("feed-a", "Feed A", "https://a.example.org/rss")])
ARTICLE = {"id": "x", "title": "T", "url": "https://e.org/", "publishedAt": "2024-01-02T03:04:05Z", "source": {"id": "s", "name": "S", "url": "u"}}
GOOD = json.dumps({"totalArticles": 3, "articles": [ARTICLE, ARTICLE]})
RSS = "<rss><channel><title>F</title><item><title>t</title></item></channel></rss>"
RESPONSES = "source_id string, fetch_id string, fetched_at timestamp, error_kind string, status int, body string"


def responses(spark, rows):
    return spark.createDataFrame(rows, "source_id string, fetch_id string, error_kind string, status int, body string").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200)))


def log(df):
    return {r.fetch_id: (r.source_id, r.batch, r.outcome, r.kind, r.reason, r.retryable, r.fetched, r.truncated) for r in connector.fetch_log(connector.read_responses(df, SOURCES)).collect()}


ROWS = [
    ("gnews", "ok", None, 200, GOOD), ("gnews", "json", None, None, "{"), ("gnews", "shape", None, 200, '{"articles": 5}'), ("gnews", "null", None, 200, None), ("gnews", "late", "timeout", None, None),
    ("feed-a", "rss", None, 200, RSS), ("feed-a", "xml", None, 200, "<rss>"), ("feed-a", "busy", None, 503, "busy"), ("feed-a", "gone", None, 404, RSS), ("feed-a", "net", "network", None, None), ("other", "strange", None, 200, GOOD),
]
WANT = {
    "ok": ("gnews", 0, "completed", None, None, None, 2, True), "json": ("gnews", 0, "failed", "invalid-json", "source-invalid-payload", False, 0, False), "shape": ("gnews", 0, "failed", "invalid-response", "source-invalid-payload", False, 0, False),
    "null": ("gnews", 0, "failed", "invalid-json", "source-invalid-payload", False, 0, False), "late": ("gnews", 0, "failed", "timeout", "source-timeout", True, 0, False), "rss": ("feed-a", 0, "completed", None, None, None, 1, False),
    "xml": ("feed-a", 0, "failed", "invalid-xml", "source-invalid-payload", False, 0, False), "busy": ("feed-a", 0, "failed", "http", "source-http-retryable", True, 0, False), "gone": ("feed-a", 0, "failed", "http", "source-http-terminal", False, 0, False),
    "net": ("feed-a", 0, "failed", "network", "source-network", True, 0, False), "strange": ("other", 0, "failed", None, "unsupported-source", False, 0, False),
}


def test_every_fetch_is_in_the_log(spark, tmp_path):
    path = str(tmp_path / "landed")
    connector.register(spark)
    connector.land(responses(spark, ROWS), path, 0)
    df = spark.read.format(connector.FORMAT).load(path)
    assert log(df) == WANT
    assert log(spark.read.format(connector.FORMAT).option("sources", "gnews, other").load(f"file://{path}")) == {k: v for k, v in WANT.items() if v[0] != "feed-a"}
    assert {r.fetched_at.isoformat() for r in df.select("fetched_at").distinct().collect()} == {"2024-01-01T00:00:00"}
    articles = feeds.raw_articles(connector.read_responses(df, SOURCES, 1), "fetch_id", "source_name")
    assert sorted((r.fetch_id, r.source_name, r.pos) for r in articles.drop("payload").collect()) == [("ok", "GNews", 0), ("rss", "Feed A", 0)]
    with pytest.raises(ValueError, match="landed"):
        connector.land(responses(spark, ROWS), path, 0)
    with pytest.raises(ValueError, match="positive"):
        connector.read_responses(df, SOURCES, 0)


def test_a_source_has_partitions_of_its_own(spark, tmp_path):
    path = str(tmp_path / "landed")
    connector.register(spark)
    many = spark.range(400).select(F.lit("gnews").alias("source_id"), F.col("id").cast("string").alias("fetch_id"), F.lit(None).cast("string").alias("error_kind"), F.lit(200).alias("status"), F.lit(GOOD).alias("body"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    connector.land(many.repartition(3).unionByName(responses(spark, ROWS[5:6]).coalesce(1)), path, 0)
    files = connector._Folder({"path": path}).files(-1, 0)
    assert [f.source_id for f in files].count("gnews") == 3 and [f.source_id for f in files].count("feed-a") == 1
    df = spark.read.format(connector.FORMAT).load(path)
    assert df.count() == 401 and df.select(F.spark_partition_id()).distinct().count() >= 3
    assert spark.read.format(connector.FORMAT).load(str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_after_the_last_batch(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    connector.register(spark)

    def run():
        rows = spark.readStream.format(connector.FORMAT).load(path)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch, r.fetch_id) for r in spark.read.parquet(out).select("batch", "fetch_id").collect())

    connector.land(responses(spark, ROWS[:2]), path, 0)
    connector.land(responses(spark, ROWS[2:3]), path, 1)
    first = [(0, "json"), (0, "ok"), (1, "shape")]
    assert run() == first
    assert run() == first  # nothing new: nothing again
    connector.land(responses(spark, ROWS[5:7]), path, 3)
    (tmp_path / "landed" / f"{2:012d}").mkdir()  # a round under way: the stream waits for it
    assert run() == first
    connector.land(responses(spark, ROWS[3:5]), path, 2)
    assert run() == [*first, (2, "late"), (2, "null"), (3, "rss"), (3, "xml")]


def test_a_file_is_read_a_few_responses_at_a_time(tmp_path):
    """Of a row group of 32 MB a reader holds what it passes on and a little that it has read ahead."""
    import datetime
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 4000
    rows = pa.table({"fetch_id": [str(k) for k in range(n)], "fetched_at": pa.array([datetime.datetime(2024, 1, 1)] * n, pa.timestamp("us", tz="UTC")), "error_kind": pa.nulls(n, pa.string()), "status": pa.array([200] * n, pa.int32()), "body": [os.urandom(4096).hex() for _ in range(n)]})
    pq.write_table(rows, tmp_path / "part.parquet", row_group_size=n, use_dictionary=False)
    del rows
    held, most, seen = pa.total_allocated_bytes(), 0, 0
    for batch in connector._Folder({"path": str(tmp_path)}).read(connector.File("gnews", 0, str(tmp_path / "part.parquet"))):
        most, seen = max(most, pa.total_allocated_bytes() - held), seen + batch.num_rows
    assert seen == n and most < 16 << 20
