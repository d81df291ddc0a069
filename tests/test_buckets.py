import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import articles, persistence
from loomline.sources.buckets import BucketTable, Conflict, Version
from loomline.streaming import discovery
from tests.test_ingestion import NOW, SOURCE

SCHEMA = "canonical_url string, discovered_at long, seq long, title string"


def upsert(rows, current):
    return articles.upsert(rows, current, payload=["title"])


def told(table):
    return {r.canonical_url: (r.first_discovered_at, r.last_seen_at, r.title, r.first_seq) for r in table.read().collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_batches_give_the_whole_upsert_and_write_their_buckets_only(spark, tmp_path):
    df = spark.createDataFrame([(f"u{k % 900}", k % 7, k, f"title {k} " + "x" * 200) for k in range(2000)], SCHEMA)
    table = BucketTable(spark, str(tmp_path / "t"), "canonical_url", 16)
    assert table.read() is None
    assert table.merge(lambda _: df.where("seq < 1500"), upsert, writer="a", batch=0)
    before = size(tmp_path / "t")
    assert table.merge(lambda _: df.where("seq = 1500"), upsert, writer="a", batch=1)
    first, second = size(tmp_path / "t") - before, len(os.listdir(next((tmp_path / "t" / "data").glob("000000000002-*"))))
    assert first < before / 8 and second <= 3  # a bucket and Spark's own marks
    assert table.merge(lambda _: df.where("seq > 1500"), upsert, writer="a", batch=2)
    want = {r.canonical_url: (r.first_discovered_at, r.last_seen_at, r.title, r.first_seq) for r in upsert(df, None).collect()}
    assert told(table) == want
    assert not table.merge(lambda _: df, upsert, writer="a", batch=2) and table.merge(lambda _: df.limit(0), upsert, writer="a", batch=3)
    assert told(table) == want and table.version().done == {"a": 3}
    assert table.vacuum() == 1 and told(table) == want and BucketTable(spark, str(tmp_path / "t"), "canonical_url", 16).version().number == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_writers_that_come_between_lose_nothing(spark, tmp_path, seed):
    pick = random.Random(seed)
    rows = [(f"u{pick.randrange(30)}", pick.randrange(6), k, f"t{k}") for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    table, other = (BucketTable(spark, str(tmp_path / "t"), "canonical_url", 4) for _ in range(2))
    table.merge(lambda _: df.where("seq < 30"), upsert, writer="a", batch=0)
    meant = []

    def late(rows, current):
        if not meant:  # while this writer has read but not committed
            meant.append(other.merge(lambda _: df.where("seq >= 30 AND seq < 60"), upsert, writer="b", batch=0))
        return upsert(rows, current)

    assert table.merge(lambda _: df.where("seq >= 60"), late, writer="a", batch=1) and meant == [True]
    want = {r.canonical_url: (r.first_discovered_at, r.last_seen_at, r.title, r.first_seq) for r in upsert(df, None).collect()}
    assert told(table) == want and table.version().done == {"a": 1, "b": 0} and table.version().number == 3
    with pytest.raises(Conflict):
        table.commit(Version(3))


def test_two_writers_seed_the_same_stories(spark, tmp_path):
    kind = "story_id string, seed_article_id long, canonical_title string, clustering_version string"
    mine = spark.createDataFrame([("s1", 1, "t", "v1"), ("s2", 2, "t", "v1")], kind)
    theirs = spark.createDataFrame([("s2", 2, "t", "v1"), ("s3", 3, "t", "v1"), ("s1", 1, "other", "v1")], kind)
    table = BucketTable(spark, str(tmp_path / "s"), "story_id", 2)
    assert {r.outcome for r in persistence.commit_seeds(table, mine, writer="a", batch=0).collect()} == {"new"}
    said = {r.story_id: (r.outcome, list(r.differs)) for r in persistence.commit_seeds(table, theirs, writer="b", batch=0).collect()}
    assert said == {"s1": ("conflict", ["title"]), "s2": ("replayed", []), "s3": ("new", [])}
    assert persistence.commit_seeds(table, theirs, writer="b", batch=0) is None
    assert {(r.story_id, r.canonical_title, r.representative_article_id) for r in table.read().collect()} == {("s1", "t", 1), ("s2", "t", 2), ("s3", "t", 3)}


def test_discovery_into_buckets(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    fresh = {"publishedAt": "2026-08-29T10:00:00Z"}

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps({"job_id": j, "seq": k, "source": json.dumps(SOURCE), "payload": json.dumps(a | fresh), "fetched_at": "2026-08-29T11:00:00Z"}) for k, (j, a) in enumerate(rows)))

    def run():
        stream = spark.readStream.schema("job_id string, seq long, source string, payload string, fetched_at timestamp").json(str(landing))
        shaped = stream.select("job_id", "seq", F.parse_json("source").alias("source"), F.parse_json("payload").alias("payload"), "fetched_at")
        discovery.start(shaped, table, str(tmp_path / "ckpt"), lambda: NOW).awaitTermination()

    table = BucketTable(spark, str(tmp_path / "articles"), "canonical_url", 4)
    land("1.json", [("j1", {"title": "One", "url": "http://a.b/1"}), ("j1", {"title": "Two", "url": "http://a.b/2"}), ("j1", {"title": "Again", "url": "http://a.b/1#x"}), ("j1", {"url": "http://a.b/3"})])
    run()
    assert {(r.canonical_url, r.title) for r in table.read().collect()} == {("http://a.b/1", "One"), ("http://a.b/2", "Two")}
    number = table.version().number
    run()
    land("2.json", [("j2", {"title": "New one", "url": "http://a.b/1"}), ("j2", {"title": "Five", "url": "http://a.b/5"})])
    run()
    assert {(r.canonical_url, r.title) for r in table.read().collect()} == {("http://a.b/1", "New one"), ("http://a.b/2", "Two"), ("http://a.b/5", "Five")}
    assert table.version().number > number and table.version().facts["next_seq"] == 6
