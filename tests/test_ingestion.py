import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import articles, dedup, freshness, normalize
from loomline.sources import feeds
from loomline.sources.tables import Table
from loomline.streaming import discovery

NOW = 1_788_004_800_000  # 2026-08-29T12:00:00Z
SOURCE = {"id": "src", "name": "Source", "type": "rss"}


def raw(spark, cases):
    rows = [(k, json.dumps(s), json.dumps(a)) for k, (s, a) in enumerate(cases)]
    return spark.createDataFrame(rows, "seq long, s string, a string").select("seq", F.parse_json("s").alias("source"), F.parse_json("a").alias("payload"), F.timestamp_millis(F.lit(NOW)).alias("fetched_at"))


REJECTS = [
    ("invalid-source", {"id": " ", "name": "n", "type": "api"}, {}), ("invalid-source", {"id": "a", "name": "n", "type": "web"}, {}), ("invalid-source", None, {}), ("invalid-article-shape", SOURCE, {"title": None}),
    ("invalid-article-shape", SOURCE, {"title": 5}), ("invalid-article-shape", SOURCE, {"title": "t", "url": "http://a.b/c", "publisher": {"name": " "}}), ("invalid-article-shape", SOURCE, {"title": "t", "metadata": [1]}),
    ("invalid-article-shape", SOURCE, [1]), ("missing-title", SOURCE, {}), ("missing-title", SOURCE, {"title": "  "}), ("missing-url", SOURCE, {"title": "t", "url": " "}), ("invalid-url", SOURCE, {"title": "t", "url": "ftp://x/"}),
    ("invalid-published-at", SOURCE, {"title": "t", "url": "http://a.b/c", "publishedAt": "soon"}), (None, SOURCE, {"title": "t", "url": "http://a.b/c", "publishedAt": "  "}), (None, SOURCE | {"extra": 1}, {"title": " T  t ", "url": "http://a.b/c?utm_a=1#x", "extra": None, "metadata": {"b": 1, "a": None}}),
]


def test_reject_reasons_in_order(spark):
    out = normalize.normalize_articles(raw(spark, [c[1:] for c in REJECTS])).orderBy("seq").collect()
    assert [r.reject_reason for r in out] == [c[0] for c in REJECTS]
    last = out[-1].article
    assert (last.title, last.url, last.canonical_url, last.metadata, last.published_at) == ("T t", "http://a.b/c?utm_a=1", "http://a.b/c", '{"a":null,"b":1}', None)
    assert all((r.article is None) == (r.reject_reason is not None) for r in out)


def test_freshness_bounds_are_inclusive(spark):
    policy = freshness.FreshnessPolicy()
    cases = [(NOW - 86_400_000, "fresh"), (NOW - 86_400_001, "stale"), (NOW + 300_000, "fresh"), (NOW + 300_001, "future-published-at"), (None, "missing-published-at")]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p long").select(F.timestamp_millis("p").alias("published_at"), F.timestamp_millis(F.lit(NOW - 5)).alias("discovered_at"))
    assert [r.freshness.classification for r in freshness.classify_freshness(df, NOW, policy).collect()] == [c for _, c in cases]
    later = freshness.classify_freshness(df, NOW, freshness.FreshnessPolicy(missing_published_at="use-discovered-at")).collect()[-1].freshness
    assert (later.classification, later.timestamp_basis, later.age_ms) == ("fresh", "discovered-at", 5)
    with pytest.raises(ValueError):
        freshness.FreshnessPolicy(max_age_ms=-1)


def scan(rows):
    held, out = {}, {}
    for seq, keys in rows:
        hit = next(((t, v) for t, v in keys if (t, v) in held), None)
        if hit:
            out[seq] = ("duplicate", *hit, held[hit])
        else:
            out[seq] = ("unique", None, None, None)
            held |= dict.fromkeys(keys, seq)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ordered_dedup_is_the_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(k, [(t, f"v{rng.randrange(9)}") for t in ("source-external-id", "canonical-url", "publisher-title") if rng.random() < 0.7]) for k in range(60)]
    df = spark.createDataFrame([(k, [(p, t, v) for p, (t, v) in enumerate(keys)]) for k, keys in rows], "seq long, keys array<struct<priority:int,type:string,value:string>>")
    got = {r.seq: (r.status, r.reason, r.matched_key, r.original) for r in dedup.ordered_dedup(df.repartition(5)).collect()}
    assert got == scan(rows)


def test_keys_do_not_travel_over_duplicates(spark):
    rows = [(1, [(0, "a", "x")]), (2, [(0, "a", "x"), (1, "b", "y")]), (3, [(1, "b", "y")]), (4, [])]
    df = spark.createDataFrame(rows, "seq long, keys array<struct<priority:int,type:string,value:string>>")
    assert {r.seq: r.status for r in dedup.ordered_dedup(df).collect()} == {1: "unique", 2: "duplicate", 3: "unique", 4: "unique"}
    batches = df.withColumn("job", F.col("seq"))
    assert {r.status for r in dedup.ordered_dedup(batches, batch_col="job").collect()} == {"unique"}


def test_keys(spark):
    df = spark.createDataFrame([("S", "ID 1", "http://u/", "Pub", "A  Title"), ("S", None, "http://u/", None, "t")], "s string, e string, u string, p string, t string")
    out = df.select(dedup.article_keys(*[F.col(c) for c in "seupt"])).collect()
    assert [[tuple(k) for k in r[0]] for r in out] == [[(0, "source-external-id", "s:id 1"), (1, "canonical-url", "http://u/"), (2, "publisher-title", "pub:a title")], [(1, "canonical-url", "http://u/")]]


def test_upserts_equal_the_fold_in_any_batches(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randrange(8)}", rng.randrange(6), k, rng.choice([None, f"t{k}"])) for k in range(80)]
    want = {}
    for key, seen, seq, title in rows:
        old = want.get(key)
        if old is None:
            want[key] = [seen, seen, title, seq]
        else:
            if seen >= old[1]:
                old[2] = title
            old[0], old[1] = min(old[0], seen), max(old[1], seen)
    df = spark.createDataFrame(rows, "canonical_url string, discovered_at long, seq long, title string")
    for cuts in ([80], [30, 50, 80]):
        table, begin = None, 0
        for end in cuts:
            table = articles.upsert(df.where((F.col("seq") >= begin) & (F.col("seq") < end)), table, payload=["title"])
            begin = end
        assert {r.canonical_url: [r.first_discovered_at, r.last_seen_at, r.title, r.first_seq] for r in table.collect()} == want


def test_feeds():
    rss = """<rss><channel><title>Chan</title><item><guid isPermaLink="false">17</guid><title>A</title><link> http://x/ </link><description>D</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><dc:creator xmlns:dc="http://purl.org/dc/elements/1.1/">W</dc:creator><category>
    </category><category>News</category></item><item><guid>17</guid><title>5</title></item><item/></channel></rss>"""
    error, out = feeds.parse_feed(rss)
    assert error is None and out == [
        {"externalId": "17", "url": "http://x/", "publishedAt": "Tue, 02 Jan 2024 03:04:05 GMT", "author": "W", "summary": "D", "title": "A", "category": "News", "publisher": {"name": "Chan"}, "metadata": {"feedFormat": "rss"}},
        {"title": "5", "publisher": {"name": "Chan"}, "metadata": {"feedFormat": "rss"}},
    ]
    assert feeds.parse_feed(rss, "Mine", 1)[1][0]["publisher"] == {"name": "Mine"} and len(feeds.parse_feed(rss, None, 1)[1]) == 1
    assert feeds.parse_feed("<rss><channel>")[0] == "invalid-xml" and feeds.parse_feed("<html/>")[0] == "invalid-feed"
    found = feeds.registry([feeds.FeedConfig("f.1", "F", "https://f.org/rss")])
    assert feeds.resolve(found, "f.1") == ("F", "rss")
    with pytest.raises(feeds.UnsupportedSource):
        feeds.resolve(found, "x")
    for bad in (("gnews", "n", "http://a.b/"), ("UP", "n", "http://a.b/"), ("a", "n", "ftp://a/"), ("a", " ", "http://a.b/")):
        with pytest.raises(ValueError):
            feeds.FeedConfig(*bad)


def test_discovery_stream_is_idempotent(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, rows):
        (landing / name).write_text("\n".join(json.dumps({"job_id": j, "seq": k, "source": json.dumps(SOURCE), "payload": json.dumps(a), "fetched_at": "2026-08-29T11:00:00Z"}) for k, (j, a) in enumerate(rows)))

    def run():
        raw_stream = spark.readStream.schema("job_id string, seq long, source string, payload string, fetched_at timestamp").json(str(landing))
        shaped = raw_stream.select("job_id", "seq", F.parse_json("source").alias("source"), F.parse_json("payload").alias("payload"), "fetched_at")
        discovery.start(shaped, table, str(tmp_path / "ckpt"), lambda: NOW).awaitTermination()

    table = Table(spark, str(tmp_path / "articles"))
    fresh = {"publishedAt": "2026-08-29T10:00:00Z"}
    land("1.json", [("j1", {"title": "One", "url": "http://a.b/1"} | fresh), ("j1", {"title": "Two", "url": "http://a.b/2"} | fresh), ("j1", {"title": "Again", "url": "http://a.b/1#x"} | fresh), ("j1", {"url": "http://a.b/3"}), ("j1", {"title": "Old", "url": "http://a.b/4", "publishedAt": "2020-01-01"})])
    run()
    assert {(r.canonical_url, r.title) for r in table.read().collect()} == {("http://a.b/1", "One"), ("http://a.b/2", "Two")}
    run()
    land("2.json", [("j1", {"title": "Retry", "url": "http://a.b/1"} | fresh)])
    land("3.json", [("j2", {"title": "New one", "url": "http://a.b/1"} | fresh), ("j2", {"title": "Five", "url": "http://a.b/5"} | fresh)])
    run()
    assert {(r.canonical_url, r.title) for r in table.read().collect()} == {("http://a.b/1", "New one"), ("http://a.b/2", "Two"), ("http://a.b/5", "Five")}


def test_discovery_counts(spark):
    found = discovery.discover(raw(spark, [(SOURCE, {"title": "a", "url": "http://a.b/1", "publishedAt": "2026-08-29T11:59:00Z"}), (SOURCE, {"title": "b", "url": "http://a.b/1", "publishedAt": "2026-08-29T11:59:00Z"}), (SOURCE, {"title": "c", "url": "http://a.b/2"}), (SOURCE, {})]), NOW)
    assert found.counts == {"fetched": 4, "rejected": 1, "normalized": 3, "fresh": 2, "unique": 1, "duplicate": 1}
    assert sorted(r.reject_reason for r in found.rejects.collect()) == ["missing-published-at", "missing-title"]
