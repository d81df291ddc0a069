"""Queries of text, URLs, sources, normalisation, freshness, duplicates and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import bounded_page_text, content_type, normalize_text, title_tokens
from loomline.functions.urls import normal_forms, url_safety
from loomline.operators import articles, dedup, evaluation, freshness, metrics, normalize, persistence, research
from loomline.operators.graph import shared_folder
from loomline.plans.common import at_ms, table
from loomline.sources import feeds
from loomline.sources.buckets import BucketTable

NOW_MS = 1_705_363_200_000  # 2024-01-16T00:00:00Z
POLICY = freshness.FreshnessPolicy(max_age_ms=7 * 86_400_000, max_future_skew_ms=86_400_000)
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalize_text(F.col("text"))).alias("text_md5"), F.char_length(normalize_text(F.col("text"))).alias("n"))


def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normal_forms(F.col("url")).alias("u")).select("page_id", "u.*")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", bounded_page_text(F.col("html")).alias("t"))
    return out.select("page_id", "t.status", F.md5("t.text").alias("text_md5"), "t.truncated")


def url_safety_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10."), F.col("page_id") % 256, F.lit(".1.2/"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("http://"), F.col("page_id") % 224 + 1, F.lit(".8.8.8/"))).when(F.col("page_id") % 5 == 2, "http://db.internal/x").otherwise(F.col("url"))
    return pages.select("page_id", url_safety(host).alias("safety"))


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit(" Text/"), F.initcap("event_type"), F.lit(" ; charset="), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", content_type(header).alias("media_type"))


RAW = """
CASE page_id % 10
 WHEN 0 THEN '{"url":"' || url || '"}'
 WHEN 1 THEN '{"title":null,"url":"' || url || '"}'
 WHEN 2 THEN '{"title":"t ' || page_id || '"}'
 WHEN 3 THEN '{"title":"t","url":"ftp://x.example.org/"}'
 WHEN 4 THEN '{"title":"t","url":"' || url || '","publishedAt":"not a date"}'
 WHEN 5 THEN '{"title":"t","url":"' || url || '","publisher":{"name":"  "}}'
 WHEN 6 THEN '{"title":5,"url":"' || url || '"}'
 WHEN 7 THEN '{"title":"  t  ' || page_id || ' ","url":"' || url || '","publishedAt":"Tue, 02 Jan 2024 03:04:05 +0100"}'
 ELSE '{"title":"t ' || page_id || '","url":"' || url || '","publishedAt":"2024-01-02T03:04:05Z","publisher":{"name":"P"}}' END
"""


def normalization_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    source = F.expr("CASE WHEN page_id % 30 = 8 THEN '{\"id\":\" \",\"name\":\"N\",\"type\":\"api\"}' ELSE '{\"id\":\"s\",\"name\":\"N\",\"type\":\"rss\"}' END")
    raw = pages.select("page_id", F.parse_json(source).alias("source"), F.parse_json(F.expr(RAW)).alias("payload"), F.timestamp_millis(F.lit(NOW_MS)).alias("fetched_at"))
    out = normalize.normalize_articles(raw)
    return out.select("page_id", "reject_reason", F.col("article.title").alias("title"), F.col("article.canonical_url").alias("canonical_url"), F.unix_millis("article.published_at").alias("published_ms"), F.col("article.publisher.name").alias("publisher_name"))


def feed_body() -> Column:
    """A feed of a page: RSS of two items, Atom of one, or broken XML."""
    rss = F.expr("""'<rss version="2.0"><channel><title>Feed ' || page_id || '</title><item><guid>g' || page_id || '</guid><title>T ' || page_id || '</title><link>' || replace(url, '&', '&amp;') || '</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><category> </category><category>c</category></item><item><guid>17</guid><title>second</title></item></channel></rss>'""")
    atom = F.expr("""'<feed xmlns="http://www.w3.org/2005/Atom"><title>Feed ' || page_id || '</title><entry><id>g' || page_id || '</id><title>T ' || page_id || '</title><link rel="self" href="http://no.example.org/"/><link href="' || replace(url, '&', '&amp;') || '"/><updated>2024-01-02T03:04:05Z</updated><category term="c"/></entry></feed>'""")
    return F.when(F.col("page_id") % 3 == 0, rss).when(F.col("page_id") % 3 == 1, atom).otherwise("<rss><channel>")


def feed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = feeds.read_feeds(table(spark, sf_dir, "pages").select("page_id", feed_body().alias("body")))
    rows = read.select("page_id", "error", F.explode_outer("articles").alias("a")).withColumn("v", F.parse_json(F.col("a.payload")))
    text = lambda path: F.try_variant_get("v", path, "string")
    return rows.select("page_id", "error", F.col("a.pos").alias("pos"), *[text(f"$.{f}").alias(n) for f, n in (("externalId", "external_id"), ("title", "title"), ("url", "url"), ("category", "category"), ("publisher.name", "publisher_name"), ("metadata.feedFormat", "feed_format"))])


def provider_body() -> Column:
    """A response of the JSON provider about a page: broken, of a wrong shape, or of two articles with a total of two or three."""
    one = """'{"id":"' || page_id || '","title":"T","description":' || CASE WHEN page_id % 2 = 0 THEN '"d"' ELSE 'null' END || ',"url":"' || url || '","publishedAt":"2024-01-02T03:04:05Z","source":{"id":"s","name":"S","url":"u"}}'"""
    return F.expr(f"CASE page_id % 4 WHEN 0 THEN '{{' WHEN 1 THEN '{{\"totalArticles\":1,\"articles\":[{{\"id\":5}}]}}' ELSE '{{\"totalArticles\":' || page_id % 4 || ',\"articles\":[' || {one} || ',' || {one} || ']}}' END")


def gnews_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = feeds.read_gnews(table(spark, sf_dir, "pages").select("page_id", provider_body().alias("body")))
    rows = read.select("page_id", "error", "truncated", F.explode_outer("articles").alias("a")).withColumn("v", F.parse_json(F.col("a.payload")))
    text = lambda path: F.try_variant_get("v", path, "string")
    return rows.select("page_id", "error", "truncated", F.col("a.pos").alias("pos"), *[text(f"$.{f}").alias(n) for f, n in (("externalId", "external_id"), ("url", "url"), ("summary", "summary"), ("publisher.name", "publisher_name"))])


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  $"), F.col("text"), F.lit("$\t"))
    return table(spark, sf_dir, "benchmark").select("item_id", feeds.search_query(raw).alias("query"))


def freshness_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    published = F.when(F.col("event_type") != "error", F.col("ts"))
    out = freshness.classify_freshness(events.select("event_id", published.alias("published_at"), F.col("ts").alias("discovered_at")), NOW_MS, POLICY)
    return out.select("event_id", "freshness.accepted", "freshness.classification", "freshness.timestamp_basis", "freshness.age_ms")


def freshness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    policy = freshness.FreshnessPolicy(POLICY.max_age_ms, POLICY.max_future_skew_ms, "use-discovered-at")
    published = F.when(F.col("event_type") != "error", F.col("ts"))
    out = freshness.classify_freshness(events.select("event_id", published.alias("published_at"), F.col("ts").alias("discovered_at")), NOW_MS, policy)
    return out.groupBy("freshness.classification", "freshness.timestamp_basis").agg(F.count("*").alias("articles"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")  # whole lines: the first names a document within its source, the last is its title
    keys = dedup.article_keys(F.col("source"), F.when(F.length("text") > 0, F.element_at(lines, 1)), F.md5("text"), F.col("source"), F.element_at(lines, -1))
    return docs.select("doc_id", keys.alias("keys"))


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.priority", "k.type", F.md5("k.value").alias("value_md5"))


def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.ordered_dedup(_keyed(spark, sf_dir), order_col="doc_id")
    return out.select("doc_id", "status", "reason", F.md5("matched_key").alias("key_md5"), "original")


def article_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("canonical_url"), F.date_trunc("hour", "ts").alias("discovered_at"), F.pmod(F.xxhash64("event_id"), F.lit(1 << 40)).alias("unused"), F.col("event_id").alias("seq"), "value", "props")
    out = articles.upsert(events, payload=["value", "props"])
    return out.select("canonical_url", F.unix_millis("first_discovered_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), "first_seq", "last_seq", "value", "props")


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table merged by buckets, in three batches of two writers."""
    events = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("canonical_url"), F.date_trunc("hour", "ts").alias("discovered_at"), F.col("event_id").alias("seq"), "value", "props")
    ends = events.agg(F.min("seq"), F.max("seq")).first()
    low, high = ends[0] or 0, ends[1] or 0
    merged = BucketTable(spark, f"{shared_folder(spark)}/loomline-steps/articles-{uuid.uuid4().hex}", "canonical_url", 8)
    for k in range(3):
        batch = events.where((F.col("seq") >= low + (high + 1 - low) * k // 3) & (F.col("seq") < low + (high + 1 - low) * (k + 1) // 3))
        merged.merge(lambda _, rows=batch: rows, lambda rows, current: articles.upsert(rows, current, payload=["value", "props"]), writer=f"w{k % 2}", batch=k)
    return merged.read().select("canonical_url", F.unix_millis("first_discovered_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), "first_seq", "last_seq", "value", "props")


def seed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' stories added by one writer, then by another that has some in common, a few of them with another title."""
    c = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("seed_article_id"))
    story = rows.select(c, F.concat(F.lit("s"), c.cast("string")).alias("story_id"), "seed_article_id", F.lit("t").alias("canonical_title"), F.lit("v1").alias("clustering_version"))
    stories = BucketTable(spark, f"{shared_folder(spark)}/loomline-steps/stories-{uuid.uuid4().hex}", "story_id", 8)
    persistence.commit_seeds(stories, story.where("o_custkey % 3 < 2").drop("o_custkey"), writer="a", batch=0)
    later = story.where("o_custkey % 3 > 0").withColumn("canonical_title", F.when(c % 5 == 2, "other").otherwise("t")).drop("o_custkey")
    return persistence.commit_seeds(stories, later, writer="b", batch=0).withColumn("differs", F.array_join("differs", ","))


def upsert_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in two batches, the later events first: older retries lower the first time and overwrite nothing."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("canonical_url"), F.col("ts").cast("timestamp").alias("discovered_at"), F.col("event_id").alias("seq"), "event_type", "value")
    cut = F.timestamp_millis(F.lit(NOW_MS))
    late = articles.upsert(events.where(F.col("discovered_at") >= cut), payload=["event_type", "value"])
    out = articles.upsert(events.where(F.col("discovered_at") < cut), late, payload=["event_type", "value"])
    return out.select("canonical_url", F.unix_millis("first_discovered_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), "event_type", "value")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    origin = F.element_at(F.array(*map(F.lit, ("gnews", "rss", "payload", "unsupported", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("timeout", "network", "http", "invalid-json", "invalid-xml", "blocked-url", "response-too-large"))), (F.col("user_id") % 7 + 1).cast("int"))
    status = F.when(F.col("event_id") % 11 != 0, F.element_at(F.array(*map(F.lit, (404, 408, 429, 500, 502, 504, 521))), (F.floor(F.col("event_id") / 5) % 7 + 1).cast("int")))
    known = F.col("event_id") % 13 != 0
    return e.select("event_id", research.discovery_failure(origin, kind, status).alias("d"), research.search_error(known, kind, status).alias("s"), research.fetch_error(known, kind, status).alias("f")).select("event_id", "d.reason", "d.retryable", F.col("s.code").alias("search_code"), F.col("s.retryable").alias("search_retryable"), F.col("f.code").alias("fetch_code"), F.col("f.retryable").alias("fetch_retryable"))


def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = ("click", "view", "purchase", "signup", "error")
    return metrics.counters(e, "user_id", {f"n_{k}": F.col("event_type") == k for k in kinds} | {"n_large": F.col("value") > 20})


def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = metrics.histogram(e.withColumn("seconds", F.col("cents") / 400), "event_type", "seconds")
    return out.select("event_type", "le", "count", "total", F.round("sum", 4).alias("sum_seconds"))


def evaluation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalization_outcomes(spark, sf_dir)
    expected = F.expr("element_at(array('missing-title','invalid-article-shape','missing-url','invalid-url','invalid-published-at','invalid-article-shape','invalid-article-shape'), cast(page_id % 10 + 1 as int))")
    rows = out.select((F.concat(F.lit("case-"), (F.col("page_id") % 10).cast("string"))).alias("stage"), F.lit(True).alias("applicable"), F.when(F.col("page_id") % 10 < 7, F.col("reject_reason").eqNullSafe(expected)).otherwise(F.col("reject_reason").isNull()).alias("correct"))
    return evaluation.stage_accuracy(rows)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(title_tokens(F.col("text")), "|").alias("tokens"), at_ms(F.col("doc_id")).alias("at_ms"))


QUERIES = {
    "normalize_text": norm_text, "canonical_url": canonical_url, "page_text": page_text, "url_safety": url_safety_classes, "content_types": content_types, "normalization_outcomes": normalization_outcomes,
    "feed_articles": feed_articles, "gnews_articles": gnews_articles, "search_queries": search_queries, "freshness_classes": freshness_classes, "freshness_counts": freshness_counts, "dedup_keys": dedup_keys,
    "ordered_dedup": ordered_dedup, "article_upsert": article_upsert, "bucket_upsert": bucket_upsert, "seed_commits": seed_commits, "upsert_incremental": upsert_incremental, "failure_classification": failure_classes, "discovery_counters": discovery_counters,
    "duration_histogram": duration_histogram, "evaluation_accuracy": evaluation_accuracy, "title_tokens": tokens,
}

COLLAPSE = f"trim(regexp_replace(nfc_normalize(text), '{WS}', ' ', 'g'))"
PAGE = """trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '&#39;', ''''), '%s', ' ', 'g'))""" % WS
CANONICAL = """split_part(url, '#', 1) AS url, split_part(split_part(url, '#', 1), '?', 1) AS base,
  list_filter(string_split(CASE WHEN contains(split_part(url, '#', 1), '?') THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END, '&'),
    lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid')) AS params"""
FRESH = "CASE WHEN age < -86400000 THEN 'future-published-at' WHEN age > 604800000 THEN 'stale' ELSE 'fresh' END"
KIND = "['timeout', 'network', 'http', 'invalid-json', 'invalid-xml', 'blocked-url', 'response-too-large'][user_id % 7 + 1]"

SQL = {
    "normalize_text": f"SELECT doc_id, md5(nullif({COLLAPSE}, '')) AS text_md5, length(nullif({COLLAPSE}, '')) AS n FROM documents",
    "canonical_url": f"WITH p AS (SELECT page_id, {CANONICAL} FROM pages) SELECT page_id, url, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END AS canonical_url FROM p",
    "page_text": f"WITH p AS (SELECT page_id, {PAGE} AS t FROM pages) SELECT page_id, CASE WHEN t = '' THEN 'unsupported-content' ELSE 'ok' END AS status, CASE WHEN t <> '' THEN md5(substr(t, 1, 16000)) END AS text_md5, length(t) > 16000 AS truncated FROM p",
    "url_safety": """
SELECT page_id, CASE WHEN page_id % 5 IN (0, 2) THEN 'blocked' WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 224 + 1 IN (10, 127) OR page_id % 224 + 1 >= 224 THEN 'blocked' ELSE 'public' END ELSE 'lookup' END AS safety FROM pages""",
    "content_types": "SELECT event_id, 'text/' || event_type AS media_type FROM events",
    "normalization_outcomes": f"""
WITH p AS (SELECT page_id, {CANONICAL} FROM pages), r AS (
  SELECT *, CASE WHEN page_id % 30 = 8 THEN 'invalid-source' ELSE
    ['missing-title', 'invalid-article-shape', 'missing-url', 'invalid-url', 'invalid-published-at', 'invalid-article-shape', 'invalid-article-shape'][page_id % 10 + 1] END AS reject_reason FROM p)
SELECT page_id, reject_reason, CASE WHEN reject_reason IS NULL THEN 't ' || page_id END AS title,
  CASE WHEN reject_reason IS NULL THEN base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END AS canonical_url,
  CASE WHEN reject_reason IS NULL THEN epoch_ms(CASE WHEN page_id % 10 = 7 THEN TIMESTAMP '2024-01-02 02:04:05' ELSE TIMESTAMP '2024-01-02 03:04:05' END) END AS published_ms,
  CASE WHEN reject_reason IS NULL AND page_id % 10 > 7 THEN 'P' END AS publisher_name FROM r""",
    "feed_articles": """
WITH p AS (SELECT page_id, url, page_id % 3 AS k FROM pages)
SELECT page_id, NULL AS error, 0 AS pos, 'g' || page_id AS external_id, 'T ' || page_id AS title, url, 'c' AS category, 'Feed ' || page_id AS publisher_name, CASE k WHEN 0 THEN 'rss' ELSE 'atom' END AS feed_format FROM p WHERE k < 2
UNION ALL SELECT page_id, NULL, 1, NULL, 'second', NULL, NULL, 'Feed ' || page_id, 'rss' FROM p WHERE k = 0
UNION ALL SELECT page_id, 'invalid-xml', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k = 2""",
    "gnews_articles": """
WITH p AS (SELECT page_id, url, page_id % 4 AS k FROM pages)
SELECT page_id, NULL AS error, k > 2 AS truncated, pos, CAST(page_id AS VARCHAR) AS external_id, url, CASE WHEN page_id % 2 = 0 THEN 'd' END AS summary, 'S' AS publisher_name FROM p, (VALUES (0), (1)) v(pos) WHERE k > 1
UNION ALL SELECT page_id, CASE k WHEN 0 THEN 'invalid-json' ELSE 'invalid-response' END, false, NULL, NULL, NULL, NULL, NULL FROM p WHERE k < 2""",
    "search_queries": f"WITH q AS (SELECT item_id, trim(regexp_replace(replace('  $' || text || '$' || chr(9), '$', ' '), '{WS}', ' ', 'g')) AS q FROM benchmark) SELECT item_id, CASE WHEN length(q) BETWEEN 1 AND 200 THEN q END AS query FROM q",
    "freshness_classes": f"""
WITH e AS (SELECT event_id, event_type, {NOW_MS} - epoch_us(ts) // 1000 AS age FROM events)
SELECT event_id, event_type <> 'error' AND ({FRESH}) = 'fresh' AS accepted, CASE WHEN event_type = 'error' THEN 'missing-published-at' ELSE {FRESH} END AS classification,
  CASE WHEN event_type <> 'error' THEN 'published-at' END AS timestamp_basis, CASE WHEN event_type <> 'error' THEN age END AS age_ms FROM e""",
    "freshness_counts": f"WITH e AS (SELECT event_type, {NOW_MS} - epoch_us(ts) // 1000 AS age FROM events) SELECT {FRESH} AS classification, CASE WHEN event_type = 'error' THEN 'discovered-at' ELSE 'published-at' END AS timestamp_basis, count(*) AS articles FROM e GROUP BY ALL",
    "dedup_keys": r"""
WITH d AS (SELECT doc_id, lower(source) AS s, text, lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(string_split(text, chr(10))[-1], '\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, 0 AS priority, 'source-external-id' AS type, md5(s || ':' || x) AS value_md5 FROM d WHERE length(text) > 0
UNION ALL SELECT doc_id, 1, 'canonical-url', md5(md5(text)) FROM d
UNION ALL SELECT doc_id, 2, 'publisher-title', md5(s || ':' || t) FROM d""",
    "ordered_dedup": r"""
WITH RECURSIVE k AS (
  SELECT doc_id, ['source-external-id', 'canonical-url', 'publisher-title'] AS types, [lower(source) || ':' || lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))), md5(text), lower(source) || ':' || lower(trim(regexp_replace(string_split(text, chr(10))[-1], '\s+', ' ', 'g')))] AS vals FROM documents
), d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, types, vals, [hash(types[i] || ':' || vals[i]) FOR i IN range(1, 4)] AS keys FROM k
), fold AS (
  SELECT 0::BIGINT AS k, []::UBIGINT[] AS held, []::BIGINT[] AS owners, 0 AS hit, NULL::BIGINT AS original
  UNION ALL
  SELECT k, CASE WHEN hit = 0 THEN held || keys ELSE held END, CASE WHEN hit = 0 THEN owners || [doc_id, doc_id, doc_id] ELSE owners END, hit, CASE WHEN hit > 0 THEN owners[found[hit]] END
  FROM (
    SELECT *, CASE WHEN found[1] > 0 THEN 1 WHEN found[2] > 0 THEN 2 WHEN found[3] > 0 THEN 3 ELSE 0 END AS hit
    FROM (SELECT d.k, d.doc_id, d.keys, f.held, f.owners, [coalesce(list_position(f.held, d.keys[1]), 0), coalesce(list_position(f.held, d.keys[2]), 0), coalesce(list_position(f.held, d.keys[3]), 0)] AS found FROM fold f JOIN d ON d.k = f.k + 1)
  )
)
SELECT doc_id, CASE WHEN hit = 0 THEN 'unique' ELSE 'duplicate' END AS status, CASE WHEN hit > 0 THEN types[hit] END AS reason, CASE WHEN hit > 0 THEN md5(vals[hit]) END AS key_md5, original
FROM fold JOIN d USING (k) WHERE k > 0""",
    "article_upsert": """
WITH e AS (SELECT event_type || '/' || user_id AS canonical_url, epoch_ms(date_trunc('hour', ts)) AS t, event_id AS seq, value, props FROM events)
SELECT canonical_url, min(t) AS first_ms, max(t) AS last_ms, min(seq) AS first_seq, arg_max(seq, (t, seq)) AS last_seq, arg_max(value, (t, seq)) AS value, arg_max(props, (t, seq)) AS props FROM e GROUP BY 1""",
    "upsert_incremental": """
SELECT CAST(user_id AS VARCHAR) AS canonical_url, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""",
    "failure_classification": f"""
WITH e AS (SELECT event_id, ['gnews', 'rss', 'payload', 'unsupported', 'other'][event_id % 5 + 1] AS origin, {KIND} AS kind,
    CASE WHEN event_id % 11 <> 0 THEN [404, 408, 429, 500, 502, 504, 521][event_id // 5 % 7 + 1] END AS status, event_id % 13 <> 0 AS known FROM events
), c AS (SELECT *, CASE
    WHEN origin IN ('gnews', 'rss') THEN CASE kind WHEN 'timeout' THEN 'source-timeout' WHEN 'network' THEN 'source-network'
      WHEN 'http' THEN CASE WHEN status IS NULL OR status IN (408, 429) OR status >= 500 THEN 'source-http-retryable' ELSE 'source-http-terminal' END
      ELSE CASE WHEN (origin, kind) IN (('gnews', 'invalid-json'), ('rss', 'invalid-xml')) THEN 'source-invalid-payload' ELSE 'unknown' END END
    WHEN origin = 'payload' THEN 'invalid-job-payload' WHEN origin = 'unsupported' THEN 'unsupported-source' ELSE 'unknown' END AS reason,
  CASE WHEN NOT known THEN 'tool-failed' WHEN kind = 'timeout' THEN 'timeout' WHEN kind = 'network' THEN 'unavailable' WHEN kind = 'invalid-json' THEN 'invalid-result'
    WHEN kind = 'http' THEN CASE WHEN status = 429 THEN 'rate-limited' WHEN status IN (502, 503, 504) THEN 'unavailable' ELSE 'tool-failed' END ELSE 'tool-failed' END AS search_code,
  CASE WHEN NOT known THEN 'tool-failed' WHEN kind = 'timeout' THEN 'timeout' WHEN kind = 'network' THEN 'unavailable' WHEN kind = 'blocked-url' THEN 'blocked-url' WHEN kind = 'response-too-large' THEN 'unsupported-content'
    WHEN kind = 'http' THEN CASE WHEN status IN (408, 504) THEN 'timeout' WHEN status = 429 THEN 'rate-limited' WHEN status IN (502, 503, 521, 522, 523, 524) THEN 'unavailable' ELSE 'tool-failed' END ELSE 'tool-failed' END AS fetch_code FROM e)
SELECT event_id, reason, reason IN ('source-timeout', 'source-network', 'source-http-retryable', 'unknown') AS retryable, search_code, search_code IN ('timeout', 'unavailable', 'rate-limited') AS search_retryable,
  fetch_code, fetch_code IN ('timeout', 'unavailable', 'rate-limited') AS fetch_retryable FROM c""",
    "discovery_counters": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("click", "view", "purchase", "signup", "error")) + ", count(*) FILTER (value > 20) AS n_large FROM events GROUP BY 1",
    "duration_histogram": """
WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) / 400 AS s FROM events), b(le, bound) AS (VALUES ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30), ('+Inf', 1e300))
SELECT event_type, le, count(*) FILTER (s <= bound) AS count, count(*) AS total, round(sum(s), 4) AS sum_seconds FROM e, b GROUP BY ALL""",
    "evaluation_accuracy": """
SELECT 'case-' || page_id % 10 AS stage, count(*) AS evaluated, count(*) FILTER (page_id % 30 <> 8) AS correct, count(*) FILTER (page_id % 30 <> 8) / count(*) AS accuracy FROM pages GROUP BY 1""",
    "title_tokens": r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*'), '|') AS tokens, CASE WHEN doc_id % 17 <> 0 THEN 1704067200000 + doc_id * 600000 END AS at_ms FROM documents",
}
SQL["bucket_upsert"] = SQL["article_upsert"]  # whatever the batches and writers
SQL["seed_commits"] = """
SELECT 's' || o_custkey AS story_id, CASE WHEN o_custkey % 3 = 2 THEN 'new' WHEN o_custkey % 5 = 2 THEN 'conflict' ELSE 'replayed' END AS outcome,
  CASE WHEN o_custkey % 3 = 1 AND o_custkey % 5 = 2 THEN 'title' ELSE '' END AS differs FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey"""
