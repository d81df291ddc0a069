"""Queries of research capabilities, replays, embedding batches, jobs, public views and story corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.urls import normal_forms
from loomline.operators import capabilities
from loomline.plans.common import table
from loomline.plans.ingest import PAGE


def search_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages to a query, as in search_candidates; pages whose number ends in two are in the catalog."""
    p = table(spark, sf_dir, "pages").withColumn("q", F.floor(F.col("page_id") / 10))
    rows = p.join(p.where("page_id % 10 = 0").select("q", F.col("url").alias("first_url")), "q", "left")
    url = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 11 == 0, F.col("first_url")).otherwise(F.col("url"))
    articles = rows.select(F.col("q").alias("query_id"), F.col("page_id").alias("pos"), url.alias("url"), F.concat(F.lit(" A  title "), F.col("page_id").cast("string")).alias("title"), F.lit("P").alias("publisher"), F.lit("2024-01-02T03:04:05Z").alias("published"), F.lit(" an  excerpt ").alias("summary"))
    canonical = normal_forms(F.col("url"))["canonical_url"].alias("canonical_url")
    excluded = p.where("page_id % 10 = 1").select(F.col("q").alias("query_id"), canonical)
    catalog = p.where("page_id % 10 = 2").select(F.col("q").alias("query_id"), canonical, F.concat(F.lit("story_"), F.col("page_id").cast("string")).alias("source_id"))
    return capabilities.search_sources(articles, excluded, catalog, 5).drop("url")


def fetch_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask for pages by source id in ten runs; some pages failed to load."""
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "pages")
    n = p.agg(F.max("page_id") + 1).first()[0] or 1  # every page is asked for where there are events enough
    requests = e.select((F.col("user_id") % 10).alias("run_id"), F.col("event_id").alias("call_id"), F.concat(F.lit("src_"), (F.col("event_id") % n).cast("string")).alias("source_id"))
    catalog = p.select((F.col("page_id") % 10).alias("run_id"), F.concat(F.lit("src_"), F.col("page_id").cast("string")).alias("source_id"), "url")
    one = p.where("page_id % 9 <> 4").groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    k = F.col("page_id") % 8
    fetched = one.select("url", "html", F.timestamp_seconds(F.col("page_id") + 1_704_067_200).alias("fetched_at"), (k != 3).alias("known"), F.when(k == 1, "timeout").when(k == 2, "http").when(k == 3, "http").alias("kind"), F.when(k == 2, 429).when(k == 3, 500).alias("status"))
    out = capabilities.fetch_articles(requests, catalog, fetched)
    return out.select("run_id", "call_id", "source_id", "status", "code", "retryable", F.md5("text").alias("text_md5"), "fetched_at", "truncated")


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order as the seed of a story."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("seed"))


def seed_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' stories written again: some were never there, some differ in one field."""
    c = F.col("o_custkey")
    rows = _firsts(spark, sf_dir).select(c, F.col("seed"), F.concat(F.lit("s"), c.cast("string")).alias("story_id"), F.lit("v1").alias("version"))
    inputs = rows.select("story_id", F.col("seed").alias("seed_article_id"), F.concat(F.lit("t"), (c % 5).cast("string")).alias("canonical_title"), F.col("version").alias("clustering_version"))
    stories = rows.where("o_custkey % 6 <> 5").select("story_id", (F.col("seed") + F.when(c % 13 == 1, 1).otherwise(0)).alias("seed_article_id"), F.col("seed").alias("representative_article_id"), F.when(c % 7 == 2, "other").otherwise(F.concat(F.lit("t"), (c % 5).cast("string"))).alias("canonical_title"), F.col("version").alias("clustering_version"))
    members = rows.where("o_custkey % 11 <> 3").select("story_id", F.col("seed").alias("article_id"), F.when(c % 9 == 4, "MATCHED").otherwise("SEED").alias("kind"), F.when(c % 8 == 0, "v0").otherwise("v1").alias("clustering_version"))
    out = capabilities.seed_replays(inputs, stories, members)
    return out.withColumn("differs", F.array_join("differs", ","))


def matched_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of their customers' stories, written again; signals are JSON whose keys come in another order."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("article_id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("story_id"), F.lit(0.75).alias("score"), F.lit("r").alias("reason"), F.col("o_custkey").alias("matched_against_article_id"), F.lit("v1").alias("clustering_version"))
    a = F.col("article_id")
    inputs = o.withColumn("signals", F.concat(F.lit('{"b": {"y": 2, "x": 1}, "a": '), (a % 3).cast("string"), F.lit("}")))
    stored = o.where("article_id % 6 <> 1").withColumns({"kind": F.when(a % 10 == 2, "SEED").otherwise("MATCHED"), "score": F.when(a % 7 == 3, 0.5).otherwise(F.col("score")), "reason": F.when(a % 11 == 4, F.lit(None)).otherwise(F.col("reason")), "signals": F.concat(F.lit('{"a":'), (F.when(a % 13 == 5, 9).otherwise(a % 3)).cast("string"), F.lit(',"b":{"x":1,"y":2}}'))})
    out = capabilities.matched_replays(inputs, stored)
    return out.withColumn("differs", F.array_join("differs", ","))


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors to a batch, with some of every fault."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.floor(v / 50).alias("batch_id"), (v % 50).alias("pos"), v, F.col("embedding").cast("array<double>").alias("embedding"))
    requests = e.where("vec_id % 97 <> 5").select("batch_id", "pos", F.when(v % 41 == 7, " ").otherwise(F.concat(F.lit("a"), F.when(v % 29 == 3, v - 1).otherwise(v).cast("string"))).alias("id"), F.when(v % 37 == 2, "").otherwise("text").alias("text"))
    some = e.where("vec_id % 31 <> 8")
    given = some.unionByName(some.where("vec_id % 43 = 1"))
    broken = F.when(v % 53 == 4, F.array().cast("array<double>")).when(v % 47 == 6, F.array(F.lit(1.0), F.lit(float("nan")))).when(v % 59 == 9, F.array(F.lit(1.0), F.lit(None).cast("double"))).otherwise(F.col("embedding"))
    return capabilities.embedding_violations(requests, given.select("batch_id", "pos", broken.alias("embedding")))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the attempts of a job."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "error").alias("retryable"), F.col("event_type").alias("reason"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return capabilities.job_states(rows)


def article_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    at = lambda add: F.timestamp_millis(F.lit(1_704_067_200_000) + k * 1000 + add)
    rows = p.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.lit("T").alias("title"), F.col("url"), F.col("url").alias("canonical_url"), F.lit("s").alias("source_id"), F.lit("Source").alias("source_name"), F.when(k % 2 == 0, "rss").otherwise("api").alias("source_type"),
        F.when(k % 3 == 0, "pid").alias("publisher_id"), F.when(k % 5 != 0, "P").alias("publisher_name"), F.when(k % 7 != 0, at(5)).alias("published_at"), at(50).alias("first_discovered_at"), at(500).alias("last_seen_at"), F.lit(None).cast("string").alias("author"), F.lit("sum").alias("summary"), F.lit(None).cast("string").alias("category"),
    )
    return capabilities.article_view(rows)


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds)


def _stories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stories, their orders as members; the first order is the seed."""
    o = table(spark, sf_dir, "orders")
    seeds = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("seed"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    id_of = lambda letter, key: F.concat(F.lit(letter), key.cast("string"))
    stories = table(spark, sf_dir, "customer").join(seeds.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").select(
        id_of("s", c).alias("id"), id_of("t", c % 5).alias("canonical_title"), id_of("a", F.col("seed")).alias("seed_article_id"), id_of("a", F.col("seed")).alias("representative_article_id"), F.lit("v1").alias("clustering_version"),
        F.when(c % 3 > 0, _at(c)).alias("first_published_at"), F.when(c % 3 > 0, _at(c + 9)).alias("last_published_at"), _at(c + 1).alias("created_at"), _at(c + 2).alias("updated_at"),
    )
    matched = F.col("seed") != k
    members = o.join(seeds, "o_custkey").select(
        id_of("m", k).alias("id"), id_of("s", F.col("o_custkey")).alias("story_id"), id_of("a", k).alias("article_id"), F.when(matched, "MATCHED").otherwise("SEED").alias("kind"), F.when(matched, F.lit(0.75)).alias("score"),
        F.when(matched, F.concat(F.lit('{"b": [1, null], "a": '), (k % 3).cast("string"), F.lit("}"))).alias("signals"), F.when(matched, F.lit('say "so"')).alias("reason"), F.when(matched, id_of("a", F.col("seed"))).alias("matched_against_article_id"),
        F.lit("v1").alias("clustering_version"), _at(k % 4).alias("created_at"),
    )
    return stories, members


def story_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories, members = _stories(spark, sf_dir)
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://e.org/"), k.cast("string"))
    articles = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a"), k.cast("string")).alias("id"), F.lit("T").alias("title"), url.alias("url"), url.alias("canonical_url"), F.lit("s").alias("source_id"), F.lit("Source").alias("source_name"), F.lit("rss").alias("source_type"),
        F.lit(None).cast("string").alias("publisher_id"), F.when(k % 5 > 0, "P").alias("publisher_name"), F.when(k % 7 > 0, _at(k % 100)).alias("published_at"), _at(k % 50).alias("first_discovered_at"), _at(k % 60).alias("last_seen_at"),
    )
    return capabilities.story_view(stories, members, articles)


def story_list_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capabilities.story_list_view(*_stories(spark, sf_dir))


def research_run_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs in several states."""
    k = F.col("event_id")
    done = k % 4 == 0
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("story_id"), F.when(done, "COMPLETED").when(k % 4 == 1, "RUNNING").otherwise("PENDING").alias("status"),
        F.when(k % 3 > 0, F.lit("a\tgoal")).alias("research_goal"), F.lit('{"maxToolCalls": 3, "maxModelCalls": 2}').alias("budget"), F.when(done, "INSUFFICIENT_SOURCES").alias("outcome"), F.when(done, "TOOL_BUDGET_EXHAUSTED").alias("stop_reason"),
        F.when(done, F.lit('{"sourceIds": ["x", "y"]}')).alias("selection"), (k % 3).alias("model_calls"), (k % 5).alias("tool_calls"), F.when(k % 4 < 2, _at(k)).alias("started_at"), F.when(done, _at(k + 5)).alias("completed_at"), _at(k - 1).alias("created_at"), _at(k + 6).alias("updated_at"),
    )
    return capabilities.research_run_view(rows)


def story_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors to a scenario, clustered by label, with some damage of every kind."""
    v = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.floor(v / 50).alias("scenario_id"), v, F.col("label").alias("cluster_id"))
    one = e.select("scenario_id").distinct()
    scenarios = one.unionByName(one.where("scenario_id % 4 = 1"))
    articles = e.where("scenario_id % 7 <> 3").select("scenario_id", (v - F.when(v % 45 == 9, 1).otherwise(0)).alias("article_id"), F.concat(F.lit("u"), (v - F.when(v % 33 == 5, 1).otherwise(0)).cast("string")).alias("canonical_url"))
    some = e.where("scenario_id % 8 <> 5 AND vec_id % 31 <> 0").select("scenario_id", "cluster_id", F.when(v % 41 == 7, v + 1_000_000).otherwise(v).alias("article_id"))
    return capabilities.story_corpus_violations(scenarios, articles, some.unionByName(some.where("article_id % 37 = 2")))


QUERIES = {
    "search_capability": search_capability, "fetch_capability": fetch_capability, "seed_replays": seed_replays, "matched_replays": matched_replays,
    "embedding_batches": embedding_batches, "job_states": job_states, "article_views": article_views, "story_views": story_views, "story_list_views": story_list_views,
    "research_run_views": research_run_views, "story_corpus": story_corpus,
}

NORMAL = "replace(replace(replace(split_part({0}, '#', 1), '?utm_source=feed&', '?'), '?utm_source=feed', ''), '&utm_source=feed', '')"

def _iso(seconds: str) -> str:
    return f"""strftime(make_timestamp((1704067200 + {seconds}) * 1000000), '"%Y-%m-%dT%H:%M:%S.000Z"')"""


HEAD = f"""'{{"id":"s' || c || '","canonicalTitle":"t' || c % 5 || '","seedArticleId":' || coalesce('"a' || seed || '"', 'null') || ',"representativeArticleId":' || coalesce('"a' || seed || '"', 'null') || ',"clusteringVersion":"v1","firstPublishedAt":'
  || CASE WHEN c % 3 > 0 THEN {_iso("c")} ELSE 'null' END || ',"lastPublishedAt":' || CASE WHEN c % 3 > 0 THEN {_iso("c + 9")} ELSE 'null' END"""
DATES = f"""',"createdAt":' || {_iso("c + 1")} || ',"updatedAt":' || {_iso("c + 2")}"""
SEEDS = "WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS seed, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_custkey AS c, seed, coalesce(n, 0) AS n FROM customer LEFT JOIN f ON c = c_custkey)"

SQL = {
    "story_views": f"""{SEEDS},
o AS (SELECT o_orderkey AS k, c, seed, o_orderkey <> seed AS matched FROM orders JOIN f ON c = o_custkey),
m AS (SELECT c, k, '{{"id":"m' || k || '","kind":"' || CASE WHEN matched THEN 'MATCHED","score":0.75,"signals":{{"a":' || k % 3 || ',"b":[1,null]}},"reason":"say \\"so\\"","matchedAgainstArticleId":"a' || seed || '"' ELSE 'SEED","score":null,"signals":null,"reason":null,"matchedAgainstArticleId":null' END
  || ',"clusteringVersion":"v1","createdAt":' || {_iso("k % 4")} || ',"article":{{"id":"a' || k || '","title":"T","url":"https://e.org/' || k || '","canonicalUrl":"https://e.org/' || k || '","source":{{"id":"s","name":"Source","type":"rss"}},"publisher":' || CASE WHEN k % 5 > 0 THEN '{{"id":null,"name":"P"}}' ELSE 'null' END
  || ',"publishedAt":' || CASE WHEN k % 7 > 0 THEN {_iso("k % 100")} ELSE 'null' END || ',"firstDiscoveredAt":' || {_iso("k % 50")} || ',"lastSeenAt":' || {_iso("k % 60")} || '}}}}' AS m FROM o),
l AS (SELECT c, string_agg(m, ',' ORDER BY k % 4, 'a' || k) AS l FROM m GROUP BY 1)
SELECT 's' || c AS id, {HEAD} || {DATES} || ',"memberships":[' || coalesce(l, '') || ']}}' AS view FROM s LEFT JOIN l USING (c)""",
    "story_list_views": f"""{SEEDS} SELECT 's' || c AS id, {HEAD} || ',"membershipCount":' || n || {DATES} || '}}' AS view FROM s""",
    "research_run_views": f"""WITH e AS (SELECT event_id AS k, user_id AS u FROM events)
SELECT 'r' || k AS id, '{{"id":"r' || k || '","storyId":"s' || u || '","status":"' || CASE k % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' ELSE 'PENDING' END || '","researchGoal":' || CASE WHEN k % 3 > 0 THEN '"a\\tgoal"' ELSE 'null' END || ',"budget":{{"maxModelCalls":2,"maxToolCalls":3}},'
  || CASE WHEN k % 4 = 0 THEN '"outcome":"insufficient-sources","stopReason":"tool-budget-exhausted","selection":{{"sourceIds":["x","y"]}}' ELSE '"outcome":null,"stopReason":null,"selection":null' END || ',"modelCalls":' || k % 3 || ',"toolCalls":' || k % 5
  || ',"startedAt":' || CASE WHEN k % 4 < 2 THEN {_iso("k")} ELSE 'null' END || ',"completedAt":' || CASE WHEN k % 4 = 0 THEN {_iso("k + 5")} ELSE 'null' END || ',"createdAt":' || {_iso("k - 1")} || ',"updatedAt":' || {_iso("k + 6")} || '}}' AS view FROM e""",
    "search_capability": f"""
WITH p AS (SELECT page_id, page_id // 10 AS q, url FROM pages), f AS (SELECT q, url AS first_url FROM p WHERE page_id % 10 = 0),
r AS (SELECT q, page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN first_url ELSE url END AS url FROM p LEFT JOIN f USING (q)),
n AS (SELECT q, page_id, {NORMAL.format("url")} AS u FROM r),
x AS (SELECT n.q, n.page_id, n.u, e.u IS NOT NULL AS excluded FROM n LEFT JOIN (SELECT q, {NORMAL.format("url")} AS u FROM p WHERE page_id % 10 = 1) e ON e.q = n.q AND e.u = n.u),
k AS (SELECT *, u IS NOT NULL AND NOT excluded AND row_number() OVER (PARTITION BY q, u, excluded ORDER BY page_id) = 1 AS fresh FROM x),
h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) - 1 AS pos FROM k WHERE fresh), c AS (SELECT q, {NORMAL.format("url")} AS u, 'story_' || page_id AS known FROM p WHERE page_id % 10 = 2)
SELECT h.q AS query_id, pos, coalesce(known, 'tool_' || h.q || '_' || pos) AS source_id, known IS NOT NULL AS reused, 'A title ' || page_id AS title, 'P' AS publisher_name, '2024-01-02T03:04:05.000Z' AS published_at, 'an excerpt' AS excerpt
FROM h LEFT JOIN c ON c.q = h.q AND c.u = h.u WHERE pos < 5""",
    "fetch_capability": f"""
WITH r AS (SELECT user_id % 10 AS run_id, event_id AS call_id, event_id % (SELECT coalesce(max(page_id) + 1, 1) FROM pages) AS page_id FROM events),
f AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS k FROM pages WHERE page_id % 9 <> 4 GROUP BY 1), t AS (SELECT url, k, {PAGE} AS t FROM f),
x AS (SELECT r.run_id, r.call_id, r.page_id, t.t, t.k, CASE WHEN p.url IS NULL THEN 'unknown-source' WHEN t.k IS NULL THEN 'unavailable' WHEN k % 8 = 1 THEN 'timeout' WHEN k % 8 = 2 THEN 'rate-limited' WHEN k % 8 = 3 THEN 'tool-failed' WHEN t = '' THEN 'unsupported-content' END AS code
  FROM r LEFT JOIN pages p ON p.page_id = r.page_id AND p.page_id % 10 = r.run_id LEFT JOIN t ON t.url = p.url)
SELECT run_id, call_id, 'src_' || page_id AS source_id, CASE WHEN code IS NULL THEN 'ok' ELSE 'error' END AS status, code, CASE WHEN code IS NOT NULL THEN code IN ('unavailable', 'timeout', 'rate-limited') END AS retryable,
  CASE WHEN code IS NULL THEN md5(substr(t, 1, 16000)) END AS text_md5, CASE WHEN code IS NULL THEN strftime(make_timestamp((1704067200 + k) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') END AS fetched_at, CASE WHEN code IS NULL THEN length(t) > 16000 END AS truncated FROM x""",
    "seed_replays": """
WITH o AS (SELECT o_custkey AS c, min(o_orderkey) AS seed FROM orders GROUP BY 1)
SELECT 's' || c AS story_id, CASE WHEN c % 6 = 5 THEN 'new' WHEN c % 13 = 1 OR c % 7 = 2 OR c % 11 = 3 OR c % 9 = 4 OR c % 8 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome,
  CASE WHEN c % 6 = 5 THEN '' ELSE concat_ws(',', CASE WHEN c % 13 = 1 THEN 'seed' END, CASE WHEN c % 7 = 2 THEN 'title' END,
    CASE WHEN c % 11 = 3 THEN 'membership,membership-story,membership-kind,membership-version' ELSE nullif(concat_ws(',', CASE WHEN c % 9 = 4 THEN 'membership-kind' END, CASE WHEN c % 8 = 0 THEN 'membership-version' END), '') END) END AS differs FROM o""",
    "matched_replays": """
WITH o AS (SELECT o_orderkey AS a FROM orders)
SELECT a AS article_id, CASE WHEN a % 6 = 1 THEN '' ELSE concat_ws(',', CASE WHEN a % 10 = 2 THEN 'kind' END, CASE WHEN a % 7 = 3 THEN 'score' END, CASE WHEN a % 11 = 4 THEN 'reason' END, CASE WHEN a % 13 = 5 THEN 'signals' END) END AS differs,
  CASE WHEN a % 6 = 1 THEN 'new' WHEN differs = '' THEN 'replayed' ELSE 'conflict' END AS outcome FROM o""",
    "embedding_batches": """
WITH e AS (SELECT vec_id AS v, vec_id // 50 AS batch_id, vec_id % 50 AS pos, embedding FROM embeddings),
r AS (SELECT *, CASE WHEN v % 41 = 7 THEN ' ' ELSE 'a' || CASE WHEN v % 29 = 3 THEN v - 1 ELSE v END END AS id FROM e WHERE v % 97 <> 5),
s AS (SELECT * FROM e WHERE v % 31 <> 8), g AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE v % 43 = 1)
SELECT batch_id, 'id-blank' AS rule, CAST(pos AS VARCHAR) AS key FROM r WHERE trim(id) = '' UNION ALL SELECT batch_id, 'text-blank', CAST(pos AS VARCHAR) FROM r WHERE v % 37 = 2
UNION ALL SELECT batch_id, 'id-once', id FROM r WHERE trim(id) <> '' GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT batch_id, 'request-answered', CAST(pos AS VARCHAR) FROM r WHERE v % 31 = 8 UNION ALL SELECT batch_id, 'answer-asked-for', CAST(pos AS VARCHAR) FROM s WHERE v % 97 = 5
UNION ALL SELECT batch_id, 'answered-once', CAST(pos AS VARCHAR) FROM s WHERE v % 43 = 1
UNION ALL SELECT batch_id, 'embedding-empty', CAST(pos AS VARCHAR) FROM g WHERE v % 53 = 4 UNION ALL SELECT batch_id, 'embedding-finite', CAST(pos AS VARCHAR) FROM g WHERE v % 53 <> 4 AND (v % 47 = 6 OR v % 59 = 9)""",
    "job_states": """
WITH a AS (SELECT user_id AS job_id, event_type AS reason, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
s AS (SELECT *, CASE WHEN reason = 'purchase' THEN 'completed' WHEN reason = 'error' OR nth >= 3 THEN 'failed' ELSE 'waiting' END AS state FROM a),
l AS (SELECT job_id, coalesce(min(nth) FILTER (state <> 'waiting'), max(nth)) AS nth FROM s GROUP BY 1)
SELECT job_id, nth AS attempts, state, CASE WHEN state <> 'completed' THEN reason END AS reason, CASE WHEN state = 'waiting' THEN at_ms + 1000 * CAST(2 ** (nth - 1) AS BIGINT) END AS retry_at_ms FROM s JOIN l USING (job_id, nth)""",
    "article_views": """
WITH p AS (SELECT page_id AS k, url, strftime(make_timestamp((1704067200 + page_id) * 1000000), '"%Y-%m-%dT%H:%M:%S.') AS t FROM pages)
SELECT 'p' || k AS id, '{"id":"p' || k || '","title":"T","url":"' || url || '","canonicalUrl":"' || url || '","source":{"id":"s","name":"Source","type":"' || CASE WHEN k % 2 = 0 THEN 'rss' ELSE 'api' END || '"},"publisher":'
  || CASE WHEN k % 5 = 0 THEN 'null' ELSE '{"id":' || CASE WHEN k % 3 = 0 THEN '"pid"' ELSE 'null' END || ',"name":"P"}' END || ',"publishedAt":' || CASE WHEN k % 7 = 0 THEN 'null' ELSE t || '005Z"' END
  || ',"firstDiscoveredAt":' || t || '050Z","lastSeenAt":' || t || '500Z","author":null,"summary":"sum","category":null}' AS view FROM p""",
    "story_corpus": """
WITH e AS (SELECT vec_id AS v, vec_id // 50 AS s FROM embeddings), a AS (SELECT s, v - CASE WHEN v % 45 = 9 THEN 1 ELSE 0 END AS article, v - CASE WHEN v % 33 = 5 THEN 1 ELSE 0 END AS url FROM e WHERE s % 7 <> 3),
m AS (SELECT s, CASE WHEN v % 41 = 7 THEN v + 1000000 ELSE v END AS article FROM e WHERE s % 8 <> 5 AND v % 31 <> 0), c AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE article % 37 = 2)
SELECT DISTINCT 'scenario-once' AS rule, CAST(s AS VARCHAR) AS key FROM e WHERE s % 4 = 1
UNION ALL SELECT 'scenario-has-articles', CAST(s AS VARCHAR) FROM (SELECT DISTINCT s FROM e UNION ALL SELECT DISTINCT s FROM e WHERE s % 4 = 1) WHERE s NOT IN (SELECT s FROM a)
UNION ALL SELECT 'scenario-has-clusters', CAST(s AS VARCHAR) FROM (SELECT DISTINCT s FROM e UNION ALL SELECT DISTINCT s FROM e WHERE s % 4 = 1) WHERE s NOT IN (SELECT s FROM c)
UNION ALL SELECT 'article-once', s || '|' || article FROM a GROUP BY s, article HAVING count(*) > 1 UNION ALL SELECT 'url-once', s || '|u' || url FROM a GROUP BY s, url HAVING count(*) > 1
UNION ALL SELECT 'cluster-of-known-articles', s || '|' || article FROM c WHERE (s, article) NOT IN (SELECT s, article FROM a)
UNION ALL SELECT 'article-in-one-cluster', s || '|' || article FROM c GROUP BY s, article HAVING count(*) > 1
UNION ALL SELECT 'article-in-a-cluster', s || '|' || article FROM a WHERE (s, article) NOT IN (SELECT s, article FROM c)""",
}
