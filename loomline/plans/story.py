"""Queries of candidates, similarity, clustering and read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.similarity import cosine, norm
from loomline.operators import candidates, clustering, evaluation, integrity, readmodels
from loomline.operators.graph import dealt, met, settle
from loomline.plans.common import at_ms, table

WINDOW_MS = 600_000
THRESHOLD = 0.35
DAY_MS = 86_400_000


def _ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _articles_and_stories(spark: SparkSession, sf_dir: str, per_day: bool) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _ms("ts").alias("ms"), F.to_date("ts").alias("day"))
    articles = e.where("event_type = 'signup'").select(F.col("event_id").alias("article_id"), F.when(F.col("event_id") % 17 != 0, F.col("ms")).alias("at_ms"))
    key = F.concat_ws("/", F.col("user_id").cast("string"), *([F.col("day").cast("string")] if per_day else []))
    stories = e.where("event_type = 'purchase'").groupBy(key.alias("story_id")).agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    return articles, stories


def candidate_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, stories = _articles_and_stories(spark, sf_dir, True)
    return candidates.candidates(articles, stories, WINDOW_MS)


def candidate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article's decisions on all stories, counted by reason."""
    articles, stories = _articles_and_stories(spark, sf_dir, False)
    return candidates.decision_counts(articles, stories, 3_600_000, include_unknown=True)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("scenario"), F.col("embedding").cast("array<double>").alias("v")).withColumn("norm", norm(F.col("v")))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a scenario (fifty vectors, so that pairs grow with the table, not with its square) with their cosine and whether they are of one label."""
    pairs = evaluation.scenario_pairs(_vectors(spark, sf_dir), "scenario", "vec_id", "label", "v", "norm")
    sim = cosine(F.col("left_v"), F.col("right_v"), F.col("left_norm"), F.col("right_norm"))
    return pairs.select("scenario", "left_vec_id", "right_vec_id", (F.col("left_label") == F.col("right_label")).alias("expected_same"), F.round(sim, 6).alias("similarity"))


def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_pairs(spark, sf_dir).withColumn("d", clustering.match_decision(F.col("similarity"), THRESHOLD))
    return out.select("left_vec_id", "right_vec_id", "d.decision", F.col("d.score").alias("score"), "d.reason")


def cluster_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the seeds of its scenario, all the vectors before it."""
    v = _vectors(spark, sf_dir)
    d = match_decisions(spark, sf_dir).select(F.col("right_vec_id").alias("article_id"), F.format_string("%06d", "left_vec_id").alias("story_id"), "decision")
    out = clustering.assign(v.select(F.col("vec_id").alias("article_id")), d)
    by_id = F.array_sort(F.transform("matching_ids", lambda s: s.cast("long")))  # as text, ids of seven digits would come before those of six
    return out.withColumn("matching_ids", F.array_join(F.transform(by_id, lambda k: F.format_string("%06d", k)), ","))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    articles = v.select(F.col("vec_id").alias("seq"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("article_id"), at_ms(F.col("vec_id")).alias("at_ms"), F.col("embedding").cast("array<double>").alias("vector"))
    return clustering.cluster(articles, DAY_MS, threshold=THRESHOLD)


def story_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _clustered(spark, sf_dir)
    return out.withColumns({"score": F.round("score", 6), "matching_seqs": F.array_join(F.col("matching_seqs").cast("array<string>"), ",")})


def story_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustering in four batches of arrivals, each with the stories that the ones before left."""
    v = table(spark, sf_dir, "embeddings")
    articles = settle(v.select(F.col("vec_id").alias("seq"), F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("article_id"), at_ms(F.col("vec_id")).alias("at_ms"), F.col("embedding").cast("array<double>").alias("vector")))
    ends = articles.agg(F.min("seq"), F.max("seq")).first()
    low, high = ends[0] or 0, ends[1] or 0
    cuts = [low + (high + 1 - low) * k // 4 for k in range(5)]
    out, stories = None, None
    for begin, end in zip(cuts, cuts[1:], strict=False):
        batch = articles.where((F.col("seq") >= begin) & (F.col("seq") < end))
        rows = settle(clustering.cluster(batch, DAY_MS, threshold=THRESHOLD, stories=stories))
        changed = clustering.story_state(rows, batch, stories)
        stories = settle(changed if stories is None else met(stories, changed, "story_seq", "left_anti").unionByName(changed))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({"score": F.round("score", 6), "matching_seqs": F.array_join(F.col("matching_seqs").cast("array<string>"), ",")})


def story_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = _clustered(spark, sf_dir)
    stories, _ = clustering.story_tables(clustered, clustered.select("article_id", F.concat(F.lit("Title of "), F.col("article_id")).alias("title")))
    return stories


def story_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of story tables made from orders, an order being an article of its customer's story, with some damage of every kind."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("at"))
    (o,) = dealt((o, ["o_custkey"]))
    spans = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("seed"), F.min("at").alias("first"), F.max("at").alias("last"))
    stories = spans.select(F.concat(F.lit("s"), cust.cast("string")).alias("story_id"), (F.col("seed") + F.when(cust % 170 == 6, 1).otherwise(0)).alias("seed_article_id"), F.col("first").alias("first_ms"), F.when(cust % 150 == 5, F.col("first") - 1).otherwise(F.col("last")).alias("last_ms"))
    kind = F.when((key == F.col("seed")) | (key % 500 == 2), "SEED").otherwise("MATCHED")
    rows = o.join(spans.select("o_custkey", "seed"), "o_custkey").select(key.alias("article_id"), cust, F.when(key % 700 == 3, F.concat(F.lit("lost"), key.cast("string"))).otherwise(F.concat(F.lit("s"), cust.cast("string"))).alias("story_id"), kind.alias("kind"), F.when(kind == "MATCHED", F.when(key % 900 == 4, 2.0).otherwise(0.5)).alias("score"))
    rows = rows.where(~((F.col("kind") == "SEED") & (cust % 190 == 7))).drop("o_custkey")
    return integrity.story_violations(stories, rows.unionByName(rows.where("article_id % 1000 = 1")))


def recent_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"), F.col("o_orderdate").alias("last_seen_at"), "o_totalprice")
    return readmodels.recent(o, "published_at", "last_seen_at", "o_orderkey", 100)


def list_with_member_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return readmodels.with_member_count(c.select("c_custkey", "c_name"), o, "c_custkey", "o_custkey")


def recent_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    spans = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("last_published_at"))
    rows = readmodels.with_member_count(c.select("c_custkey", "c_name"), o, "c_custkey", "o_custkey").join(spans, "c_custkey", "left")
    return readmodels.recent(rows, "last_published_at", "created_at", "c_custkey", 25)


def detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    out = readmodels.detail(o.select("o_orderkey", "o_custkey"), li, "o_orderkey", "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], ["l_suppkey"])
    return out.select("o_orderkey", "o_custkey", F.size("members").alias("n"), F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["l_linenumber"].cast("string"), m["l_partkey"].cast("string"), m["l_suppkey"].cast("string"))), ",").alias("members"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    refs = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
    out = integrity.repeated_keys(t["lineitem"], ["l_orderkey", "l_linenumber"], "unique-line")
    for a, k, b, j in refs:
        out = out.unionByName(integrity.missing_references(t[a], k, t[b], j, f"{a}.{k}"))
    return out.unionByName(integrity.failing(t["orders"], "o_orderkey", F.col("o_totalprice") > 1000, "price-above-1000"))


def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{ "z": {"b": 1, "a": "'), F.col("event_type"), F.lit('"}, "props": '), F.col("props"), F.lit("}"))
    return e.select("event_id", readmodels.canonical_json(text).alias("canonical"))


def enum_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", F.lit("criteria"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", readmodels.screaming(name).alias("stored"), readmodels.kebab(readmodels.screaming(name)).alias("shown"))


QUERIES = {
    "candidate_window_join": candidate_window_join, "candidate_decisions": candidate_decisions, "cosine_pairs": vector_pairs, "match_decisions": match_decisions, "cluster_assignment": cluster_assignment,
    "story_clustering": story_clustering, "story_batches": story_batches, "story_tables": story_tables, "story_integrity": story_integrity, "recent_top_k": recent_top_k, "list_with_member_count": list_with_member_count, "recent_stories": recent_stories,
    "detail_join": detail_join, "latest_per_key": latest_per_key, "integrity_violations": integrity_violations, "json_canonical": json_canonical, "enum_names": enum_names,
}

ARTICLES = "a AS (SELECT event_id AS article_id, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) // 1000 END AS at_ms FROM events WHERE event_type = 'signup')"
DISTANCE = "CASE WHEN at_ms < first_ms THEN first_ms - at_ms WHEN at_ms > last_ms THEN at_ms - last_ms ELSE 0 END"
PAIRS = """v AS (SELECT vec_id, label, vec_id // 50 AS scenario, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.scenario, a.vec_id AS left_vec_id, b.vec_id AS right_vec_id, a.label = b.label AS expected_same, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM v a JOIN v b ON a.scenario = b.scenario AND a.vec_id < b.vec_id)"""
#: The clustering as a recursion over the arrival order: the stories so far, with their seed and interval, meet the next article.
FOLD = f"""v AS (SELECT vec_id AS seq, row_number() OVER (ORDER BY vec_id) AS k, CASE WHEN vec_id % 17 <> 0 THEN 1704067200000 + vec_id * 600000 END AS at_ms, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS MATERIALIZED (SELECT a.seq AS seed, b.seq, list_cosine_similarity(a.v, b.v) AS score FROM v a JOIN v b ON a.k < b.k WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
alike AS MATERIALIZED (SELECT v.k, v.seq, v.at_ms, coalesce(list(near.seed) FILTER (near.seed IS NOT NULL), []) AS seeds FROM v LEFT JOIN near ON near.seq = v.seq GROUP BY ALL),
fold AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS at_ms, 0::BIGINT AS considered, []::BIGINT[] AS met, []::STRUCT(seed BIGINT, lo BIGINT, hi BIGINT)[] AS stories
  UNION ALL
  SELECT k, seq, at_ms, len(inside), met, CASE WHEN len(met) = 1
    THEN list_transform(stories, lambda s: {{'seed': s.seed, 'lo': CASE WHEN s.seed = met[1] THEN least(s.lo, at_ms) ELSE s.lo END, 'hi': CASE WHEN s.seed = met[1] THEN greatest(s.hi, at_ms) ELSE s.hi END}})
    ELSE stories || [{{'seed': seq, 'lo': at_ms, 'hi': at_ms}}] END
  FROM (SELECT *, list_sort(list_transform(list_filter(inside, lambda s: list_contains(seeds, s.seed)), lambda s: s.seed)) AS met
    FROM (SELECT n.*, f.stories, list_filter(f.stories, lambda s: n.at_ms BETWEEN s.lo - {DAY_MS} AND s.hi + {DAY_MS}) AS inside FROM fold f JOIN alike n ON n.k = f.k + 1))
),
placed AS (SELECT seq, 'a' || seq AS article_id, at_ms, considered, met, CASE WHEN len(met) = 1 THEN met[1] ELSE seq END AS story_seq FROM fold WHERE k > 0)"""

SQL = {
    "story_clustering": f"""
WITH RECURSIVE {FOLD}
SELECT p.seq, article_id, CASE WHEN len(met) = 1 THEN 'MATCHED' ELSE 'SEED' END AS kind, story_seq,
  CASE WHEN len(met) = 1 THEN 'semantic-similarity-at-or-above-v1-threshold' WHEN considered = 0 THEN 'no-candidates' WHEN len(met) = 0 THEN 'no-matching-candidates' ELSE 'ambiguous-matching-candidates' END AS reason,
  CASE WHEN len(met) = 1 THEN round(greatest(0.0, score), 6) END AS score, considered, len(met) AS matching, CASE WHEN len(met) > 1 THEN array_to_string(met, ',') ELSE '' END AS matching_seqs, at_ms
FROM placed p LEFT JOIN near ON near.seed = story_seq AND near.seq = p.seq""",
    "story_tables": f"""
WITH RECURSIVE {FOLD}
SELECT substr(sha256('a' || story_seq), 1, 32) AS story_id, 'Title of a' || story_seq AS canonical_title, 'a' || story_seq AS seed_article_id, 'a' || story_seq AS representative_article_id,
  'story-clustering-v1' AS clustering_version, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS members FROM placed GROUP BY story_seq""",
    "candidate_window_join": f"""
WITH {ARTICLES}, s AS (SELECT user_id || '/' || CAST(ts AS DATE) AS story_id, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type = 'purchase' GROUP BY 1),
d AS (SELECT article_id, story_id, {DISTANCE} AS far FROM a JOIN s ON at_ms BETWEEN first_ms - {WINDOW_MS} AND last_ms + {WINDOW_MS})
SELECT article_id, story_id, CASE WHEN far = 0 THEN 'time-overlap' ELSE 'within-time-window' END AS reason, far AS time_distance_ms FROM d""",
    "candidate_decisions": f"""
WITH {ARTICLES}, s AS (SELECT CAST(user_id AS VARCHAR) AS story_id, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type = 'purchase' GROUP BY 1),
d AS (SELECT article_id, CASE WHEN at_ms IS NOT NULL THEN {DISTANCE} END AS far FROM a, s)
SELECT article_id, CASE WHEN far IS NULL THEN 'time-unknown' WHEN far = 0 THEN 'time-overlap' WHEN far <= 3600000 THEN 'within-time-window' ELSE 'outside-time-window' END AS reason,
  far IS NULL OR far <= 3600000 AS included, count(*) AS stories, min(far) AS nearest_ms FROM d GROUP BY 1, 2, 3""",
    "cosine_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "match_decisions": f"WITH {PAIRS} SELECT left_vec_id, right_vec_id, CASE WHEN similarity >= {THRESHOLD} THEN 'match' ELSE 'no-match' END AS decision, greatest(0.0, similarity) AS score, CASE WHEN similarity >= {THRESHOLD} THEN 'semantic-similarity-at-or-above-v1-threshold' ELSE 'semantic-similarity-below-v1-threshold' END AS reason FROM pairs",
    "cluster_assignment": f"""
WITH {PAIRS}, g AS (SELECT right_vec_id AS article_id, count(*) AS considered, count(*) FILTER (similarity >= {THRESHOLD}) AS matching, string_agg(printf('%06d', left_vec_id), ',' ORDER BY left_vec_id) FILTER (similarity >= {THRESHOLD}) AS ids FROM pairs GROUP BY 1),
r AS (SELECT v.vec_id AS article_id, coalesce(considered, 0) AS considered, coalesce(matching, 0) AS matching, ids FROM v LEFT JOIN g ON g.article_id = v.vec_id)
SELECT article_id, CASE WHEN matching = 1 THEN 'assign-existing-story' ELSE 'seed-new-story' END AS kind,
  CASE WHEN considered = 0 THEN 'no-candidates' WHEN matching = 0 THEN 'no-matching-candidates' WHEN matching > 1 THEN 'ambiguous-matching-candidates' END AS reason,
  CASE WHEN matching = 1 THEN ids END AS story_id, considered, matching, CASE WHEN matching > 1 THEN ids ELSE '' END AS matching_ids FROM r""",
    "story_integrity": """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, min(o_orderkey) OVER (PARTITION BY o_custkey) AS seed FROM orders),
s AS (SELECT 's' || c AS story_id, min(k) + CASE WHEN c % 170 = 6 THEN 1 ELSE 0 END AS seed_article, min(d) AS first_ms, CASE WHEN c % 150 = 5 THEN min(d) - 1 ELSE max(d) END AS last_ms FROM o GROUP BY c),
r AS (SELECT k, CASE WHEN k % 700 = 3 THEN 'lost' || k ELSE 's' || c END AS story_id, CASE WHEN k = seed OR k % 500 = 2 THEN 'SEED' ELSE 'MATCHED' END AS kind, k % 900 = 4 AS strange FROM o WHERE NOT ((k = seed OR k % 500 = 2) AND c % 190 = 7)),
m AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE k % 1000 = 1)
SELECT 'one-story-per-article' AS rule, CAST(k AS VARCHAR) AS key FROM m GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'one-seed-per-story', story_id FROM m WHERE kind = 'SEED' GROUP BY story_id HAVING count(*) > 1
UNION ALL SELECT 'membership-of-a-story', story_id FROM m WHERE story_id NOT IN (SELECT story_id FROM s)
UNION ALL SELECT 'story-has-a-seed', story_id FROM s WHERE story_id NOT IN (SELECT story_id FROM m WHERE kind = 'SEED')
UNION ALL SELECT 'seed-is-the-storys', m.story_id FROM m JOIN s USING (story_id) WHERE kind = 'SEED' AND k <> seed_article
UNION ALL SELECT 'score-in-unit-interval', CAST(k AS VARCHAR) FROM m WHERE kind = 'MATCHED' AND strange
UNION ALL SELECT 'interval-ordered', story_id FROM s WHERE first_ms > last_ms""",
    "recent_top_k": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published_at, o_orderdate AS last_seen_at, o_totalprice FROM orders ORDER BY 2 DESC NULLS LAST, 3 DESC, 1 LIMIT 100",
    "list_with_member_count": "SELECT c_custkey, c_name, count(o_orderkey) AS members FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "recent_stories": "SELECT c_custkey, c_name, count(o_orderkey) AS members, min(o_orderdate) AS created_at, max(o_orderdate) AS last_published_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY 5 DESC NULLS LAST, 4 DESC, 1 LIMIT 25",
    "detail_join": "SELECT o_orderkey, o_custkey, CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey), '') AS members FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "latest_per_key": "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "integrity_violations": """
SELECT 'unique-line' AS rule, l_orderkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'nation.n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
UNION ALL SELECT 'customer.c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'orders.o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'price-above-1000', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT o_totalprice > 1000""",
    "json_canonical": """SELECT event_id, '{"props":' || replace(props, ' ', '') || ',"z":{"a":"' || event_type || '","b":1}}' AS canonical FROM events""",
    "enum_names": "SELECT event_id, 'CRITERIA_' || upper(event_type) AS stored, 'criteria-' || event_type AS shown FROM events",
}
SQL["story_batches"] = SQL["story_clustering"]  # however the arrivals are cut
