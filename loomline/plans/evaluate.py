"""Queries of labelled-pair evaluation and research accounting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.similarity import token_jaccard, token_order
from loomline.functions.text import title_tokens
from loomline.operators import evaluation, research
from loomline.operators.graph import shared_folder
from loomline.plans.common import table
from loomline.plans.story import PAIRS, THRESHOLD, vector_pairs
from loomline.streaming import leases


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.floor(F.col("item_id") / 10).alias("scenario"), title_tokens(F.col("text")).alias("tokens"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scenario_pairs(_titles(spark, sf_dir), "scenario", "item_id", "tokens")


KEYS = ["left_item_id", "right_item_id"]


def pairwise_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("left_item_id") - F.col("right_item_id")) * 60_000
    return _pairs(spark, sf_dir).select("scenario", *KEYS, F.round(token_jaccard(F.col("left_tokens"), F.col("right_tokens")), 6).alias("jaccard"), gap.alias("time_distance_ms"))


def token_order_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(*KEYS, F.round(token_order(F.col("left_tokens"), F.col("right_tokens")), 6).alias("token_order"))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", title_tokens(F.col("text")).alias("tokens"))
    return evaluation.token_statistics(docs, "doc_id", "tokens").withColumn("idf", F.round("idf", 6))


def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    out = evaluation.weighted_jaccard(_pairs(spark, sf_dir), evaluation.token_statistics(titles, "item_id", "tokens"), KEYS, "left_tokens", "right_tokens")
    return out.withColumn("weighted_jaccard", F.round("weighted_jaccard", 6))


def distinctive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _titles(spark, sf_dir)
    out = evaluation.distinctive_jaccard(_pairs(spark, sf_dir), evaluation.token_statistics(titles, "item_id", "tokens"), KEYS, "left_tokens", "right_tokens")
    return out.withColumn("distinctive_jaccard", F.round("distinctive_jaccard", 6))


def labelled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vector_pairs(spark, sf_dir).withColumn("gap", F.when(F.col("left_vec_id") % 17 != 0, (F.col("right_vec_id") - F.col("left_vec_id")).cast("double")))
    return evaluation.summarize(pairs, "expected_same", ["similarity", "gap"]).withColumn("mean", F.round("mean", 6))


def _rounded(sweep: DataFrame) -> DataFrame:
    return sweep.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "false_merge_rate", "false_split_rate")})


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 3))


def semantic_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.threshold_sweep(_coarse(spark, sf_dir), "expected_same", "similarity"))


def lexical_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairwise_lexical(spark, sf_dir).select(F.round("jaccard", 3).alias("jaccard"), (F.col("time_distance_ms") / 600_000).alias("nearness"), ((F.col("left_item_id") + F.col("right_item_id")) % 2 == 0).alias("expected_same"))
    return _rounded(evaluation.threshold_grid(pairs, "expected_same", "jaccard", "nearness"))


def distinctive_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each cutoff a sweep over the observed similarities and 0."""
    pairs = distinctive_jaccard(spark, sf_dir).withColumn("expected_same", (F.col("left_item_id") + F.col("right_item_id")) % 2 == 0)
    return _rounded(evaluation.threshold_sweep(pairs, "expected_same", "distinctive_jaccard", with_zero=True, by=["cutoff"]))


def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_f1(semantic_threshold_sweep(spark, sf_dir), "threshold")


def best_zero_false_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sweep in which pairs at or above the match threshold belong together as well, so that some threshold has no false merge."""
    curated = _coarse(spark, sf_dir).withColumn("expected_same", F.col("expected_same") | (F.col("similarity") >= THRESHOLD))
    return evaluation.best_zero_false_merge(_rounded(evaluation.threshold_sweep(curated, "expected_same", "similarity")), F.desc("threshold"))


def informative_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep of the weighted Jaccard over its observed values and 0."""
    pairs = weighted_jaccard(spark, sf_dir).select(F.round("weighted_jaccard", 3).alias("weighted_jaccard"), ((F.col("left_item_id") + F.col("right_item_id")) % 2 == 0).alias("expected_same"))
    return _rounded(evaluation.threshold_sweep(pairs, "expected_same", "weighted_jaccard", with_zero=True))


def extreme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five least similar pairs of one label and the five most similar of two, by cosine; the same by weighted Jaccard for benchmark items."""
    semantic = vector_pairs(spark, sf_dir).select(F.lit("semantic").alias("signal"), F.col("left_vec_id").alias("left_id"), F.col("right_vec_id").alias("right_id"), "expected_same", F.col("similarity").alias("value"))
    lexical = weighted_jaccard(spark, sf_dir).select(F.lit("informative").alias("signal"), F.col("left_item_id").alias("left_id"), F.col("right_item_id").alias("right_id"), ((F.col("left_item_id") + F.col("right_item_id")) % 2 == 0).alias("expected_same"), F.round("weighted_jaccard", 3).alias("value"))
    out = None
    for rows in (semantic, lexical):
        for same in (True, False):
            some = evaluation.extreme_pairs(rows, "expected_same", "value", same, 5, "left_id", "right_id")
            out = some if out is None else out.unionByName(some)
    return out


def most_similar_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pairs(spark, sf_dir).where("NOT expected_same").orderBy(F.desc("similarity"), "left_vec_id", "right_vec_id").limit(5)


def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = evaluation.confusion(rows.select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") >= 500).alias("predicted")), "expected", "predicted")
    return _rounded(out)


def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages to a query; every seventh has no URL, every eleventh repeats that of its query's first, and a query's second is excluded."""
    p = table(spark, sf_dir, "pages").withColumn("q", F.floor(F.col("page_id") / 10))
    first = p.where("page_id % 10 = 0").select("q", F.col("url").alias("first_url"))
    rows = p.join(first, "q", "left")
    url = F.when(F.col("page_id") % 7 == 0, None).when(F.col("page_id") % 11 == 0, F.col("first_url")).otherwise(F.col("url"))
    articles = rows.select(F.col("q").alias("query_id"), F.col("page_id").alias("pos"), url.alias("url"), F.lit(" A  title ").alias("title"), F.lit("P").alias("publisher"), F.lit("2024-01-02T03:04:05Z").alias("published"), F.col("html").alias("summary"))
    from loomline.functions.urls import normal_forms

    out = p.where("page_id % 10 = 1").select(F.col("q").alias("query_id"), normal_forms(F.col("url"))["canonical_url"].alias("canonical_url"))
    found = research.search_candidates(articles, out, 5)
    return found.select("query_id", F.array_join(F.transform("candidates", lambda c: c["pos"].cast("string")), ",").alias("positions"), F.element_at("candidates", 1)["title"].alias("first_title"), "rejected_count", "truncated")


def related_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL isn't that of a page divisible by three, with the source id each is registered under."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("canonical_url"))
    fresh = research.unseen(p, p.where("page_id % 3 = 0"))
    catalog = fresh.where("page_id % 2 = 0").select(F.lit(1).alias("run_id"), "canonical_url", F.concat(F.lit("story_"), F.col("page_id").cast("string")).alias("source_id"))
    observed = fresh.select(F.lit(1).alias("run_id"), (F.col("page_id") % 10).alias("pos"), F.floor(F.col("page_id") / 10).alias("call_id"), "canonical_url")
    return research.register_sources(observed, catalog).select("canonical_url", "source_id", "reused")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "model").otherwise("tool").alias("kind"), (F.col("turn") * (F.col("conv_id") % 7) * 1000).alias("elapsed_ms"))


def budget_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.budget_accounting(_calls(spark, sf_dir), 2, 3, 20_000)


def research_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = budget_accounting(spark, sf_dir)
    suggestion = F.when(F.col("run_id") % 2 == 0, "coverage-sufficient").otherwise("coverage-partial")
    return runs.select("run_id", research.research_outcome(F.col("stop_reason"), F.col("run_id") % 3, suggestion).alias("o")).select("run_id", "o.outcome", "o.stop_reason")


def lease_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lease = research.lease_until(F.col("event_id") * 1000, F.col("user_id") * 100)
    return e.select("event_id", lease.alias("lease_ms"), research.retry_at(F.col("event_id") * 1010, lease).alias("retry_ms"))


def _run_events(e: DataFrame) -> DataFrame:
    """Each user's events as the events of a research run."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END")
    token = F.concat(F.lit("w"), (F.floor(F.col("event_id") / 50) % 3).cast("string"))
    rows = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), kind.alias("kind"), ms.alias("at_ms"), token.alias("token"), (ms + 7_200_000).alias("lease_ms"), F.when(kind == "create", "r").otherwise(F.col("event_type")).alias("result"))
    return rows


def lease_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.lease_states(_run_events(table(spark, sf_dir, "events")))


def lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a stream with a state for each run: the last state of each and what came of its events."""
    stored = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/loomline-steps/leases-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # as a pattern, since a stream takes a path without one for a folder
        stream = _run_events(spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parque[t]")).withColumn("at", F.timestamp_millis("at_ms"))
        steps = leases.lease_steps(stream, retention_ms=1000 * 365 * 86_400_000)
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/steps/{number}")
        steps.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    told = spark.read.parquet(f"{folder}/steps/*").where("pos IS NOT NULL")
    names = ("status", "token", "lease_ms", "started_ms", "ended_ms", "result")
    last = told.groupBy("run_id").agg(F.max_by(F.struct(*names), "pos").alias("s"), *[F.count_if(F.col("what") == what).alias(name) for name, what in (("claims", "claimed"), ("conflicts", "conflict"), ("replays", "replayed"), ("held", "held"))])
    return last.select("run_id", "s.*", "claims", "conflicts", "replays", "held")


QUERIES = {
    "pairwise_lexical": pairwise_lexical, "token_order_lcs": token_order_lcs, "token_idf": token_idf, "weighted_jaccard": weighted_jaccard, "distinctive_jaccard": distinctive_jaccard, "labelled_summary": labelled_summary,
    "semantic_threshold_sweep": semantic_threshold_sweep, "lexical_threshold_grid": lexical_threshold_grid, "distinctive_sweep": distinctive_sweep, "best_f1": best_f1, "best_zero_false_merge": best_zero_false_merge,
    "informative_threshold_sweep": informative_threshold_sweep, "extreme_pairs": extreme_pairs,
    "most_similar_negatives": most_similar_negatives, "confusion_labels": confusion_labels, "search_candidates": search_candidates, "related_exclusion": related_exclusion, "budget_accounting": budget_accounting,
    "research_outcome": research_outcomes, "lease_times": lease_times, "lease_state": lease_state, "lease_stream": lease_stream,
}

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"
TITLES = f"""t AS (SELECT item_id, item_id // 10 AS scenario, {TOKENS} AS tokens FROM benchmark),
p AS (SELECT a.scenario, a.item_id AS left_item_id, b.item_id AS right_item_id, list_distinct(a.tokens) AS l, list_distinct(b.tokens) AS r FROM t a JOIN t b ON a.scenario = b.scenario AND a.item_id < b.item_id),
df AS (SELECT token, count(*) AS df FROM (SELECT item_id, unnest(list_distinct(tokens)) AS token FROM t) GROUP BY 1),
each AS (SELECT left_item_id, right_item_id, token, list_contains(l, token) AND list_contains(r, token) AS both_have FROM (SELECT *, unnest(list_distinct(l || r)) AS token FROM p))"""
RATES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 6) AS f1, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_merge_rate, round(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / (tp + fn) END, 6) AS false_split_rate"""
SWEEP = f"""{PAIRS}, c AS (SELECT expected_same, round(similarity, 3) + 0.0 AS similarity FROM pairs), h AS (SELECT DISTINCT similarity AS threshold FROM c),
n AS (SELECT threshold, count(*) FILTER (similarity >= threshold AND expected_same) AS tp, count(*) FILTER (similarity >= threshold AND NOT expected_same) AS fp,
  count(*) FILTER (similarity < threshold AND NOT expected_same) AS tn, count(*) FILTER (similarity < threshold AND expected_same) AS fn FROM h, c GROUP BY 1),
sweep AS (SELECT *, {RATES} FROM n)"""
CURATED = SWEEP.replace("SELECT expected_same, round(similarity, 3) + 0.0 AS similarity FROM pairs", f"SELECT expected_same OR round(similarity, 3) >= {THRESHOLD} AS expected_same, round(similarity, 3) + 0.0 AS similarity FROM pairs")
WEIGHTED = f"""{TITLES}, n0 AS (SELECT count(*) AS n FROM t), w AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n0),
wj AS (SELECT left_item_id, right_item_id, round(coalesce(sum(idf) FILTER (both_have), 0) / sum(idf), 6) AS weighted_jaccard FROM each JOIN w USING (token) GROUP BY ALL)"""
DISTINCTIVE = f"""{TITLES}, cut AS (SELECT DISTINCT df AS cutoff FROM df),
g AS (SELECT p.left_item_id, p.right_item_id, cutoff, count(*) FILTER (df <= cutoff AND both_have) AS shared, count(*) FILTER (df <= cutoff) AS every
  FROM p JOIN each e ON p.left_item_id = e.left_item_id AND p.right_item_id = e.right_item_id JOIN df USING (token), cut GROUP BY ALL),
dj AS (SELECT left_item_id, right_item_id, cutoff, shared, round(CASE WHEN every > 0 THEN shared / every ELSE 0 END, 6) AS distinctive_jaccard FROM g)"""
BUDGET = """c AS (SELECT conv_id AS run_id, turn AS pos, CASE WHEN role = 'assistant' THEN 'model' ELSE 'tool' END AS kind, turn * (conv_id % 7) * 1000 AS elapsed FROM conversations),
b AS (SELECT *, count(*) FILTER (kind = 'model') OVER w AS m, count(*) FILTER (kind = 'tool') OVER w AS t FROM c WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN elapsed >= 20000 THEN 'deadline-exceeded' WHEN kind = 'model' AND m >= 2 THEN 'model-budget-exhausted' WHEN kind = 'tool' AND t >= 3 THEN 'tool-budget-exhausted' END AS stop FROM b),
f AS (SELECT run_id, min(pos) FILTER (stop IS NOT NULL) AS stopped_at, count(*) FILTER (kind = 'model') AS all_m, count(*) FILTER (kind = 'tool') AS all_t FROM s GROUP BY 1),
r AS (SELECT f.run_id, coalesce(m, all_m) AS model_calls, coalesce(t, all_t) AS tool_calls, stopped_at, stop AS stop_reason FROM f LEFT JOIN s ON s.run_id = f.run_id AND s.pos = stopped_at)"""

SQL = {
    "pairwise_lexical": f"WITH {TITLES} SELECT scenario, left_item_id, right_item_id, round(CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE len(list_intersect(l, r)) / len(list_distinct(l || r)) END, 6) AS jaccard, abs(left_item_id - right_item_id) * 60000 AS time_distance_ms FROM p",
    "token_idf": f"WITH d AS (SELECT doc_id, {TOKENS} AS tokens FROM documents), n AS (SELECT count(*) AS n FROM d), f AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM d) GROUP BY 1) SELECT token, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM f, n",
    "weighted_jaccard": f"WITH {TITLES}, n AS (SELECT count(*) AS n FROM t), w AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n) SELECT left_item_id, right_item_id, round(coalesce(sum(idf) FILTER (both_have), 0) / sum(idf), 6) AS weighted_jaccard FROM each JOIN w USING (token) GROUP BY ALL",
    "distinctive_jaccard": f"WITH {DISTINCTIVE} SELECT * FROM dj",
    "distinctive_sweep": f"""WITH {DISTINCTIVE}, e AS (SELECT *, (left_item_id + right_item_id) % 2 = 0 AS same FROM dj), h AS (SELECT DISTINCT cutoff, distinctive_jaccard AS threshold FROM e UNION SELECT DISTINCT cutoff, 0 FROM e),
n AS (SELECT h.cutoff, threshold, count(*) FILTER (distinctive_jaccard >= threshold AND same) AS tp, count(*) FILTER (distinctive_jaccard >= threshold AND NOT same) AS fp, count(*) FILTER (distinctive_jaccard < threshold AND NOT same) AS tn, count(*) FILTER (distinctive_jaccard < threshold AND same) AS fn FROM h JOIN e USING (cutoff) GROUP BY ALL)
SELECT *, {RATES} FROM n""",
    "labelled_summary": f"""WITH {PAIRS}, x AS (SELECT expected_same, 'similarity' AS signal, similarity AS v FROM pairs UNION ALL SELECT expected_same, 'gap', CASE WHEN left_vec_id % 17 <> 0 THEN CAST(right_vec_id - left_vec_id AS DOUBLE) END FROM pairs)
SELECT expected_same, signal, count(v) AS evaluated, count(*) - count(v) AS missing, min(v) AS minimum, round(avg(v), 6) AS mean, max(v) AS maximum FROM x GROUP BY ALL""",
    "semantic_threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
    "lexical_threshold_grid": f"""WITH {TITLES}, c AS (SELECT round(round(CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0 ELSE len(list_intersect(l, r)) / len(list_distinct(l || r)) END, 6), 3) AS x, abs(left_item_id - right_item_id) * 60000 / 600000 AS y, (left_item_id + right_item_id) % 2 = 0 AS same FROM p),
a AS (SELECT x AS first_threshold FROM c UNION SELECT 0), b AS (SELECT y AS second_threshold FROM c UNION SELECT 0),
n AS (SELECT first_threshold, second_threshold, count(*) FILTER (x >= first_threshold AND y >= second_threshold AND same) AS tp, count(*) FILTER (x >= first_threshold AND y >= second_threshold AND NOT same) AS fp,
  count(*) FILTER (NOT (x >= first_threshold AND y >= second_threshold) AND NOT same) AS tn, count(*) FILTER (NOT (x >= first_threshold AND y >= second_threshold) AND same) AS fn FROM a, b, c GROUP BY ALL)
SELECT *, {RATES} FROM n""",
    "best_f1": f"WITH {SWEEP} SELECT * FROM sweep ORDER BY f1 DESC, false_merge_rate, recall DESC, threshold LIMIT 1",
    "best_zero_false_merge": f"WITH {CURATED} SELECT * FROM sweep WHERE fp = 0 AND tp > 0 ORDER BY recall DESC, f1 DESC, threshold DESC LIMIT 1",
    "informative_threshold_sweep": f"""WITH {WEIGHTED}, c AS (SELECT round(weighted_jaccard, 3) AS x, (left_item_id + right_item_id) % 2 = 0 AS same FROM wj), h AS (SELECT x AS threshold FROM c UNION SELECT 0),
n AS (SELECT threshold, count(*) FILTER (x >= threshold AND same) AS tp, count(*) FILTER (x >= threshold AND NOT same) AS fp, count(*) FILTER (x < threshold AND NOT same) AS tn, count(*) FILTER (x < threshold AND same) AS fn FROM h, c GROUP BY 1)
SELECT *, {RATES} FROM n""",
    "extreme_pairs": f"""WITH {PAIRS}, {WEIGHTED}, x AS (SELECT 'semantic' AS signal, left_vec_id AS left_id, right_vec_id AS right_id, expected_same, similarity AS value FROM pairs
  UNION ALL SELECT 'informative', left_item_id, right_item_id, (left_item_id + right_item_id) % 2 = 0, round(weighted_jaccard, 3) FROM wj)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY signal, expected_same ORDER BY CASE WHEN expected_same THEN value ELSE -value END, left_id, right_id) <= 5""",
    "most_similar_negatives": f"WITH {PAIRS} SELECT * FROM pairs WHERE NOT expected_same ORDER BY similarity DESC, left_vec_id, right_vec_id LIMIT 5",
    "confusion_labels": f"""WITH n AS (SELECT count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality <> 1 AND n_chars >= 500) AS fp, count(*) FILTER (quality <> 1 AND n_chars < 500) AS tn, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn FROM documents JOIN labels USING (doc_id))
SELECT *, {RATES} FROM n""",
    "search_candidates": """
WITH p AS (SELECT page_id, page_id // 10 AS q, url FROM pages), f AS (SELECT q, url AS first_url FROM p WHERE page_id % 10 = 0),
r AS (SELECT q, page_id, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN first_url ELSE url END AS url FROM p LEFT JOIN f USING (q)),
c AS (SELECT q, page_id, split_part(url, '#', 1) AS u FROM r), n AS (SELECT q, page_id, replace(replace(replace(u, '?utm_source=feed&', '?'), '?utm_source=feed', ''), '&utm_source=feed', '') AS u FROM c),
x AS (SELECT n.q, n.page_id, n.u, e.u IS NOT NULL AS excluded FROM n LEFT JOIN (SELECT q, replace(split_part(url, '#', 1), '?utm_source=feed', '') AS u FROM p WHERE page_id % 10 = 1) e ON e.q = n.q AND e.u = n.u),
k AS (SELECT *, u IS NOT NULL AND NOT excluded AND row_number() OVER (PARTITION BY q, u, excluded ORDER BY page_id) = 1 AS fresh FROM x),
h AS (SELECT *, coalesce(count(*) FILTER (fresh) OVER (PARTITION BY q ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM k)
SELECT q AS query_id, coalesce(string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) FILTER (fresh AND had < 5), '') AS positions, CASE WHEN count(*) FILTER (fresh AND had < 5) > 0 THEN 'A title' END AS first_title, count(*) FILTER (had < 5 AND NOT fresh) AS rejected_count, count(*) > 5 AS truncated FROM h GROUP BY 1""",
    "related_exclusion": """
WITH f AS (SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)), c AS (SELECT url, min('story_' || page_id) AS known FROM f WHERE page_id % 2 = 0 GROUP BY 1)
SELECT url AS canonical_url, coalesce(known, 'tool_' || page_id // 10 || '_' || page_id % 10) AS source_id, known IS NOT NULL AS reused FROM f LEFT JOIN c USING (url)""",
    "budget_accounting": f"WITH {BUDGET} SELECT * FROM r",
    "research_outcome": f"""WITH {BUDGET} SELECT run_id, CASE WHEN stop_reason IS NOT NULL THEN 'partial' WHEN run_id % 2 = 0 AND run_id % 3 > 0 THEN 'complete' WHEN run_id % 3 > 0 THEN 'partial' ELSE 'insufficient-sources' END AS outcome,
  CASE WHEN stop_reason IS NOT NULL THEN stop_reason WHEN run_id % 2 = 0 AND run_id % 3 > 0 THEN 'criteria-satisfied' ELSE 'no-useful-results' END AS stop_reason FROM r""",
    "lease_state": """
WITH RECURSIVE e AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind,
    epoch_us(ts) // 1000 AS at_ms, 'w' || event_id // 50 % 3 AS worker, event_type AS said FROM events
), runs AS (
  SELECT DISTINCT user_id AS run_id, 0::BIGINT AS k, NULL::VARCHAR AS status, NULL::VARCHAR AS token, NULL::BIGINT AS lease_ms, NULL::BIGINT AS started_ms, NULL::BIGINT AS ended_ms, NULL::VARCHAR AS result,
    0::BIGINT AS claims, 0::BIGINT AS conflicts, 0::BIGINT AS replays, 0::BIGINT AS held FROM events
  UNION ALL
  SELECT run_id, k, CASE what WHEN 'created' THEN 'PENDING' WHEN 'claimed' THEN 'RUNNING' WHEN 'ended' THEN final ELSE status END, CASE WHEN what = 'claimed' THEN worker ELSE token END,
    CASE what WHEN 'claimed' THEN at_ms + 7200000 WHEN 'ended' THEN NULL ELSE lease_ms END, CASE WHEN what = 'claimed' THEN coalesce(started_ms, at_ms) ELSE started_ms END, CASE WHEN what = 'ended' THEN at_ms ELSE ended_ms END, CASE WHEN what = 'ended' THEN said ELSE result END,
    claims + (what = 'claimed')::BIGINT, conflicts + (what = 'conflict')::BIGINT, replays + (what = 'replayed')::BIGINT, held + (what = 'held')::BIGINT
  FROM (
    SELECT *, CASE WHEN kind = 'create' THEN CASE WHEN status IS NULL THEN 'created' ELSE 'replayed' END WHEN status IS NULL THEN 'missing'
      WHEN kind = 'claim' THEN CASE WHEN status = 'PENDING' OR (status = 'RUNNING' AND lease_ms <= at_ms) THEN 'claimed' WHEN status = 'RUNNING' THEN 'held' ELSE 'terminal' END
      WHEN status = 'RUNNING' AND token = worker THEN 'ended' WHEN status = final AND token = worker AND result = said THEN 'replayed' ELSE 'conflict' END AS what
    FROM (SELECT e.k, e.kind, e.at_ms, e.worker, e.said, CASE e.kind WHEN 'complete' THEN 'COMPLETED' ELSE 'FAILED' END AS final, r.* EXCLUDE (k) FROM runs r JOIN e ON e.run_id = r.run_id AND e.k = r.k + 1)
  )
)
SELECT * EXCLUDE (k) FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1""",
    "lease_times": "SELECT event_id, event_id * 1000 + user_id * 100 + 30000 AS lease_ms, greatest(event_id * 1010, event_id * 1000 + user_id * 100 + 30000) + 1000 AS retry_ms FROM events",
}
SQL["lease_stream"] = SQL["lease_state"]
