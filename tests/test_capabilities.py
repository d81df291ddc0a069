"""Capabilities, replays, batches and jobs on a few rows with nulls, repeats and empty tables."""

import datetime
import json

from loomline.operators import capabilities, evaluation


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_fetch_of_known_unknown_and_failed_sources(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 6000)
    requests = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "a"), (1, 4, None), (1, 5, "c"), (1, 6, "d"), (1, 6, "d")], "run_id long, call_id long, source_id string")
    catalog = spark.createDataFrame([(1, "a", "u1"), (1, "b", "u2"), (1, "c", "u3"), (1, "d", "u4")], "run_id long, source_id string, url string")
    fetched = spark.createDataFrame([("u1", "<p>" + "x" * 16_001, at, True, None, None), ("u2", None, at, True, "http", 429), ("u3", "<script>1</script>", at, True, None, None)], "url string, html string, fetched_at timestamp, known boolean, kind string, status int")
    out = capabilities.fetch_articles(requests, catalog, fetched)
    assert rows(out, "call_id", "status", "code", "retryable", "truncated") == [
        (1, "ok", None, None, True), (2, "error", "rate-limited", True, None), (3, "error", "unknown-source", False, None), (4, "error", "unknown-source", False, None),
        (5, "error", "unsupported-content", False, None), (6, "error", "unavailable", True, None), (6, "error", "unavailable", True, None),
    ]
    one = out.where("call_id = 1").first()
    assert len(one.text) == 16_000 and one.fetched_at == "2024-01-02T03:04:05.006Z"
    assert capabilities.fetch_articles(requests.where("false"), catalog, fetched).count() == 0


def test_jobs_end_once(spark):
    attempts = [("a", 1, False, True, "t", 0), ("a", 2, False, True, "t", 10), ("b", 1, False, False, "x", 0), ("b", 2, True, True, "late", 5), ("c", 1, False, True, "t", 0), ("c", 2, False, True, "t", 1), ("c", 3, False, True, "u", 2), ("c", 4, True, True, None, 3), ("d", 1, True, True, None, 0)]
    out = capabilities.job_states(spark.createDataFrame(attempts, "job_id string, pos long, ok boolean, retryable boolean, reason string, at_ms long"))
    assert rows(out, "job_id", "attempts", "state", "reason", "retry_at_ms") == [("a", 2, "waiting", "t", 2010), ("b", 1, "failed", "x", None), ("c", 3, "failed", "u", None), ("d", 1, "completed", None, None)]


def test_replays_name_what_differs(spark):
    member = "article_id long, story_id string, score double, reason string, matched_against_article_id long, clustering_version string, signals string"
    inputs = spark.createDataFrame([(k, "s", 0.5, "r", 9, "v", '{"a":1,"b":[2]}') for k in range(4)], member)
    stored = spark.createDataFrame([(0, "s", 0.5, "r", 9, "v", '{"b": [2], "a": 1}', "MATCHED"), (1, "z", 0.5, None, 9, "v", "{}", "MATCHED"), (2, "s", 0.5, "r", 9, "v", '{"a":1,"b":[2]}', "SEED")], member + ", kind string")
    out = capabilities.matched_replays(inputs, stored)
    assert rows(out, "article_id", "outcome", "differs") == [(0, "replayed", []), (1, "conflict", ["story_id", "reason", "signals"]), (2, "conflict", ["kind"]), (3, "new", [])]


def test_release_gate(spark):
    measured = spark.createDataFrame([("tp", 9.0), ("fp", 0.0), ("extra", 1.0)], "metric string, value double")
    published = spark.createDataFrame([("tp", 9.0), ("fp", 1.0), ("tn", 12.0)], "metric string, value double")
    assert rows(evaluation.release_gate(measured, published), "metric", "passed") == [("extra", False), ("fp", False), ("tn", False), ("tp", True)]


def test_story_and_run_views(spark):
    at = "timestamp'2024-01-01 00:00:0{}'"
    story = "'{0}' AS id, 't' AS canonical_title, 'a' AS seed_article_id, 'a' AS representative_article_id, 'v' AS clustering_version, cast(null AS timestamp) AS first_published_at, cast(null AS timestamp) AS last_published_at, " + f"{at.format(1)} AS created_at, {at.format(2)} AS updated_at"
    stories = spark.sql(f"SELECT {story.format('s')} UNION ALL SELECT {story.format('none')}")
    members = spark.createDataFrame([("m1", "s", "b", "MATCHED", 0.8, '{"z": 1, "y": null}', "r", "a"), ("m2", "s", "a", "SEED", None, None, None, None)], "id string, story_id string, article_id string, kind string, score double, signals string, reason string, matched_against_article_id string").selectExpr("*", "'v' AS clustering_version", f"{at.format(5)} AS created_at")
    articles = spark.createDataFrame([(x, "T", "u", "u", "i", "n", "rss", "p", None) for x in ("a", "b")], "id string, title string, url string, canonical_url string, source_id string, source_name string, source_type string, publisher_id string, publisher_name string").selectExpr("*", "cast(null AS timestamp) AS published_at", f"{at.format(6)} AS first_discovered_at", f"{at.format(7)} AS last_seen_at")
    got = {r.id: json.loads(r.view) for r in capabilities.story_view(stories, members, articles).collect()}
    assert got["none"]["memberships"] == [] and got["none"]["firstPublishedAt"] is None and got["s"]["createdAt"] == "2024-01-01T00:00:01.000Z"
    assert [m["id"] for m in got["s"]["memberships"]] == ["m2", "m1"]  # of one time: by article
    seed, matched = got["s"]["memberships"]
    assert (seed["score"], seed["signals"], matched["signals"], matched["matchedAgainstArticleId"]) == (None, None, {"y": None, "z": 1}, "a")
    assert matched["article"]["publisher"] is None and matched["article"]["source"] == {"id": "i", "name": "n", "type": "rss"} and matched["article"]["lastSeenAt"] == "2024-01-01T00:00:07.000Z"
    assert {r.id: json.loads(r.view)["membershipCount"] for r in capabilities.story_list_view(stories, members).collect()} == {"s": 2, "none": 0}
    assert capabilities.story_view(stories.limit(0), members, articles).count() == 0
    run = "'r' AS id, 's' AS story_id, 'RUNNING' AS status, cast(null AS string) AS research_goal, '{\"a\": 1}' AS budget, cast(null AS string) AS outcome, cast(null AS string) AS stop_reason, cast(null AS string) AS selection, 1 AS model_calls, 0 AS tool_calls, "
    runs = spark.sql(f"SELECT {run} {at.format(1)} AS started_at, cast(null AS timestamp) AS completed_at, {at.format(1)} AS created_at, {at.format(1)} AS updated_at, 'secret' AS execution_token")
    view = json.loads(capabilities.research_run_view(runs).first().view)
    assert view["budget"] == {"a": 1} and view["selection"] is None and view["outcome"] is None and "secret" not in str(view) and len(view) == 14
