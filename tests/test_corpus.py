"""Seventeen ordered ingestion cases: five kept, three duplicates, six rejects of normalisation, three of freshness."""

import json

from pyspark.sql import functions as F

from loomline.operators import corpus, evaluation, research

NOW = 1_788_004_800_000  # 2026-08-29T12:00:00Z
WIRE = {"id": "wire", "name": "The Wire", "type": "api"}
AT = "2026-08-29T10:00:00Z"


def article(n, **more):
    return {"externalId": f"w-{n}", "title": f"Headline {n}", "url": f"https://news.example.org/{n}", "publishedAt": AT, "publisher": {"name": f"Paper {n}"}} | more


def kept(url):
    return (None, url, "fresh", "unique", None, None, "retained")


def copy(url, reason, of):
    return (None, url, "fresh", "duplicate", reason, of, "duplicate")


def refused(reason):
    return (reason, None, None, None, None, None, "rejected-normalization")


def old(url, kind):
    return (None, url, kind, None, None, None, "rejected-freshness")


BASE = "https://news.example.org/"
CASES = [
    ("plain", WIRE, article(1, url=BASE + "1?utm_source=x"), kept(BASE + "1")), ("query", WIRE, article(2, url=BASE + "2?z=2&fbclid=q&a=1#s"), kept(BASE + "2?a=1&z=2")), ("oldest", WIRE, article(3, publishedAt="2026-08-28T12:00:00Z"), kept(BASE + "3")),
    ("ahead", WIRE, article(4, publishedAt="2026-08-29T12:05:00Z"), kept(BASE + "4")), ("alike", WIRE, article(5, title="Headline 1 again", publisher={"name": "Paper 1"}), kept(BASE + "5")),
    ("same-id", WIRE, article(6, externalId="W-1 "), copy(BASE + "6", "source-external-id", "plain")), ("same-url", WIRE | {"id": "other"}, article(7, url=BASE + "2?a=1&z=2&utm_x=1"), copy(BASE + "2?a=1&z=2", "canonical-url", "query")),
    ("same-title", WIRE | {"id": "third"}, article(8, title="HEADLINE   3", publisher={"name": "paper 3"}), copy(BASE + "8", "publisher-title", "oldest")),
    ("r1", {"id": "", "name": "n", "type": "api"}, article(9), refused("invalid-source")), ("r2", WIRE, article(10, publisher={"name": "  "}), refused("invalid-article-shape")), ("r3", WIRE, article(11, title=" "), refused("missing-title")),
    ("r4", WIRE, {"title": "t"}, refused("missing-url")), ("r5", WIRE, article(13, url="not a url"), refused("invalid-url")), ("r6", WIRE, article(14, publishedAt="someday"), refused("invalid-published-at")),
    ("f1", WIRE, article(15, publishedAt="2026-08-28T11:59:59.999Z"), old(BASE + "15", "stale")), ("f2", WIRE, article(16, publishedAt=""), old(BASE + "16", "missing-published-at")), ("f3", WIRE, article(17, publishedAt="2026-08-29T12:05:00.001Z"), old(BASE + "17", "future-published-at")),
]


def test_all_stages_are_right(spark):
    rows = spark.createDataFrame([(c, k, json.dumps(s), json.dumps(a)) for k, (c, s, a, _) in enumerate(CASES)], "case_id string, seq long, s string, a string")
    cases = rows.select("case_id", "seq", F.parse_json("s").alias("source"), F.parse_json("a").alias("payload"), F.timestamp_millis(F.lit(NOW - 60_000)).alias("fetched_at"))
    expected = spark.createDataFrame([(c, *e) for c, _, _, e in CASES], "case_id string, exp_reject_reason string, exp_canonical_url string, exp_classification string, exp_dedup_status string, exp_dedup_reason string, exp_duplicate_of string, exp_outcome string")
    accuracy = corpus.evaluate(cases, expected, NOW)
    assert {r.stage: (r.evaluated, r.correct) for r in accuracy.collect()} == {"normalization": (17, 17), "canonical-url": (11, 11), "freshness": (11, 11), "deduplication": (8, 8), "outcome": (17, 17)}
    assert evaluation.regression_gate(accuracy).first().passed
    assert corpus.corpus_violations(expected, rows).count() == 0
    assert corpus.corpus_violations(expected, rows.withColumn("seq", -F.col("seq"))).count() == 3
    wrong = expected.withColumn("exp_outcome", F.lit("retained"))
    assert not evaluation.regression_gate(corpus.evaluate(cases, wrong, NOW)).first().passed


def test_research_catalogs_prompts_and_selections(spark):
    stories = spark.createDataFrame([("s", "Title")], "story_id string, canonical_title string")
    members = spark.createDataFrame([("s", f"a{k}", k) for k in range(30)], "story_id string, article_id string, seq long")
    table = spark.createDataFrame([(f"a{k}", f"http://x/{k}", f"http://x/{k}", f"T  {k}", None) for k in range(30)], "article_id string, url string, canonical_url string, title string, publisher_name string")
    catalog = research.story_catalog(stories, members, table)
    payload = json.loads(research.prompt_payload(stories, catalog, F.lit("  "), 40).first().payload)
    assert payload["researchGoal"] == "Improve source coverage for this story." and len(payload["registeredSources"]) == 25
    assert payload["registeredSources"][1] == {"sourceId": "story_a1", "title": "T 1", "publisherName": None, "originKinds": ["story-member"]}
    assert len(json.loads(research.prompt_payload(stories, catalog, F.lit("g"), 3).first().payload)["registeredSources"]) == 3

    known = spark.createDataFrame([(r, f"s{k}") for r in range(9) for k in range(3)], "run_id long, source_id string")
    picks = spark.createDataFrame([
        (0, ["s0", "s1"], ["s1"], ["why?"], "coverage-sufficient"), (1, ["s9"], [], [], "x"), (2, ["s0", "s0"], [], [], "x"), (3, ["s0"], ["s1"], [], "x"), (4, ["s0", "s1", "s2"], [], [], "x"),
        (5, [], [], ["a", "b"], "x"), (6, [], [], [" "], "x"), (7, [], [], ["long question"], "x"), (8, [], [], [], "coverage-sufficient"),
    ], "run_id long, source_ids array<string>, primary_ids array<string>, questions array<string>, suggestion string")
    broken = {(r.run_id, r.rule) for r in research.selection_violations(picks, known, 2, 1, 8).collect()}
    assert broken == {(1, "source-of-the-catalog"), (2, "sources-distinct"), (3, "primaries-selected"), (4, "sources-in-budget"), (5, "questions-in-budget"), (6, "questions-bounded"), (7, "questions-bounded"), (8, "coverage-has-a-source")}

    rows = [(1, "a", "u", "story-member", "x", None, None), (1, "a", "v", "tool", None, "c", "t1"), (2, "a", "u", "tool", None, "c", "t1"), (2, "b", "u", "tool", None, "c", "t2"), (3, "a", "u", "story-member", "m", None, None)]
    catalogs = spark.createDataFrame(rows, "run_id long, source_id string, canonical_url string, provenance string, article_id string, call_id string, tool string")
    found = {(r.run_id, r.rule) for r in research.catalog_violations(catalogs, spark.createDataFrame([(3, "m")], "run_id long, article_id string")).collect()}
    assert found == {(1, "source-ids-distinct"), (1, "member-of-the-snapshot"), (2, "canonical-urls-distinct"), (2, "one-tool-per-call")}
