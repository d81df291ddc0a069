import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import candidates, clustering, evaluation, graph, integrity, metrics, readmodels, research
from loomline.operators.graph import settle

HOUR = 3_600_000


def test_candidates_at_the_window_edge(spark):
    stories = spark.createDataFrame([("s", 1000, 2000), ("u", None, None)], "story_id string, first_ms long, last_ms long")
    articles = spark.createDataFrame([("a", 899), ("b", 900), ("c", 1500), ("d", 2100), ("e", 2101), ("f", None)], "article_id string, at_ms long")
    decided = {(r.article_id, r.story_id): (r.included, r.reason, r.time_distance_ms) for r in candidates.candidate_decisions(articles, stories, 100).collect()}
    assert [decided[x, "s"] for x in "abcdef"] == [(False, "outside-time-window", 101), (True, "within-time-window", 100), (True, "time-overlap", 0), (True, "within-time-window", 100), (False, "outside-time-window", 101), (False, "time-unknown", None)]
    for unknown in (False, True):
        near = {(r.article_id, r.story_id, r.reason) for r in candidates.candidates(articles, stories, 100, unknown).collect()}
        assert near == {(r.article_id, r.story_id, r.reason) for r in candidates.candidate_decisions(articles, stories, 100, unknown).where("included").collect()}
    assert candidates.candidates(articles, stories, 0).count() == 1


@pytest.mark.parametrize("seed,window", [(1, 0), (2, 5), (3, 40)])
def test_counts_of_decisions_are_those_of_all_pairs(spark, seed, window):
    rng = random.Random(seed)
    spans = [sorted((rng.randrange(100), rng.randrange(100))) for _ in range(30)]
    stories = spark.createDataFrame([*((f"s{k}", *x) for k, x in enumerate(spans)), ("u", None, None), ("v", 3, None)], "story_id string, first_ms long, last_ms long")
    articles = spark.createDataFrame([*((f"a{k}", rng.randrange(-60, 160)) for k in range(60)), ("x", 7), ("y", 7), ("z", None)], "article_id string, at_ms long")
    for unknown in (False, True):
        pairs = candidates.candidate_decisions(articles, stories, window, unknown).groupBy("article_id", "reason", "included").agg(F.count("*"), F.min("time_distance_ms"))
        assert sorted(map(tuple, candidates.decision_counts(articles, stories, window, unknown).collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)
    assert candidates.decision_counts(articles, stories.limit(0), window).count() == 0
    assert candidates.decision_counts(articles.limit(0), stories, window).count() == 0


def plain(rows, vectors, window, threshold, unknown):
    """Every article against every story, one after the other."""
    stories, out = {}, []
    for seq, at in rows:
        inside = [s for s, (lo, hi) in stories.items() if (unknown if at is None or lo is None else lo - window <= at <= hi + window)]
        match = [s for s in inside if float(vectors[s] @ vectors[seq]) >= threshold]
        if len(match) == 1:
            s = match[0]
            lo, hi = stories[s]
            if at is not None:
                stories[s] = (at if lo is None else min(lo, at), at if hi is None else max(hi, at))
            out.append((seq, "MATCHED", s, len(inside), 1, []))
        else:
            stories[seq] = (at, at)
            out.append((seq, "SEED", seq, len(inside), len(match), sorted(match)))
    return out


@pytest.mark.parametrize("seed,unknown,tile", [(1, False, 1024), (2, False, 7), (3, True, 16), (4, True, 1024)])
def test_clustering_is_the_sequential_fold(spark, seed, unknown, tile):
    rng = random.Random(seed)
    vectors = np.random.default_rng(seed).normal(size=(70, 3))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(k, None if rng.random() < 0.15 else rng.randrange(0, 40 * HOUR)) for k in range(70)]
    df = spark.createDataFrame([(k, f"a{k}", at, vectors[k].tolist()) for k, at in rows], "seq long, article_id string, at_ms long, vector array<double>")
    out = clustering.cluster(df, 3 * HOUR, threshold=0.8, include_unknown=unknown, tile=tile)
    got = sorted((r.seq, r.kind, r.story_seq, r.considered, r.matching, list(r.matching_seqs)) for r in out.collect())
    assert got == plain(rows, vectors, 3 * HOUR, 0.8, unknown)
    reasons = {r.seq: r.reason for r in out.collect()}
    for seq, kind, _, considered, matching, _ in got:
        assert kind == "MATCHED" or reasons[seq] == ("no-candidates" if not considered else "no-matching-candidates" if not matching else "ambiguous-matching-candidates")
    stories, memberships = clustering.story_tables(out, out.select("article_id", F.lit("t").alias("title")))
    assert integrity.story_violations(stories, memberships).count() == 0
    broken = memberships.unionByName(memberships.limit(1))
    assert integrity.story_violations(stories, broken).count() > 0


@pytest.mark.parametrize("seed,unknown,cuts", [(1, False, [20, 21, 50]), (5, False, [1, 35]), (3, True, [30])])
def test_any_cut_into_batches_gives_the_same(spark, seed, unknown, cuts):
    rng = random.Random(seed)
    vectors = np.random.default_rng(seed).normal(size=(70, 3))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(k, None if rng.random() < 0.15 else rng.randrange(0, 40 * HOUR)) for k in range(70)]
    df = spark.createDataFrame([(k, f"a{k}", at, vectors[k].tolist()) for k, at in rows], "seq long, article_id string, at_ms long, vector array<double>")
    got, stories = [], None
    for begin, end in zip([0, *cuts], [*cuts, 70], strict=True):
        batch = df.where((F.col("seq") >= begin) & (F.col("seq") < end))
        out = settle(clustering.cluster(batch, 3 * HOUR, threshold=0.8, include_unknown=unknown, stories=stories))
        got += [(r.seq, r.kind, r.story_seq, r.considered, r.matching, list(r.matching_seqs)) for r in out.collect()]
        changed = clustering.story_state(out, batch, stories)
        assert {r.story_seq for r in changed.collect()} == {r.story_seq for r in out.collect()}
        stories = settle(changed if stories is None else stories.join(changed, "story_seq", "left_anti").unionByName(changed))
    assert sorted(got) == plain(rows, vectors, 3 * HOUR, 0.8, unknown)
    ends = {}
    for seq, _, story, *_ in got:
        ends.setdefault(story, []).append(dict(rows)[seq])
    known = lambda times: [t for t in times if t is not None]
    assert {r.story_seq: (r.first_ms, r.last_ms, r.members) for r in stories.collect()} == {s: (min(known(t), default=None), max(known(t), default=None), len(t)) for s, t in ends.items()}


#: Pair, same story, similarity. Fixed values of the labelled corpus.
PAIRS = [
    ("launch-a/launch-b", True, 0.9612596698126078), ("launch-a/launch-c", True, 0.8453712585852343), ("launch-b/launch-c", True, 0.8325554391135136), ("acquisition-a/acquisition-b", True, 0.8569538750437123),
    ("company-launch/company-earnings", False, 0.6025584145362265), ("person-keynote/person-board", False, 0.5819076163897473), ("keyword-a/keyword-b", False, 0.6820018176302818), ("primary-launch/supplier-prep", False, 0.6599796263271241),
    ("model-release/partner-integration", False, 0.6415239975167656), ("bridge-a/bridge-b", True, 0.7129146048450659), ("bridge-a/bridge-c", False, 0.5608848656272563), ("bridge-b/bridge-c", False, 0.6627662246943956),
    ("order-a/order-b", True, 0.9398104943477267), ("order-a/order-c", False, 0.6481525054739777), ("order-a/order-d", True, 0.8390029422198378), ("order-b/order-c", False, 0.6441851824387066), ("order-b/order-d", True, 0.8328127083559015),
    ("order-c/order-d", False, 0.603307614417498), ("incremental-a/incremental-b", True, 0.9250229767426137), ("incremental-a/incremental-c", False, 0.563900814999887), ("incremental-b/incremental-c", False, 0.5518361393523827),
]


def test_labelled_pairs_give_the_published_metrics(spark):
    pairs = spark.createDataFrame(PAIRS, "pair string, expected boolean, similarity double")
    judged = pairs.withColumn("d", clustering.match_decision(F.col("similarity"))).withColumn("predicted", F.col("d.decision") == "match")
    m = evaluation.confusion(judged, "expected", "predicted").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (9, 0, 12, 0) and (m.precision, m.recall, m.false_merge_rate, m.false_split_rate) == (1, 1, 0, 0)
    sweep = evaluation.threshold_sweep(pairs, "expected", "similarity")
    assert evaluation.best_f1(sweep, "threshold").first().threshold == 0.7129146048450659
    assert evaluation.best_zero_false_merge(sweep, F.desc("threshold")).first().threshold == 0.7129146048450659
    negatives = pairs.where("NOT expected").agg(F.max("similarity")).first()[0]
    assert negatives == 0.6820018176302818


def test_decisions_and_assignment(spark):
    sims = spark.createDataFrame([(0.7,), (0.6999999,), (-0.5,), (1.0,)], "s double").select(clustering.match_decision(F.col("s")).alias("d")).collect()
    assert [(r.d.decision, r.d.score) for r in sims] == [("match", 0.7), ("no-match", 0.6999999), ("no-match", 0.0), ("match", 1.0)]
    for bad in (1.5, float("nan"), None):
        with pytest.raises(Exception, match="similarity"):
            spark.createDataFrame([(bad,)], "s double").select(clustering.match_decision(F.col("s"))).collect()
    articles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "article_id string")
    d = spark.createDataFrame([("b", "s1", "no-match"), ("c", "s2", "match"), ("c", "s1", "match"), ("d", "s1", "no-match"), ("d", "s3", "match")], "article_id string, story_id string, decision string")
    out = {r.article_id: (r.kind, r.reason, r.story_id, r.considered, r.matching, list(r.matching_ids)) for r in clustering.assign(articles, d).collect()}
    assert out == {"a": ("seed-new-story", "no-candidates", None, 0, 0, []), "b": ("seed-new-story", "no-matching-candidates", None, 1, 0, []), "c": ("seed-new-story", "ambiguous-matching-candidates", None, 2, 2, ["s1", "s2"]), "d": ("assign-existing-story", None, "s3", 2, 1, [])}


def test_evaluation_edges(spark):
    pairs = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.2)], "e boolean, s double")
    got = {r.threshold: (r.tp, r.fp, r.tn, r.fn) for r in evaluation.threshold_sweep(pairs, "e", "s", with_zero=True).collect()}
    assert got == {0.0: (2, 1, 0, 0), 0.2: (2, 1, 0, 0), 0.5: (1, 1, 0, 1)}
    assert evaluation.best_zero_false_merge(evaluation.threshold_sweep(pairs, "e", "s"), F.desc("threshold")).count() == 0
    stages = spark.createDataFrame([("a", True, True), ("b", False, False)], "stage string, applicable boolean, correct boolean")
    acc = evaluation.stage_accuracy(stages)
    assert {r.stage: r.accuracy for r in acc.collect()} == {"a": 1.0, "b": 1.0} and evaluation.regression_gate(acc).first().passed
    h = {r.le: r["count"] for r in metrics.histogram(spark.createDataFrame([("x", 0.01), ("x", 0.3), ("x", 99.0)], "k string, v double"), "k", "v").collect()}
    assert h["0.01"] == 1 and h["0.5"] == 2 and h["30"] == 2 and h["+Inf"] == 3
    with pytest.raises(ValueError):
        readmodels.check_limit(0)


def test_leases(spark):
    def state(*events):
        s, said = None, []
        for e in events:
            s, what = research.step(s, dict(zip(("kind", "at_ms", "token", "lease_ms", "result"), e, strict=True)))
            said.append(what)
        return s, said

    new, claim = ("create", 0, None, None, "r"), ("claim", 10, "t1", 100, None)
    assert state(claim)[1] == ["missing"]
    s, said = state(new, new, ("create", 1, None, None, "other"), claim, ("claim", 99, "t2", 200, None), ("claim", 100, "t2", 200, None))
    assert said == ["created", "replayed", "conflict", "claimed", "held", "claimed"] and (s["token"], s["started_ms"]) == ("t2", 10)
    s, said = state(new, claim, ("claim", 100, "t2", 200, None), ("complete", 110, "t1", None, "x"), ("complete", 120, "t2", None, "x"), ("complete", 121, "t2", None, "x"), ("complete", 121, "t2", None, "y"), ("fail", 122, "t2", None, "x"), ("claim", 999, "t3", 1000, None))
    assert said[3:] == ["conflict", "completed", "replayed", "conflict", "conflict", "terminal"] and s["ended_ms"] == 120
    events = spark.createDataFrame([(1, 0, *new), (1, 1, *claim), (1, 2, "fail", 50, "t1", None, "e"), (2, 0, *claim)], "run_id long, pos long, kind string, at_ms long, token string, lease_ms long, result string")
    out = {r.run_id: r for r in research.lease_states(events).collect()}
    assert (out[1].status, out[1].ended_ms, out[1].claims) == ("FAILED", 50, 1) and out[2].status is None


def test_budgets(spark):
    calls = [(1, 0, "model", 0), (1, 1, "tool", 5), (1, 2, "model", 6), (1, 3, "model", 7), (2, 0, "tool", 0), (2, 1, "model", 20), (3, 0, "tool", 19)]
    out = {r.run_id: (r.model_calls, r.tool_calls, r.stopped_at, r.stop_reason) for r in research.budget_accounting(spark.createDataFrame(calls, "run_id long, pos long, kind string, elapsed_ms long"), 2, 9, 20).collect()}
    assert out == {1: (2, 1, 3, "model-budget-exhausted"), 2: (0, 1, 1, "deadline-exceeded"), 3: (0, 1, None, None)}


def test_registration(spark):
    c = spark.createDataFrame([(1, 0, "u", "c"), (2, 0, "u", "c"), (3, 0, "u", "c")], "run_id long, pos long, url string, canonical_url string")
    r = spark.createDataFrame([(1, 0, "u", "c", "s"), (2, 0, "u", "x", "s"), (3, 0, "u", "c", "s"), (3, 1, "v", "d", "s")], "run_id long, pos long, url string, canonical_url string, source_id string")
    assert {x.run_id: x.matches for x in research.registration_matches(c, r).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("seed,unknown", [(1, False), (2, True)])
def test_repeated_vectors_fold_as_any_others(spark, seed, unknown):
    """Few different vectors, a zero one among them, in windows that overlap."""
    rng = random.Random(seed)
    some = np.random.default_rng(seed).normal(size=(9, 3))
    some /= np.linalg.norm(some, axis=1)[:, None]
    some[8] = 0
    rows = [(k, None if rng.random() < 0.1 else rng.randrange(0, 30 * HOUR)) for k in range(120)]
    vectors = [some[rng.randrange(9)] for _ in rows]
    df = spark.createDataFrame([(k, f"a{k}", at, vectors[k].tolist()) for k, at in rows], "seq long, article_id string, at_ms long, vector array<double>")
    out = clustering.cluster(df, 2 * HOUR, threshold=0.8, include_unknown=unknown, tile=4)
    assert sorted((r.seq, r.kind, r.story_seq, r.considered, r.matching, list(r.matching_seqs)) for r in out.collect()) == plain(rows, vectors, 2 * HOUR, 0.8, unknown)


def test_a_hot_story_has_a_row_for_an_article_and_not_for_a_pair(spark, monkeypatch):
    """20,000 equal articles in a window, and 3,000 that nearly equal each other: what is written stays in proportion."""
    written = []
    monkeypatch.setattr(clustering, "settle", lambda df: written.append(settle(df)) or written[-1])
    equal = spark.range(20_000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("article_id"), (F.col("id") % 1000).alias("at_ms"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    out = clustering.cluster(equal, HOUR)
    assert out.groupBy("kind", "story_seq").count().sort("kind").collect() == [("MATCHED", 0, 19_999), ("SEED", 0, 1)]
    assert max(df.count() for df in written) <= 20_000
    written.clear()
    near = equal.where("seq < 3000").withColumn("vector", F.array(F.lit(1.0), F.col("seq") / 1e6))
    out = clustering.cluster(near, HOUR, tile=256)
    assert out.groupBy("kind", "story_seq").count().sort("kind").collect() == [("MATCHED", 0, 2_999), ("SEED", 0, 1)]
    assert max(df.count() for df in written) <= 2 * 12 * 3000


@pytest.mark.parametrize("seed", [1, 2])
def test_the_grid_of_two_thresholds_is_that_of_all_comparisons(spark, seed):
    rng = random.Random(seed)
    signal = lambda: rng.choice([None, -0.5, 0.0, 0.25, 0.5, 1.0])
    pairs = [(signal(), signal(), rng.random() < 0.4) for _ in range(60)]
    df = spark.createDataFrame(pairs, "x double, y double, same boolean")
    got = {(r.first_threshold, r.second_threshold): (r.tp, r.fp, r.tn, r.fn) for r in evaluation.threshold_grid(df, "same", "x", "y").collect()}
    reaches = lambda v, t: v is not None and t is not None and v >= t
    want = {}
    for a in {0.0, *(x for x, _, _ in pairs)}:
        for b in {0.0, *(y for _, y, _ in pairs)}:
            hits = [reaches(x, a) and reaches(y, b) for x, y, _ in pairs]
            want[a, b] = tuple(sum(h == hit and p[2] == same for h, p in zip(hits, pairs, strict=True)) for hit, same in ((True, True), (True, False), (False, False), (False, True)))
    assert got == want
    assert evaluation.threshold_grid(df.limit(0), "same", "x", "y").count() == 0


def test_assertions_take_tasks_by_their_rows(spark, monkeypatch):
    """What a task sorts or sums up doesn't grow with the tables."""
    monkeypatch.setattr(graph, "ROWS_A_TASK", 100)
    monkeypatch.setattr(integrity, "FEW", 10)
    rows = spark.range(2000).select((F.col("id") % 1000).alias("k"))
    twice = integrity.repeated_keys(rows, ["k"], "once").select("key", F.spark_partition_id().alias("task")).collect()
    assert sorted(int(r.key) for r in twice) == list(range(1000)) and len({r.task for r in twice}) >= 15
    lost = integrity.missing_references(rows, "k", spark.range(500, 1500).union(spark.range(500, 600)).toDF("t"), "t", "there").select("key", F.spark_partition_id().alias("task")).collect()
    assert sorted(int(r.key) for r in lost) == sorted([*range(500)] * 2) and len({r.task for r in lost}) >= 15


def test_growing_tables_are_not_sent_through_the_driver(spark):
    """A join of tables that grow with the articles has no broadcast side, however small they are."""
    articles = spark.createDataFrame([(k, f"a{k}", k * HOUR, [1.0, float(k % 2)]) for k in range(8)], "seq long, article_id string, at_ms long, vector array<double>")
    first = articles.where("seq < 4")
    rows = settle(clustering.cluster(first, HOUR))
    stories = clustering.story_state(rows, first)
    for df in (clustering.cluster(articles.where("seq >= 4"), HOUR, stories=settle(stories)), stories):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_candidates_take_tasks_by_their_pairs(spark, monkeypatch):
    """The articles of one full bucket meet its stories in several tasks, each pair once."""
    monkeypatch.setattr(candidates, "PAIRS_A_TASK", 100)
    articles = spark.range(60).select(F.col("id").alias("article_id"), (F.col("id") % 3 + 5000).alias("at_ms"))
    stories = spark.range(40).select(F.col("id").cast("string").alias("story_id"), (F.col("id") % 2 + 4000).alias("first_ms"), (F.col("id") % 2 + 4500).alias("last_ms"))
    rows = candidates.candidates(articles, stories, HOUR).select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.article_id, int(r.story_id)) for r in rows) == [(a, s) for a in range(60) for s in range(40)]
    assert {r.time_distance_ms for r in rows} == {499, 500, 501, 502} and len({r.task for r in rows}) >= 8


def _rows_shuffled(df):
    """The rows written by each shuffle of a query that has been run, the largest first."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        nodes += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    return sorted(found, reverse=True)


def test_candidates_shuffle_few_rows_of_long_stories(spark):
    """Stories of a thousand windows are a few rows each, and all pairs come once."""
    articles = spark.range(200).select(F.col("id").alias("article_id"), (F.col("id") * 5000).alias("at_ms"))
    stories = spark.range(50).select(F.col("id").cast("string").alias("story_id"), (F.col("id") * 100).alias("first_ms"), (F.col("id") * 100 + 1_000_000).alias("last_ms"))
    out = candidates.candidates(articles, stories, 1000)
    assert sorted((r.article_id, int(r.story_id), r.time_distance_ms) for r in out.collect()) == [(a, s, max(0, s * 100 - a * 5000)) for a in range(200) for s in range(50) if a * 5000 >= s * 100 - 1000]
    assert 200 <= _rows_shuffled(out)[0] <= 50 * 8


def test_candidates_cut_a_full_bucket_along_both_sides(spark, monkeypatch):
    """Rows copied to the parts of a full bucket go with the root of its parts, and these with the cores."""
    monkeypatch.setattr(candidates, "PAIRS_A_TASK", 100)
    articles = spark.range(300).select(F.col("id").alias("article_id"), (F.col("id") % 3 + 5000).alias("at_ms"))
    stories = spark.range(1000).select(F.col("id").cast("string").alias("story_id"), (F.col("id") % 2 + 4000).alias("first_ms"), (F.col("id") % 2 + 4500).alias("last_ms"))
    out = candidates.candidates(articles, stories, HOUR).select("*", F.spark_partition_id().alias("task"))
    found = out.collect()
    assert sorted((r.article_id, int(r.story_id)) for r in found) == [(a, s) for a in range(300) for s in range(1000)] and len({r.task for r in found}) >= 40
    assert sum(_rows_shuffled(out)) <= 20 * 1300
