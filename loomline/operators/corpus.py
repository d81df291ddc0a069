"""Labelled ingestion cases: run the discovery steps over them and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import dedup, evaluation, freshness, normalize
from loomline.operators.graph import settle

STAGES = ("normalization", "canonical-url", "freshness", "deduplication", "outcome")


def actual_outcomes(cases: DataFrame, now_ms: int, policy: freshness.FreshnessPolicy) -> DataFrame:
    """(case_id, seq, reject_reason, canonical_url, classification, dedup_status, dedup_reason, duplicate_of, outcome) of each case.

    cases: case_id, seq (order), source and payload as VARIANT, fetched_at.
    """
    out = freshness.classify_freshness(
        normalize.normalize_articles(cases).select("case_id", "seq", "reject_reason", "article", F.col("article.published_at").alias("published_at"), F.col("article.discovered_at").alias("discovered_at")), now_ms, policy
    )
    out = settle(out.select("case_id", "seq", "reject_reason", "article", F.when(F.col("reject_reason").isNull(), F.col("freshness.classification")).alias("classification")))
    keys = dedup.article_keys(F.col("article.source.id"), F.col("article.external_id"), F.col("article.canonical_url"), F.col("article.publisher.name"), F.col("article.title"))
    judged = dedup.ordered_dedup(out.where("classification = 'fresh'").withColumn("keys", keys))
    names = out.select(F.col("seq").alias("original"), F.col("case_id").alias("duplicate_of"))
    judged = judged.join(names, "original", "left").select("seq", F.col("status").alias("dedup_status"), F.col("reason").alias("dedup_reason"), "duplicate_of")
    outcome = F.when(F.col("reject_reason").isNotNull(), "rejected-normalization").when(F.col("classification") != "fresh", "rejected-freshness").when(F.col("dedup_status") == "duplicate", "duplicate").otherwise("retained")
    return out.join(judged, "seq", "left").select("case_id", "seq", "reject_reason", F.col("article.canonical_url").alias("canonical_url"), "classification", "dedup_status", "dedup_reason", "duplicate_of", outcome.alias("outcome"))


def compare(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, stage, applicable, correct); expected has case_id and exp_reject_reason, exp_canonical_url, exp_classification, exp_dedup_status, exp_dedup_reason, exp_duplicate_of, exp_outcome. A stage applies if the case expects something of it."""
    both = expected.join(actual, "case_id", "left")
    same = lambda *names: [F.col(n).eqNullSafe(F.col(f"exp_{n}")) for n in names]
    always, fresh, keyed, url = F.lit(True), F.col("exp_classification").isNotNull(), F.col("exp_dedup_status").isNotNull(), F.col("exp_canonical_url").isNotNull()
    every = lambda tests: F.forall(F.array(*tests), lambda x: x)
    stages = [
        (STAGES[0], always, every(same("reject_reason"))), (STAGES[1], url, every(same("canonical_url"))), (STAGES[2], fresh, every(same("classification"))),
        (STAGES[3], keyed, every(same("dedup_status", "dedup_reason", "duplicate_of"))), (STAGES[4], always, every(same("outcome"))),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("stage"), a.alias("applicable"), c.alias("correct")) for n, a, c in stages])
    return both.select("case_id", F.explode(cells).alias("x")).select("case_id", "x.*")


def evaluate(cases: DataFrame, expected: DataFrame, now_ms: int, policy: freshness.FreshnessPolicy = freshness.FreshnessPolicy()) -> DataFrame:
    """Accuracy of each stage over the cases."""
    return evaluation.stage_accuracy(compare(actual_outcomes(cases, now_ms, policy), expected))


def corpus_violations(expected: DataFrame, order: DataFrame) -> DataFrame:
    """(rule, case_id) of cases that are given twice or are duplicates of no earlier case; order: case_id, seq."""
    twice = order.groupBy("case_id").count().where("count > 1").select(F.lit("case-once").alias("rule"), "case_id")
    earlier = order.select(F.col("case_id").alias("exp_duplicate_of"), F.col("seq").alias("first"))
    dup = expected.where("exp_duplicate_of IS NOT NULL").join(order, "case_id").join(earlier, "exp_duplicate_of", "left")
    return twice.unionByName(dup.where(~F.coalesce(F.col("first") < F.col("seq"), F.lit(False))).select(F.lit("duplicate-of-an-earlier-case").alias("rule"), "case_id"))
