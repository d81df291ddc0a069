"""Evaluation of labelled pairs: signals, summaries, threshold sweeps, gates.

Sweeps count what lies at or above a threshold with one ordered pass over the
distinct thresholds, so they cost a sort of those, not thresholds times pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scenario_pairs(rows: DataFrame, scenario: str, pos: str, *payload: str) -> DataFrame:
    """Pairs (left_*, right_*) of the rows of a scenario, the left before the right."""
    side = lambda name: rows.select(F.col(scenario), F.col(pos).alias(f"{name}_{pos}"), *[F.col(p).alias(f"{name}_{p}") for p in payload])
    both = side("left").join(side("right"), scenario)
    return both.where(F.col(f"left_{pos}") < F.col(f"right_{pos}"))


def token_statistics(rows: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    total = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode(F.array_distinct(tokens_col)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # total is one row


def weighted_jaccard(pairs: DataFrame, weights: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """(keys, weighted_jaccard): weight of shared tokens by that of all; a token without a positive weight raises."""
    each = pairs.select(*keys, F.explode(F.array_union(left, right)).alias("token"), left, right)
    each = each.select(*keys, "token", (F.array_contains(left, F.col("token")) & F.array_contains(right, F.col("token"))).alias("both"))
    w = each.join(weights.select("token", "idf"), "token", "left").withColumn("idf", F.when(F.col("idf") > 0, F.col("idf")).otherwise(F.raise_error(F.lit("a token without a positive weight")).cast("double")))
    found = w.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("both"), F.col("idf"))), F.lit(0.0)) / F.sum("idf")).alias("weighted_jaccard"))
    return pairs.select(*keys).join(found, list(keys), "left").withColumn("weighted_jaccard", F.coalesce("weighted_jaccard", F.lit(0.0)))


def distinctive_jaccard(pairs: DataFrame, statistics: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """(keys, cutoff, shared, distinctive_jaccard) for each observed document frequency as the cutoff: tokens of at most that frequency count; 0 without any."""
    cutoffs = statistics.select(F.col("df").alias("cutoff")).distinct()
    each = pairs.select(*keys, F.explode(F.array_union(left, right)).alias("token"), left, right)
    each = each.select(*keys, "token", (F.array_contains(left, F.col("token")) & F.array_contains(right, F.col("token"))).alias("both"))
    by_df = each.join(statistics.select("token", "df"), "token").groupBy(*keys, "df").agg(F.count_if("both").alias("shared"), F.count("*").alias("every"))
    grid = pairs.select(*keys).crossJoin(cutoffs).join(by_df, list(keys), "left")  # every pair at every cutoff is the result asked for
    kept = F.col("df") <= F.col("cutoff")
    out = grid.groupBy(*keys, "cutoff").agg(F.coalesce(F.sum(F.when(kept, F.col("shared"))), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.when(kept, F.col("every"))), F.lit(0)).alias("every"))
    return out.select(*keys, "cutoff", "shared", F.when(F.col("every") > 0, F.col("shared") / F.col("every")).otherwise(0.0).alias("distinctive_jaccard"))


def summarize(pairs: DataFrame, expected: str, signals: Sequence[str]) -> DataFrame:
    """(expected, signal, evaluated, missing, minimum, mean, maximum) of each signal."""
    stacked = pairs.select(expected, F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])).alias("x"))
    return stacked.groupBy(expected, "x.signal").agg(F.count("x.v").alias("evaluated"), F.count_if(F.col("x.v").isNull()).alias("missing"), F.min("x.v").alias("minimum"), F.avg("x.v").alias("mean"), F.max("x.v").alias("maximum"))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1, false_merge_rate, false_split_rate; 0 where the denominator is."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": share(2 * precision * recall, precision + recall), "false_merge_rate": share(fp, fp + tn), "false_split_rate": share(fn, tp + fn)}


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rates(*[F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn")]))


def threshold_sweep(pairs: DataFrame, expected: str, signal: str, with_zero: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, fp, tn, fn, rates) at each observed value of the signal, and 0 if asked: a pair counts as joined at or above the threshold."""
    points = pairs.groupBy(*by, F.col(signal).alias("threshold")).agg(F.count_if(F.col(expected)).alias("p"), F.count_if(~F.col(expected)).alias("n"))
    if with_zero:
        zero = (points.select(*by).distinct() if by else pairs.sparkSession.range(1).select()).withColumns({"threshold": F.lit(0.0), "p": F.lit(0), "n": F.lit(0)})
        points = points.unionByName(zero).groupBy(*by, "threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    counts = points.select(*by, "threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("ps"), F.sum("n").over(every).alias("ns"))
    return with_rates(counts.select(*by, "threshold", "tp", "fp", (F.col("ns") - F.col("fp")).alias("tn"), (F.col("ps") - F.col("tp")).alias("fn")))


def threshold_grid(pairs: DataFrame, expected: str, first: str, second: str) -> DataFrame:
    """(first_threshold, second_threshold, counts, rates) for {0 and observed} x {0 and observed}: both signals have to reach theirs.

    Pairs are counted once for each two values. Those counts lie on the grid and are
    summed along it, from the largest second threshold and then from the largest
    first one, so the work is that of the grid's own rows. A null signal reaches no
    threshold, and a null threshold is reached by nothing. No pairs: no rows.
    """
    values = lambda s: pairs.select(F.col(s).alias(s)).unionByName(pairs.sparkSession.range(1).select(F.lit(0.0).alias(s))).distinct()
    cells = pairs.groupBy(F.col(first).alias("first_threshold"), F.col(second).alias("second_threshold")).agg(F.count_if(F.col(expected)).alias("p"), F.count_if(~F.col(expected)).alias("n"))
    every = cells.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).where("all_p IS NOT NULL")  # one row, or none
    keys = ["first_threshold", "second_threshold"]
    grid = values(first).withColumnRenamed(first, keys[0]).crossJoin(values(second).withColumnRenamed(second, keys[1])).join(cells, keys, "left")
    down = lambda by, along: Window.partitionBy(by).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(down(*keys)) for c in ("p", "n")})
    grid = grid.withColumns({c: F.sum(c).over(down(*reversed(keys))) for c in ("p", "n")})
    known = F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()
    met = grid.select(*keys, *[F.when(known, F.col(c)).otherwise(0).alias(name) for c, name in (("p", "tp"), ("n", "fp"))]).crossJoin(F.broadcast(every))
    return with_rates(met.select(*keys, "tp", "fp", (F.col("all_n") - F.col("fp")).alias("tn"), (F.col("all_p") - F.col("tp")).alias("fn")))


def best_f1(sweep: DataFrame, *order: str) -> DataFrame:
    """The row with the best f1, then the least false merge rate, then the best recall, then the first generated (``order`` ascending)."""
    return sweep.orderBy(F.desc("f1"), "false_merge_rate", F.desc("recall"), *order).limit(1)


def best_zero_false_merge(sweep: DataFrame, *order: Column) -> DataFrame:
    """Of rows without a false merge and with a true one, the best recall, then f1, then ``order``."""
    return sweep.where("fp = 0 AND tp > 0").orderBy(F.desc("recall"), F.desc("f1"), *order).limit(1)


def extreme_pairs(pairs: DataFrame, expected: str, signal: str, same: bool, most: int, *order: str) -> DataFrame:
    """The pairs that a signal tells apart worst: the least similar that belong together, or the most similar that don't; ties go by ``order``."""
    by = F.col(signal).asc() if same else F.col(signal).desc()
    return pairs.where(F.col(expected) == same).orderBy(by, *order).limit(most)


def stage_accuracy(results: DataFrame, stage: str = "stage", applicable: str = "applicable", correct: str = "correct") -> DataFrame:
    """(stage, evaluated, correct, accuracy); accuracy is 1 where nothing was evaluated."""
    counts = results.groupBy(stage).agg(F.count_if(F.col(applicable)).alias("evaluated"), F.count_if(F.col(applicable) & F.col(correct)).alias("correct"))
    return counts.withColumn("accuracy", F.when(F.col("evaluated") == 0, 1.0).otherwise(F.col("correct") / F.col("evaluated")))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: tp, fp, tn, fn and rates."""
    e, p = F.col(expected), F.col(predicted)
    return with_rates(rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn")))


def regression_gate(accuracy: DataFrame, minimum: float = 1.0) -> DataFrame:
    """One row: passed if every stage reaches the minimum and nothing failed."""
    return accuracy.agg((F.min("accuracy") >= minimum).alias("reached"), F.sum(F.col("evaluated") - F.col("correct")).alias("failures")).select((F.col("reached") & (F.col("failures") == 0)).alias("passed"), "failures")


def release_gate(measured: DataFrame, published: DataFrame, on: str = "metric", value: str = "value") -> DataFrame:
    """(metric, measured, published, passed) of every metric of either side; one that a side lacks, or that differs, fails."""
    both = measured.select(on, F.col(value).alias("measured")).join(published.select(on, F.col(value).alias("published")), on, "full")
    return both.select(on, "measured", "published", F.coalesce(F.col("measured") == F.col("published"), F.lit(False)).alias("passed"))
