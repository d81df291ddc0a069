import time

import pytest
from pyspark.sql import functions as F

from loomline.functions.vocabulary import METRICS
from loomline.operators.observed import Collected, Pass, StreamMetrics, bounds

SOURCES = ("a", "b")


def fetched():
    return Pass("fetched").by("source_id", SOURCES, F.col("source"), ("articles_fetched_total", None, F.col("n")), ("articles_fresh_total", F.col("fresh"), None)).histogram("discovery_duration_seconds", F.col("s"), F.col("source") == "a", source_id="a")


ROWS = [("a", 3, True, 0.2), ("a", None, None, 40.0), ("b", 2, True, 0.2), ("b", 5, False, None), (None, 9, True, 0.1), ("c", 1, True, 0.1)]
WANT = {("articles_fetched_total", "source_id=a", None): 3, ("articles_fetched_total", "source_id=b", None): 7, ("articles_fresh_total", "source_id=a", None): 1, ("articles_fresh_total", "source_id=b", None): 1}


def counters(totals):
    return {k: v for k, v in totals.items() if k[0].endswith("_total")}


def test_the_action_for_the_rows_counts_them(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "source string, n long, fresh boolean, s double")
    rows, seen = fetched().attach(df.repartition(3))
    group = "one-pass"
    spark.sparkContext.setJobGroup(group, group)
    rows.select("source").write.parquet(str(tmp_path / "plain"))
    plain = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    found = seen.get
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == plain  # nothing is run for the metrics
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    collected = Collected()
    collected.add(fetched().read(found))
    collected.add(fetched().read(found))
    totals = collected.totals()
    assert counters(totals) == {k: 2 * v for k, v in WANT.items()}
    cell = lambda le: totals["discovery_duration_seconds_bucket", "source_id=a", le]
    assert [cell(le) for le in ("0.1", "0.25", "30", "+Inf")] == [0, 2, 2, 4] and totals["discovery_duration_seconds_sum", "source_id=a", None] == pytest.approx(80.4)
    assert {(r.metric, r.labels, r.le): r.value for r in collected.frame(spark).collect()} == totals


def test_empty_rows_give_zeros(spark):
    rows, seen = fetched().attach(spark.createDataFrame([], "source string, n long, fresh boolean, s double"))
    rows.write.format("noop").mode("overwrite").save()
    assert set(fetched().read(seen.get).values()) == {0}


def test_a_stream_tells_each_batch_once(spark, tmp_path):
    schema = "source string, n long, fresh boolean, s double"
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    collected = Collected()
    listener = StreamMetrics(collected, fetched())
    spark.streams.addListener(listener)
    try:
        for part in (ROWS[:2], ROWS[2:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
            stream = fetched().attach_stream(spark.readStream.schema(schema).parquet(path))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):  # listeners are told a little later
            if counters(collected.totals()) == WANT:
                break
            time.sleep(0.1)
        assert counters(collected.totals()) == WANT

        class Told:
            class progress:
                id, batchId, observedMetrics = next(iter(listener._done)), 0, {"fetched": None}

        listener.onQueryProgress(Told)
        assert counters(collected.totals()) == WANT
    finally:
        spark.streams.removeListener(listener)


def test_names_and_labels_are_closed():
    assert len(METRICS) == 26 and bounds("research_execution_duration_seconds")[-1] == 60 and bounds("story_clustering_duration_seconds")[0] == 0.005
    for wrong in (lambda: Pass("p").counter("no_total"), lambda: Pass("p").counter("articles_fresh_total"), lambda: Pass("p").counter("articles_fresh_total", source_id="a", more="b"), lambda: Pass("p").histogram("articles_fresh_total", F.lit(1), source_id="a"), lambda: Collected().add({("x", "", None): -1})):
        with pytest.raises(ValueError):
            wrong()
