"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise

EDGES_A_TASK = 20_000  # few edges aren't dealt to as many tasks as there are shuffle partitions; a round has some ten stages
PARTITIONS_A_TASK = 8  # a task sorts the partitions that it takes one by one


def _met_anew(least: DataFrame) -> DataFrame:
    """The aggregate under a key that Spark takes for a new one.

    Else the join below would run in the aggregate's own stage, where Spark
    cannot split what a hub's edges make one task read.
    """
    a = F.col("a")
    return least.withColumn("a", F.concat(a, F.lit(b"")) if least.schema["a"].dataType.typeName() == "binary" else a.bitwiseXOR(F.lit(0).cast("long")))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above a node is linked to the least node around it."""
    around = _both_ways(edges).coalesce(tasks)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
    return around.where("b > a").join(_met_anew(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its neighbours below it are linked to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
    return down.join(_met_anew(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b: both long or both binary); the label is the component's least node.

    Rounds grow with the logarithm of the longest path. Each is written to the
    shared folder; hubs are only met in joins, which can be split. A round's
    stages have tasks by its edges, however many shuffle partitions are set.
    """
    now = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    least = 8 + int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_TASK
    state = (now.count(), None)
    while True:
        tasks = least + state[0] // EDGES_A_TASK
        after = materialise(_small_star(_large_star(now, tasks), tasks), "edges")
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(now)
        now = after
        if tuple(sums) == state:
            break
        state = tuple(sums)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
