"""Shared plumbing: input tables, scratch tables in the cluster's shared folder, row groups."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a local session may go without, and gets a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._loomline_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver find the shuffle files that no plan needs any more; else they stay until its next large collection."""
    for _ in range(2):  # what Python lets go of first can be collected the second time
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A key unique to each row. Only stable once the result is materialised."""
    return df.withColumn(name, F.monotonically_increasing_id())


def first_of_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the one whose columns, as JSON with nulls, come first."""
    cell = F.struct(*[F.col(c) for c in columns])
    shown = F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    first = df.groupBy(*keys).agg(F.min_by(F.struct(cell.alias("row")), shown).alias("first"))
    return first.select(*keys[:1], *[F.col("first.row")[c].alias(c) for c in columns])


def no_text_as_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


_holder: list = ["", None]


def hold_memory(name: str, drop) -> None:
    """Say whose caches this Python worker holds; ``drop`` frees them once another operator's task comes."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [name, drop]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df is named so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
