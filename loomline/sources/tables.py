"""Gold tables as Parquet, replaced whole and atomically by version folders."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class Table:
    """A table under a path. A version is written beside the old one and becomes current by a rename of its marker."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._hadoop(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        return sorted(n[5:] for n in names if n.startswith("done-"))

    def read(self) -> DataFrame | None:
        """The current version, or None before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v-{versions[-1]}") if versions else None

    def replace(self, df: DataFrame, *partition_by: str) -> DataFrame:
        version = f"{time.time_ns():020d}"
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/v-{version}")
        marker = self._hadoop(f"{self.path}/done-{version}")
        self._fs.create(marker).close()
        for old in self._versions()[:-2]:  # a reader may still hold the one before
            self._fs.delete(self._hadoop(f"{self.path}/done-{old}"), True)
            self._fs.delete(self._hadoop(f"{self.path}/v-{old}"), True)
        return self.read()
