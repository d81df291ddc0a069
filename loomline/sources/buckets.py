"""Keyed tables in hash buckets, merged a batch at a time by any number of writers.

A version is a small file that names each bucket's folder. A merge reads the
buckets that its keys fall into, writes those anew beside the old ones and then
creates the next version, which only succeeds if nobody else has: the other
writer's rows are read again and the merge is made once more on top of them. So a
batch writes in proportion to its buckets, and no writer's rows are lost. Each
writer's batches have growing numbers; the last one done stands in the version, so
that a batch is merged once, whatever is replayed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEPT = 3  # versions whose folders stay for readers that are under way


class Conflict(Exception):
    """Somebody else created the version first."""


@dataclass
class Version:
    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)  # by bucket
    done: dict[str, int] = field(default_factory=dict)  # the last batch of each writer
    facts: dict[str, int] = field(default_factory=dict)  # what merges keep along with the rows
    schema: str | None = None  # JSON, that of the first rows


class BucketTable:
    """Rows under a path in ``buckets`` hash buckets of a key; the first rows merged give the schema."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.Path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._jvm.Path(f"{self.path}/versions"))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/versions"))]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The current version, or one by its number; number 0 has no rows."""
        numbers = self._numbers() if number is None else [number]
        if not numbers or numbers[-1] == 0:
            return Version()
        stream = self._fs.open(self._jvm.Path(f"{self.path}/versions/{numbers[-1]:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def read(self, version: Version | None = None, buckets: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (the current one), or of some of its buckets; None before the first rows."""
        version = version or self.version()
        if version.schema is None:
            return None
        schema = StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.path}/{folder}" for b, folder in sorted(version.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, version: Version) -> None:
        """Make a version current. Conflict if its number is taken."""
        at = self._jvm.Path(f"{self.path}/versions/{version.number:012d}")
        draft = self._jvm.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(version.__dict__).encode()))
        stream.close()
        context = self._jvm.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:  # without overwriting: on HDFS and local disks the second rename to a name fails
            context.rename(draft, at, self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(at):
                raise Conflict(str(version.number)) from e
            raise

    def merge(self, incoming: Callable[[Version], DataFrame], combine: Callable[[DataFrame, DataFrame | None], DataFrame], *, writer: str, batch: int, facts: Callable[[Version], dict[str, int]] | None = None, tries: int = 20) -> bool:
        """Merge a batch; False if that writer's batch was done before.

        incoming(version) gives the batch's rows, with the key, on top of a version.
        combine(rows, current) gives what the buckets of those rows hold afterwards,
        current being what they hold (None before the table's first rows), with the
        columns of current. A batch without rows is marked as done, too.
        """
        for _ in range(tries):
            now = self.version()
            if now.done.get(writer, -1) >= batch:
                return False
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            rows = incoming(now).persist()
            try:
                touched = sorted(str(r[0]) for r in rows.select(bucket).distinct().collect())  # as many as there are buckets
                folder, written, schema = f"data/{now.number + 1:012d}-{uuid.uuid4().hex}", {}, now.schema
                if touched:
                    current = self.read(now, touched)
                    merged = combine(rows, current)
                    merged = merged if current is None else merged.select(*current.columns)
                    schema = schema or merged.schema.json()
                    merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                    names = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.Path(f"{self.path}/{folder}"))]
                    written = {n[8:]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}
                after = Version(now.number + 1, {b: f for b, f in now.folders.items() if b not in touched} | written, now.done | {writer: batch}, now.facts | (facts(now) if facts else {}), schema)
                self.commit(after)
                return True
            except Conflict:
                self._fs.delete(self._jvm.Path(f"{self.path}/{folder}"), True)
            finally:
                rows.unpersist()
        raise Conflict(f"{tries} tries")

    def vacuum(self) -> int:
        """Delete what no version of the last KEPT names; the number of versions deleted. For one caller at a time, while no merge is under way."""
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        used = {f.rsplit("/", 1)[0] for n in kept for f in self.version(n).folders.values()}
        data = self._jvm.Path(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f"data/{s.getPath().getName()}" not in used:
                self._fs.delete(s.getPath(), True)
        for n in old:
            self._fs.delete(self._jvm.Path(f"{self.path}/versions/{n:012d}"), False)
        return len(old)
