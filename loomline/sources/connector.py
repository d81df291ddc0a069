"""Landed responses as a Spark data source, batch and stream, with a log of what each fetch gave.

A fetcher's round is a batch folder with a folder for each source, written by
``land`` and complete once Spark's ``_SUCCESS`` stands in it. ``spark.read`` and
``spark.readStream`` with the format ``landed-news`` give a row for each response;
a source's files are partitions of their own, so a source that answers most is many
tasks. A stream's offset is the number of the last batch taken, so a restart
goes on after it. ``read_responses`` turns the rows into articles, ``fetch_log``
tells for each fetch what came of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from loomline.functions.vocabulary import PROVIDER_MAX
from loomline.operators.research import discovery_failure
from loomline.sources.feeds import read_feeds, read_gnews

FORMAT = "landed-news"
SCHEMA = "source_id string, batch long, fetch_id string, fetched_at timestamp, error_kind string, status int, body string"
COLUMNS = ("fetch_id", "fetched_at", "error_kind", "status", "body")
ROWS = 256  # responses held by a task at a time
BUFFER = 1 << 20  # bytes read ahead of a column; without it a reader holds a whole row group's


def land(responses: DataFrame, path: str, batch: int) -> None:
    """Write a round's responses (source_id and COLUMNS) as a batch. A round that broke off is landed again under its number; one that is complete raises."""
    if batch < 0:
        raise ValueError("batches are numbered from 0")
    folder = f"{path.rstrip('/')}/{batch:012d}"
    jvm = responses.sparkSession._jvm.org.apache.hadoop.fs.Path
    done = jvm(f"{folder}/_SUCCESS")
    if done.getFileSystem(responses.sparkSession._jsc.hadoopConfiguration()).exists(done):
        raise ValueError(f"batch {batch} has landed")
    responses.select("source_id", *COLUMNS).write.mode("overwrite").partitionBy("source_id").parquet(folder)


@dataclass
class File(InputPartition):
    """A file of one source's responses."""

    source_id: str
    batch: int
    path: str


class _Folder:
    """What has landed under a path, by any file system that Arrow knows (local, HDFS, S3, GCS)."""

    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ValueError(f"{FORMAT} needs a path")
        self.path = re.sub(r"^file:/+", "/", options["path"]).rstrip("/")
        self.sources = {s.strip() for s in options["sources"].split(",")} if options.get("sources") else None

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def last(self) -> int:
        """The last batch before which all are complete; -1 before the first."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        last = -1
        for number in sorted(int(f.base_name) for f in found if f.base_name.isdigit()):
            if system.get_file_info(f"{root}/{number:012d}/_SUCCESS").type != fs.FileType.File:
                break
            last = number
        return last

    def files(self, after: int, upto: int) -> list[File]:
        """The files of the batches after one number, up to another, in order."""
        from urllib.parse import unquote

        from pyarrow import fs

        system, root = self._system()
        out = []
        for batch in sorted(int(f.base_name) for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.isdigit()):
            if not after < batch <= upto:
                continue
            for folder in system.get_file_info(fs.FileSelector(f"{root}/{batch:012d}")):
                source = unquote(folder.base_name.removeprefix("source_id="))
                if folder.type != fs.FileType.Directory or self.sources is not None and source not in self.sources:
                    continue
                names = [f.path for f in system.get_file_info(fs.FileSelector(folder.path)) if f.base_name.endswith(".parquet")]
                out += [File(source, batch, name) for name in sorted(names)]
        return out

    def read(self, partition: File) -> Iterator:
        """A file's responses as Arrow batches."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, _ = self._system()
        types = [pa.string(), pa.timestamp("us", tz="UTC"), pa.string(), pa.int32(), pa.string()]
        with system.open_input_file(partition.path) as stream:
            for rows in pq.ParquetFile(stream, buffer_size=BUFFER, pre_buffer=False).iter_batches(batch_size=ROWS, columns=list(COLUMNS)):
                n = rows.num_rows
                own = [rows.column(c).cast(t) for c, t in zip(COLUMNS, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.source_id] * n, pa.string()), pa.array([partition.batch] * n, pa.int64()), *own], names=["source_id", "batch", *COLUMNS])


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> list[File]:
        return self.folder.files(-1, self.folder.last())

    def read(self, partition: File) -> Iterator:
        return self.folder.read(partition) if isinstance(partition, File) else iter(())  # no partitions: Spark asks for None


class _Stream(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.folder, self.begin = _Folder(options), int(options.get("startingbatch", 0))

    def initialOffset(self) -> dict:
        return {"batch": self.begin - 1}

    def latestOffset(self) -> dict:
        return {"batch": max(self.begin - 1, self.folder.last())}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return self.folder.files(start["batch"], end["batch"])

    def read(self, partition: File) -> Iterator:
        return self.folder.read(partition)


class LandedNews(DataSource):
    """Options: path; sources (ids with commas, default all); startingBatch of a stream (default 0)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(LandedNews)


def read_responses(responses: DataFrame, sources: Mapping[str, tuple[str, str]], limit: int = PROVIDER_MAX) -> DataFrame:
    """Responses with source_name, source_type, kind (of error, or null), articles and truncated. sources: as ``feeds.registry`` has them.

    A transport error that the fetcher told comes first, then a status outside 200
    to 299, then what the body is read as. A source that isn't registered has
    neither name nor type and is not read. Null bodies are read as empty ones.
    """
    if limit < 1:
        raise ValueError("a limit is a positive number")
    known = F.create_map(*[F.lit(x) for item in sources.items() for x in (item[0], item[1][0])]) if sources else F.create_map().cast("map<string,string>")
    kinds = F.create_map(*[F.lit(x) for item in sources.items() for x in (item[0], item[1][1])]) if sources else F.create_map().cast("map<string,string>")
    rows = responses.withColumns({"source_name": F.try_element_at(known, F.col("source_id")), "source_type": F.try_element_at(kinds, F.col("source_id"))})
    failed = F.coalesce("error_kind", F.when(~F.col("status").between(200, 299), "http"))
    readable = failed.isNull() & F.col("source_type").isNotNull()
    body = F.coalesce("body", F.lit(""))
    rows = rows.withColumns({"_api": F.when(readable & (F.col("source_type") == "api"), body), "_rss": F.when(readable & (F.col("source_type") == "rss"), body)})
    api = read_gnews(rows, body_col="_api", limit=min(limit, PROVIDER_MAX)).withColumnsRenamed({"error": "_api_error", "articles": "_api_articles", "truncated": "_api_truncated"})
    both = read_feeds(api, body_col="_rss", limit=limit)
    is_api, is_rss = F.col("_api").isNotNull(), F.col("_rss").isNotNull()
    none = F.array().cast(both.schema["articles"].dataType)
    return both.select(
        *responses.columns, "source_name", "source_type",
        F.coalesce(failed, F.when(is_api, F.col("_api_error")).when(is_rss, F.col("error"))).alias("kind"),
        F.when(is_api, F.col("_api_articles")).when(is_rss, F.col("articles")).otherwise(none).alias("articles"),
        (is_api & F.col("_api_truncated")).alias("truncated"),
    )


def fetch_log(read: DataFrame) -> DataFrame:
    """(source_id, batch, fetch_id, fetched_at, outcome, kind, status, reason, retryable, fetched, truncated) of each fetch; reason and retryable are null where it went well."""
    origin = F.when(F.col("source_type") == "api", "gnews").when(F.col("source_type") == "rss", "rss").otherwise("unsupported")
    wrong = F.col("source_type").isNull() | F.col("kind").isNotNull()
    failure = F.when(wrong, discovery_failure(origin, F.col("kind"), F.col("status")))
    rows = read.withColumn("_f", failure)
    return rows.select("source_id", "batch", "fetch_id", "fetched_at", F.when(wrong, "failed").otherwise("completed").alias("outcome"), "kind", "status", "_f.reason", "_f.retryable", F.size("articles").cast("long").alias("fetched"), "truncated")
