"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.plans import capable, connect, evaluate, ingest, story

FLAGSHIP = "story_clustering"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**ingest.QUERIES, **story.QUERIES, **evaluate.QUERIES, **capable.QUERIES, **connect.QUERIES}
SQL: dict[str, str] = {**ingest.SQL, **story.SQL, **evaluate.SQL, **capable.SQL, **connect.SQL}
