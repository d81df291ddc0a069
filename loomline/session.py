"""A local session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; other settings as given."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | settings).getOrCreate()
