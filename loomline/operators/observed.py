"""Named metrics, counted while a query's rows pass, in batches and in streams.

A ``Pass`` says which rows count for which metric and labels and is attached to a
DataFrame: the action that the rows are needed for counts them as well, no job is
run for the metrics. What a pass saw goes to a ``Collected``, of a stream by
``StreamMetrics`` with each micro-batch. Labels are of closed sets (sources of the
registry, outcomes), as each is a column of the pass. Totals are those of this
process and start from nothing.

An action that doesn't read all rows (a limit, a test for emptiness) or reads them
twice would count wrongly: attach a pass right before what writes the rows. Executors
that are lost change nothing, as only finished tasks are counted.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from loomline.functions.vocabulary import DURATION_BUCKETS, METRICS, RESEARCH_BUCKETS, STORY_BUCKETS

Key = tuple[str, str, str | None]  # name, labels, upper bound


def bounds(metric: str) -> tuple[float, ...]:
    """The upper bounds of a histogram."""
    return STORY_BUCKETS if metric.startswith("story_") else RESEARCH_BUCKETS if metric.startswith("research_") else DURATION_BUCKETS


def label_text(metric: str, labels: Mapping[str, str]) -> str:
    """Labels as ``name=value`` in the metric's order. An unknown metric, a missing or a strange label raises."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    if set(labels) != set(METRICS[metric]):
        raise ValueError(f"{metric} has the labels {METRICS[metric]}")
    return ",".join(f"{name}={labels[name]}" for name in METRICS[metric])


class Collected:
    """Totals by name, labels and bound; safe for listeners' threads."""

    def __init__(self):
        self._values: dict[Key, float] = {}
        self._lock = threading.Lock()

    def add(self, found: Mapping[Key, float]) -> None:
        with self._lock:
            for key, value in found.items():
                if value < 0:
                    raise ValueError(f"{key} can't fall")
                self._values[key] = self._values.get(key, 0) + value

    def totals(self) -> dict[Key, float]:
        with self._lock:
            return dict(self._values)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(metric, labels, le, value), sorted: as many rows as there are labels and bounds."""
        rows = sorted(((m, text, le, float(v)) for (m, text, le), v in self.totals().items()), key=str)
        return spark.createDataFrame(rows, "metric string, labels string, le string, value double")


class Pass:
    """The metrics of one reading of some rows, by a name that no other pass of the query has."""

    def __init__(self, name: str):
        self.name = name
        self.parts: list[tuple[Key, Column]] = []

    def counter(self, metric: str, rows: Column | None = None, amount: Column | None = None, **labels: str) -> Pass:
        """Count the rows for which a condition holds (null: it doesn't), or sum their amounts (null: 0)."""
        if not metric.endswith("_total"):
            raise ValueError(f"{metric} is no counter")
        holds = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
        value = F.count_if(holds) if amount is None else F.sum(F.when(holds, amount))
        self.parts.append(((metric, label_text(metric, labels), None), value))
        return self

    def histogram(self, metric: str, seconds: Column, rows: Column | None = None, **labels: str) -> Pass:
        """Cumulative counts of seconds (null: not seen) up to each bound, their number and their sum."""
        if not metric.endswith("_seconds"):
            raise ValueError(f"{metric} is no histogram")
        text, seen = label_text(metric, labels), seconds if rows is None else F.when(rows, seconds)
        self.parts += [((f"{metric}_bucket", text, f"{b:g}"), F.count_if(F.coalesce(seen <= b, F.lit(False)))) for b in bounds(metric)]
        self.parts += [((f"{metric}_bucket", text, "+Inf"), F.count(seen)), ((f"{metric}_count", text, None), F.count(seen)), ((f"{metric}_sum", text, None), F.sum(seen))]
        return self

    def by(self, label: str, values: Sequence[str], column: Column, *counters: tuple, **fixed: str) -> Pass:
        """A counter (metric, condition, amount) for each value of a label that a column holds."""
        for metric, rows, amount in counters:
            for value in values:
                mine = column == value
                self.counter(metric, mine if rows is None else mine & rows, amount, **fixed, **{label: value})
        return self

    def _columns(self) -> list[Column]:
        if not self.parts:
            raise ValueError("a pass has a metric at least")
        return [value.alias(f"m{k}") for k, (_, value) in enumerate(self.parts)]

    def read(self, seen: Mapping[str, float | None]) -> dict[Key, float]:
        """What a finished reading saw, by key; parts of one key are added up."""
        out: dict[Key, float] = {}
        for k, (key, _) in enumerate(self.parts):
            out[key] = out.get(key, 0) + (seen.get(f"m{k}") or 0)
        return out

    def attach(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        """The same rows; when their action is done, the observation holds what was seen (``read(observation.get)``)."""
        observation = Observation(self.name)
        return df.observe(observation, *self._columns()), observation

    def attach_stream(self, df: DataFrame) -> DataFrame:
        """The same stream; ``StreamMetrics`` is told with each micro-batch."""
        return df.observe(self.name, *self._columns())


class StreamMetrics(StreamingQueryListener):
    """Adds what passes saw in each micro-batch; one that is told twice counts once. Add it with ``spark.streams.addListener``."""

    def __init__(self, collected: Collected, *passes: Pass):
        self.collected, self.passes, self._done = collected, {p.name: p for p in passes}, {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = {name: row for name, row in progress.observedMetrics.items() if name in self.passes}
        if not found or self._done.get(str(progress.id), -1) >= progress.batchId:
            return
        self._done[str(progress.id)] = progress.batchId
        for name, row in found.items():
            self.collected.add(self.passes[name].read(row.asDict()))
