"""Research runs as streaming state: leases that expire without an event, ended runs that are forgotten after a while.

The state of a run is one value, changed by its events in order as
``research.step`` has it. A claim sets a timer at the end of its lease: when the
watermark (or the clock) has passed it, the run is told to be free again, whether
or not anything more is heard of it. A run that has ended is kept for a while, so
that replays and late claims are known, and then dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomline.operators.research import step

_STATE = StructType(
    [StructField(c, StringType()) for c in ("status", "token", "result", "request")] + [StructField(c, LongType()) for c in ("lease_ms", "started_ms", "ended_ms", "last_ms")]
)
_STEPS = "run_id long, pos long, what string, status string, token string, lease_ms long, started_ms long, ended_ms long, result string"
ENDED = ("COMPLETED", "FAILED")


class Leases(StatefulProcessor):
    """Tells what came of each event, and of the timers: ``lease-expired`` and ``forgotten`` (pos is null)."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _load(self) -> dict | None:
        if not self.state.exists():
            return None
        found = self.state.get()
        return dict(zip(_STATE.names, found, strict=True))

    def _save(self, state: dict) -> None:
        self.state.update(tuple(state.get(c) for c in _STATE.names))

    def _told(self, key: Any, pos: int | None, what: str, state: dict | None) -> Row:
        state = state or {}
        return Row(run_id=key[0], pos=pos, what=what, **{c: state.get(c) for c in ("status", "token", "lease_ms", "started_ms", "ended_ms", "result")})

    def _timers(self, state: dict) -> None:
        """One timer: the end of the lease of a run that is under way, the end of what an ended one is kept for."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state["status"] == "RUNNING":
            self.handle.registerTimer(state["lease_ms"])
        elif state["status"] in ENDED:
            self.handle.registerTimer(state["ended_ms"] + self.retention_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._load()
        out = []
        for e in sorted(rows, key=lambda r: r["pos"]):
            event = {c: e[c] for c in ("kind", "at_ms", "token", "lease_ms", "result")}
            state, what = step(state, event)
            out.append(self._told(key, e["pos"], what, state))
        if state is not None:
            self._save(state)
            self._timers(state)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self._load()
        if state is None:
            return
        if state["status"] in ENDED:
            self.state.clear()
            yield self._told(key, None, "forgotten", state)
        elif state["status"] == "RUNNING" and state["lease_ms"] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._told(key, None, "lease-expired", state)

    def close(self) -> None:
        pass


def lease_steps(events: DataFrame, *, retention_ms: int = 7 * 86_400_000, late: str = "0 seconds", time_mode: str = "EventTime") -> DataFrame:
    """(run_id, pos, what, and the state after it) for each event of a stream and each timer.

    events: run_id, pos (order in a run), kind, at_ms, token, lease_ms, result, and
    ``at`` (timestamp, that of at_ms), by which the watermark goes; an event later
    than the watermark by more than ``late`` is dropped, as streams do. With
    time_mode ProcessingTime leases end by the clock, without any event at all.
    """
    rows = events.withWatermark("at", late) if time_mode == "EventTime" else events
    return rows.groupBy("run_id").transformWithState(statefulProcessor=Leases(retention_ms), outputStructType=_STEPS, outputMode="Update", timeMode=time_mode)
