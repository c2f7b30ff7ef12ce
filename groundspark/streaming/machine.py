"""State machines that run on events: on a table by a fold, on a stream with kept state and timers.

A key's machine takes each event as a command. What a machine knows grows stale: after `patience` without an
event it is back in its first state, and a row says when. On a stream a timer does that, once the
watermark has passed; an event that comes first finds out by its own time. Either way the rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from groundspark.operators.fold import fold

OUT = "at bigint, command string, before string, after string, outcome string"
MICROS = 1_000_000


@dataclass(frozen=True)
class Machine:
    """moves: (state, command) -> next state; first: the state at the start; patience: whole seconds until what is known is stale."""

    moves: dict[tuple[str, str], str]
    first: str
    patience: int

    def stale_at(self, at: int) -> int:
        return at + self.patience * MICROS

    def take(self, state: tuple[str, int] | None, at: int, command: str) -> tuple[tuple[str, int], list[tuple]]:
        """State after an event, and rows (at, command, before, after, outcome). state: name and time of the last event."""
        rows = []
        if state is not None and at > self.stale_at(state[1]):
            rows, state = self.forget(state), None
        before = state[0] if state else self.first
        after = self.moves.get((before, command))
        rows.append((at, command, before, after or before, "moved" if after else "refused"))
        return (after or before, at), rows

    def forget(self, state: tuple[str, int]) -> list[tuple]:
        return [(self.stale_at(state[1]), None, state[0], self.first, "stale")]


def run_batch(events: DataFrame, machine: Machine, until: int | None = None) -> DataFrame:
    """key, at, command, before, after, outcome: a row an event, and one each time that a machine grew stale.

    events: key, at (microseconds), command; rows without a key or time are left out; of one time they come by command. until:
    the time up to which machines are watched after their last event; by default they are not.
    """
    told = events.where("key is not null and at is not null").select("key", "at", "command")
    end = lambda state: machine.forget(state) if until is not None and until > machine.stale_at(state[1]) else []
    return fold(told, ["key"], ["at", "command"], ["at", "command"], OUT, machine.take, end=end)


class _Kept(StatefulProcessor):
    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, at bigint")

    def _timer(self, at: int) -> int:
        """Milliseconds at which the machine is stale: the first that lie beyond."""
        return self.machine.stale_at(at) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        if state is not None:
            self.handle.deleteTimer(self._timer(state[1]))
        out = []
        batch = pd.concat(list(rows))
        for at, command in sorted(zip(batch["at"].tolist(), batch["command"].tolist(), strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            state, found = self.machine.take(state, at, command)
            out += found
        self.state.update(state)
        self.handle.registerTimer(self._timer(state[1]))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get())
        self.state.clear()
        yield self._frame(key, self.machine.forget(state))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "at", "command", "before", "after", "outcome"])

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, machine: Machine, late: str = "0 seconds") -> DataFrame:
    """The rows of run_batch for a stream of events (key, ts, command), ts a timestamp; up to the watermark, which is `late` behind the newest event.

    A key's events must come in order of time, but for those of one batch. State is kept for keys that are not stale, in the state
    store and its checkpoints; a lost executor's is read again. A key's rows of one batch meet in one task.
    """
    kind = events.schema["key"].dataType.simpleString()
    told = events.where("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), "command")
    return told.groupBy("key").transformWithStateInPandas(_Kept(machine), outputStructType=f"key {kind}, {OUT}", outputMode="append", timeMode="eventtime")
