"""Keyed state with event-time timers: caps that don't lag, and the life of a stored candidate.

Rows wait in the state of their key until the watermark has passed them, so they are answered in the order of their time
and no answer is ever taken back. What a key holds is bounded by its rows within the lateness and the window.

The session needs the RocksDB state store, see `STATE_STORE`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ridgeline.operators.runs import STATUS, step

#: The setting that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Holds rows (at in microseconds, id, what) back until no earlier one can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, what string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            new = [(int(a), int(i), None if w is None else str(w)) for a, i, w in zip(some["micros"], some["row_id"], some["what"])]
            self.waiting.appendList(new)
            for at in {a // 1000 + 1 for a, _, _ in new}:
                self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in held if r[0] <= mark)
        if due:
            late = [r for r in held if r[0] > mark]
            if late:
                self.waiting.put(late)
            else:
                self.waiting.clear()
            yield self.answer(key[0], due)

    def answer(self, who: int, due: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Capped(_InOrder):
    def __init__(self, cap: int, micros: int) -> None:
        self.cap, self.micros = cap, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at long, accepted boolean")

    def answer(self, who: int, due: list[tuple]) -> pd.DataFrame:
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        out = []
        for n, (at, key, _) in enumerate(due):
            recent = [r for r in recent if r[0] >= at - self.micros]
            taken = sum(r[1] for r in recent) < self.cap
            recent.append((at, taken))
            equal = sum(1 for a, _, _ in due[n + 1 :] if a == at)  # rows of the same time count, whatever their order
            out.append((who, key, len(recent) + equal, taken))
        self.recent.put(recent)
        return pd.DataFrame(out, columns=["who", "id", "in_window", "accepted"])


class _Lifecycle(_InOrder):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.status = handle.getValueState("status", "status string")

    def answer(self, who: int, due: list[tuple]) -> pd.DataFrame:
        status = self.status.get()[0] if self.status.exists() else STATUS[0]
        out = []
        for _, key, action in due:
            after, answer = step(status, action)
            out.append((who, key, status, after, answer))
            status = after
        if status == STATUS[0]:
            self.status.clear()
        else:
            self.status.update((status,))
        return pd.DataFrame(out, columns=["who", "id", "before", "after", "answer"])


def _keyed(stream: DataFrame, who: str, ts: str, key: str, what: str | None, lateness: str):
    marked = stream.where(F.col(who).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, lateness)
    action = F.col(what) if what else F.lit(None).cast("string")
    return marked.select(F.col(who).cast("long").alias("who_key"), F.col(ts), F.unix_micros(F.col(ts)).alias("micros"), F.col(key).cast("long").alias("row_id"), action.alias("what")).groupBy("who_key")


def exact_caps(stream: DataFrame, who: str, ts: str, key: str, cap: int, seconds: int = 86_400, lateness: str = "1 hour") -> DataFrame:
    """who, id, in_window (rows of the contributor in the last seconds, with those of the same time) and accepted.

    A row is accepted while fewer than `cap` accepted ones lie in the window before it; refused ones don't count.
    """
    return _keyed(stream, who, ts, key, None, lateness).transformWithStateInPandas(_Capped(cap, seconds * 1_000_000), "who long, id long, in_window long, accepted boolean", "append", "eventTime")


def lifecycle(stream: DataFrame, who: str, ts: str, key: str, action: str, lateness: str = "1 hour") -> DataFrame:
    """who, id, before, after, answer of every action, as `runs.lifecycle` gives them for a table ordered by (time, id)."""
    return _keyed(stream, who, ts, key, action, lateness).transformWithStateInPandas(_Lifecycle(), "who long, id long, before string, after string, answer string", "append", "eventTime")
