"""Stateful streams that see each key's events in order of time: a late or repeated event changes nothing that a batch
over all events would not change.

Events wait in the key's state until the watermark has passed them and are then folded by (ts, id), so micro-batches may
bring them in any order. An id that waits or that was folded at the same place is dropped as a repetition; events later than the
watermark are dropped by Spark. The session needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragmill.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Releases the waiting events of a key in order; subclasses fold them one by one in `step`."""

    WAITING = "at long, id long, value string"
    FOLDED = "at long, id long, value string, n long, ended boolean"
    keep_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.folded = handle.getValueState("folded", self.FOLDED)

    def _last(self) -> tuple:
        return tuple(self.folded.get()) if self.folded.exists() else (-1 << 62, -1 << 62, None, 0, False)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, ident, _, _, ended = self._last()
        known = {i for _, i, _ in map(tuple, self.waiting.get())} if self.waiting.exists() else set()
        new = []
        for frame in rows:
            for t, i, v in zip(frame["at"], frame["id"], frame["value"], strict=True):
                if not ended and i not in known and (t, i) > (at, ident):
                    known.add(i)
                    new.append((int(t), int(i), v))
        if new:
            self.waiting.appendList(new)
            for t in {t // 1000 + 1 for t, _, _ in new}:
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] // 1000 < until]
        state, out = self._last(), []
        for r in ready:
            if not state[4]:
                state, emitted = self.step(state, r, key)
                out += emitted
        if ready:
            rest = [] if state[4] else rows[len(ready) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.folded.update(state)
            self.handle.registerTimer(max(ready[-1][0] // 1000 + 1, until) + self.keep_ms + 1)
        elif not rows and self.folded.exists() and self.over(key, state, until):
            self.folded.clear()
        return iter([pd.DataFrame(out, columns=self.columns, dtype=object)] if out else ())

    def over(self, key: Any, state: tuple, until: int) -> bool:
        """Whether the key's state can go: nothing came for keep_ms."""
        return state[0] // 1000 + self.keep_ms < until

    def step(self, state: tuple, row: tuple, key: Any) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Changes(InOrder):
    """Rows whose state differs from the one before, up to the first final state."""

    columns = ["key", "id", "state"]
    keep_ms = 3_600_000

    def step(self, state: tuple, row: tuple, key: Any) -> tuple[tuple, list[tuple]]:
        changed = not state[3] or row[2] != state[2]
        return (*row, state[3] + 1, row[2] in ("done", "failed")), [(key[0], row[1], row[2])] if changed else []


class Running(InOrder):
    """Running number of each event of a key; value holds the limit, empty for none. A window lasts a day at most; an action
    without a limit has no window (-1) and keeps its number."""

    columns = ["key", "action", "window", "id", "nth", "limited"]
    keep_ms = 86_400_000

    def over(self, key: Any, state: tuple, until: int) -> bool:
        return key[2] >= 0 and super().over(key, state, until)

    def step(self, state: tuple, row: tuple, key: Any) -> tuple[tuple, list[tuple]]:
        n = state[3] + 1
        return (*row, n, False), [(*key, row[1], n, bool(row[2]) and n > int(row[2]))]


def _folded(events: DataFrame, by: list[str], value: Column, fold: InOrder, schema: str, watermark: str) -> DataFrame:
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    ship(events.sparkSession)
    rows = events.withWatermark("ts", watermark).select(*by, "ts", F.unix_micros("ts").alias("at"), "id", value.cast("string").alias("value"))
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=fold, outputStructType=schema, outputMode="append", timeMode="EventTime")


def stream_progress_changes(states: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """library.progress_changes as a stream: key, id, state; columns key (long), ts, id, state. After its final state a key
    keeps a mark for an hour of event time, so that what comes later is dropped."""
    return _folded(states, ["key"], F.col("state"), Changes(), "key long, id long, state string", watermark)


def limit_key(user_id: Column, address: Column) -> Column:
    """Who a request counts for: the user, else the address."""
    return F.coalesce(F.concat(F.lit("user:"), user_id.cast("string")), F.concat(F.lit("ip:"), address))


def stream_rate_limit_audit(events: DataFrame, limits: dict[str, tuple[int, str]], watermark: str = "10 minutes") -> DataFrame:
    """library.rate_limit_audit as a stream: key, action, window_start, id, nth, limited for every event; columns key, action,
    ts, id. A key's window is dropped from the state once the watermark is a day past its last event."""
    unit = F.create_map(*[F.lit(x) for a, (_, u) in limits.items() for x in (a, u)])
    most = F.create_map(*[F.lit(x) for a, (n, _) in limits.items() for x in (a, n)])
    e = events.withColumn("_u", unit[F.col("action")]).withColumn("window_start", F.when(F.col("_u").isNotNull(), F.expr("date_trunc(_u, ts)"))).withColumn("_m", most[F.col("action")])
    e = e.withColumn("window", F.coalesce(F.unix_micros("window_start"), F.lit(-1)))
    out = _folded(e, ["key", "action", "window"], F.coalesce(F.col("_m").cast("string"), F.lit("")), Running(), "key string, action string, window long, id long, nth long, limited boolean", watermark)
    return out.select("key", "action", F.when(F.col("window") >= 0, F.timestamp_micros("window")).alias("window_start"), "id", "nth", "limited")
