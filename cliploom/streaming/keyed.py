"""Keyed streams that take each key's rows in order of event time and forget a key when its time is over.

Rows wait in a buffer until the watermark has passed their second, so a batch that comes late or out of order changes nothing;
what is later than the watermark is dropped. A timer in event time wakes the key for its earliest waiting row, and one more
for the end of what it remembers. Both are kept in the state store (RocksDB, which keyed processors need), so they
survive a restart. A rule gives the same rows as its batch twin over the rows that were not too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Stages of a job in order, and those after which nothing changes.
STAGES = ("queued", "uploading", "converting", "transcribing", "scoring", "processing", "completed", "error")
TERMINAL = ("completed", "error")
THROTTLE_POINTS, THROTTLE_S = 5, 2

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Progress:
    """Accepted updates of a job; after `ttl_s` seconds without one it may begin anew."""

    ttl_s: int
    fields: str = "stage string, percent bigint"
    memory: str = "stage string, percent bigint, at_s bigint"
    out: str = "stage string, percent bigint, at_s bigint"

    def step(self, last: tuple | None, at: int, ident: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        stage, percent = str(row[0]).strip().lower(), min(100, max(0, int(row[1])))
        stage = stage if stage in STAGES else "processing"
        if last is not None and at - last[2] <= self.ttl_s:
            back = last[0] in TERMINAL or STAGES.index(stage) < STAGES.index(last[0]) or percent < last[1]
            if back or (stage == last[0] and (percent - last[1] < THROTTLE_POINTS or at - last[2] < THROTTLE_S)):
                return last, []
        return (stage, percent, at), [(stage, percent, at)]

    def ends(self, last: tuple) -> int:
        return last[2] + self.ttl_s


@dataclass(frozen=True)
class RateLimit:
    """Requests, accepted while fewer than `limit` accepted ones lie in the `seconds` before."""

    limit: int
    seconds: int
    fields: str = ""
    memory: str = "open array<bigint>"
    out: str = "id bigint, at_s bigint, accepted boolean"

    def step(self, last: tuple | None, at: int, ident: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        open_ = [int(t) for t in (last[0] if last else ()) if t > at - self.seconds]
        yes = len(open_) < self.limit
        open_ += [at] * yes
        return ((open_,) if open_ else None), [(ident, at, yes)]

    def ends(self, last: tuple) -> int:
        return int(max(last[0])) + self.seconds


@dataclass(frozen=True)
class FirstSeen:
    """Rows that come first, or more than `ttl_s` seconds after the last accepted row of their key."""

    ttl_s: int
    fields: str = ""
    memory: str = "at_s bigint"
    out: str = "id bigint, at_s bigint"

    def step(self, last: tuple | None, at: int, ident: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        fresh = last is None or at - last[0] > self.ttl_s
        return ((at,), [(ident, at)]) if fresh else (last, [])

    def ends(self, last: tuple) -> int:
        return last[0] + self.ttl_s


@dataclass(frozen=True)
class Calibrator:
    """After each score from 0 to 1: how many of the last `keep` are not older than `ttl_s` seconds, and their p10 and p90."""

    keep: int
    ttl_s: int
    fields: str = "score double"
    memory: str = "times array<bigint>, scores array<double>"
    out: str = "id bigint, at_s bigint, n bigint, p10 double, p90 double"

    def step(self, last: tuple | None, at: int, ident: int, row: tuple) -> tuple[tuple | None, list[tuple]]:
        score = row[0]
        if score is None or not 0 <= score <= 1:
            return last, []
        held = [(int(t), float(s)) for t, s in zip(*last) if t >= at - self.ttl_s] if last else []
        held = [*held, (at, float(score))][-self.keep :]
        a = sorted(s for _, s in held)
        pick = lambda q: a[round(q * (len(a) - 1))]
        return ([t for t, _ in held], [s for _, s in held]), [(ident, at, len(a), pick(0.10), pick(0.90))]

    def ends(self, last: tuple) -> int:
        return int(last[0][-1]) + self.ttl_s


class InOrder(StatefulProcessor):
    """The state of a key: waiting rows, and what its rule remembers."""

    def __init__(self, rule, by: str):
        self.rule, self.by = rule, by
        self.names = [f.split()[0] for f in rule.fields.split(", ")] if rule.fields else []
        self.columns = [by, *(c.split()[0] for c in rule.out.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_s bigint, id bigint" + (f", {self.rule.fields}" if self.rule.fields else ""))
        self.memory = handle.getValueState("memory", self.rule.memory)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            new = [(int(at), int(i), *values) for at, i, *values in zip(part["at_s"], part["id"], *(part[n].astype(object).where(part[n].notna(), None) for n in self.names))]
            self.waiting.appendList(new)
            earliest = min([r[0] for r in new] + ([earliest] if earliest is not None else []))
        if earliest is not None:
            self.handle.registerTimer(wake(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), sorted(map(tuple, self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        memory = self.memory.get() if self.memory.exists() else None
        held, out = memory, []
        for row in (r for r in waiting if wake(r[0]) <= now):
            memory, given = self.rule.step(memory, int(row[0]), int(row[1]), row[2:])
            out += [(*key, *g) for g in given]
        rest = [r for r in waiting if wake(r[0]) > now]
        if len(rest) < len(waiting):
            self.waiting.put(rest) if rest else self.waiting.clear()
        if memory is not None and wake(self.rule.ends(memory)) <= now:
            memory = None
        if memory is None:
            self.memory.clear()
        else:
            if memory is not held:
                self.memory.update(memory)
            self.handle.registerTimer(wake(self.rule.ends(memory)))
        if rest:
            self.handle.registerTimer(wake(rest[0][0]))
        return iter([pd.DataFrame(out, columns=self.columns)] if out else ())

    def close(self) -> None:
        pass


def wake(at_s: int) -> int:
    """Milliseconds from which no further row of this second can come."""
    return 1000 * at_s + 999


def in_order(events: DataFrame, by: str, rule, watermark: str) -> DataFrame:
    """(by, columns of the rule): rows of `events` (by bigint, ts, id and the fields of the rule) through `rule`.

    Sets the session's state store to RocksDB, without which Spark does not run keyed processors. Rows without key or time are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [f.split()[0] for f in rule.fields.split(", ")] if rule.fields else []
    typed = [F.expr(f"cast({f.split()[0]} as {f.split()[1]})").alias(f.split()[0]) for f in rule.fields.split(", ")] if names else []
    rows = events.where(F.col(by).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", watermark)
    rows = rows.select(F.col(by).cast("long").alias(by), "ts", F.unix_timestamp("ts").alias("at_s"), F.col("id").cast("long").alias("id"), *typed)
    return rows.groupBy(by).transformWithStateInPandas(InOrder(rule, by), f"{by} bigint, {rule.out}", "append", "EventTime")
