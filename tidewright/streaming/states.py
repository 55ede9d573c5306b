"""Keyed state over streams: a sliding limiter, incidents that a status closes, a sampler that steers its own ratio.

All three run on ``transformWithState``: state lives in RocksDB, survives restarts and goes by event-time timers.  The limiter and the
incidents keep it by groups of keys, so that calls don't grow with the keys; the sampler, whose keys are few, by key.
Rows of a key are taken in time order within a batch; a row that comes in a later batch, but not behind
the watermark, meets the state as it then is; rows behind the watermark are dropped by Spark.  Null keys are a
key of their own, rows without a time are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import seconds

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Statuses in which an incident takes no more signals.
CLOSED = ("resolved", "closed", "cancelled", "merged")


#: Fixed value: among so many groups the keys are dealt; a running stream's state belongs to its number.
GROUPS = 1024


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(["t", "place"], kind="stable") if "place" in rows.columns else rows.sort_values("t", kind="stable")


class _Timed(StatefulProcessor):
    """A processor whose state goes when its key has been silent for ``silence`` seconds."""

    silence: float

    def _put_off(self, handle: StatefulProcessorHandle, last: float, watermark: int) -> None:
        for timer in list(handle.listTimers()):
            handle.deleteTimer(timer)
        handle.registerTimer(max(int((last + self.silence) * 1000) + 1, watermark + 1))

    def close(self) -> None:
        pass


class _Grouped(StatefulProcessor):
    """State of many keys by group: a call, its Arrow batch and its exchanges with the store cost milliseconds, whatever the rows.

    A group's value maps its keys to (last time, what ``step`` keeps of the key).  Each key goes once it has been silent for
    ``silence`` seconds, by one timer for the first of the group.
    """

    silence: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "keys binary")

    def _read(self) -> dict:
        return pickle.loads(self.held.get()[0]) if self.held.exists() else {}

    def _write(self, held: dict, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not held:
            self.held.clear()
            return
        self.held.update((pickle.dumps(held),))
        self.handle.registerTimer(max(self._ends(min(last for last, _ in held.values())), watermark + 1))

    def _ends(self, last: float) -> int:
        return int((last + self.silence) * 1000) + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch, held, out, watermark = _in_order(rows), self._read(), [], timerValues.getCurrentWatermarkInMs()
        given = batch["status"] if "status" in batch.columns else batch["t"]
        # keys without rows that have been silent for long go; those with rows go on
        here = set(batch["key"])
        held = {k: v for k, v in held.items() if k in here or self._ends(v[0]) > watermark}
        for k, t, x in zip(batch["key"].tolist(), batch["t"].tolist(), given.tolist()):
            last, kept = held.get(k, (0.0, None))
            kept, row = self.step(kept, t, x)
            if kept is not None:
                held[k] = max(last, self.seen(kept, t)), kept
            if row is not None:
                out.append((k, t, *row))
        self._write(held, watermark)
        yield pd.DataFrame(out, columns=["key", "t", *self.names])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._write({k: v for k, v in self._read().items() if self._ends(v[0]) > watermark}, watermark)
        return iter(())

    def seen(self, kept: Any, t: float) -> float:
        return t

    def step(self, kept: Any, t: float, given: Any) -> tuple[Any, tuple | None]:
        """What is kept of a key after a row, and the columns that the row gives."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class SlidingLimiter(_Grouped):
    names = ("allowed", "remaining")

    def __init__(self, most: int, window: float):
        self.most, self.silence = most, window

    def step(self, kept: Any, t: float, given: Any) -> tuple[Any, tuple | None]:
        taken = [x for x in kept or () if x > t - self.silence]
        allowed = len(taken) < self.most
        if allowed:
            taken = sorted([*taken, t])
        return taken, (allowed, self.most - len(taken))


class Incidents(_Grouped):
    names = ("number", "started", "status", "is_status")

    def __init__(self, gap: float, keep: float):
        self.gap, self.silence = gap, keep

    def step(self, kept: Any, t: float, given: Any) -> tuple[Any, tuple | None]:
        number, started, last, status = kept or (0, 0.0, 0.0, "")
        told = isinstance(given, str)
        if told:
            if not number:
                return None, None  # a status of an incident that no signal has opened
            status, last = given, max(last, t)
        elif number and status not in CLOSED and t - last <= self.gap:
            last = max(last, t)
        else:
            number, started, last, status = number + 1, t, t, "new"
        return (number, started, last, status), (number, started, status, told)

    def seen(self, kept: Any, t: float) -> float:
        return kept[2]


class AdaptiveRatio(_Timed):
    def __init__(self, target: float, least: float, window: float, growth: float, keep: float):
        self.target, self.least, self.window, self.growth, self.silence = target, least, window, growth, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("controller", "ratio double, began double, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        ratio, began, seen = self.now.get() if self.now.exists() else (1.0, float(batch["t"].iloc[0]), 0)
        ratios = []
        for t in batch["t"]:
            if t - began >= self.window:
                rate = seen / (t - began)
                ratio = max(self.least, ratio * self.target / rate) if rate > self.target else min(1.0, ratio * self.growth)
                began, seen = float(t), 0
            seen += 1
            ratios.append(ratio)
        self.now.update((float(ratio), float(began), int(seen)))
        self._put_off(self.handle, float(batch["t"].iloc[-1]), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": [key[0]] * len(ratios), "t": batch["t"].to_numpy(), "draw": batch["draw"].to_numpy(), "ratio": ratios, "sampled": batch["draw"].to_numpy() < ratios})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.now.clear()
        return iter(())


def _keyed(stream: DataFrame, key: str, at: str, watermark: str, *more: Any) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    if spark.conf.get(STORE, "") != ROCKS:
        spark.conf.set(STORE, ROCKS)
    timed = stream.where(F.col(at).isNotNull()).withWatermark(at, watermark)
    return timed.select(F.col(key).cast("string").alias("key"), F.col(at), seconds(F.col(at)).alias("t"), *more)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))


def sliding_limited(stream: DataFrame, key: str, at: str, most: int, window_seconds: float, watermark: str = "10 minutes") -> DataFrame:
    """(key, t, allowed, remaining): a hit is allowed if fewer than ``most`` allowed ones lie in the window that ends with it.

    State is the times of at most ``most`` hits a key; a hit exactly a window old counts no more.
    """
    rows = _grouped(_keyed(stream, key, at, watermark))
    return rows.groupBy("group").transformWithStateInPandas(SlidingLimiter(most, window_seconds), "key string, t double, allowed boolean, remaining int", "Append", "EventTime")


def incidents(stream: DataFrame, fingerprint: str, at: str, status: str, gap_seconds: float = 900.0, keep_seconds: float = 7 * 86400.0, watermark: str = "10 minutes") -> DataFrame:
    """(key, t, number, started, status, is_status): the incident that each signal joins or opens.

    A row without a status is a signal; one with a status changes that of its fingerprint's latest incident.  A signal joins that
    incident unless its status is one of ``CLOSED`` or its last activity (signal or change) is more than the
    gap ago; else it opens the next one.  A closed incident that gets an open status again (a reopening) takes signals again.  Rows of one
    moment: changes first.  State is forgotten after ``keep_seconds`` of silence, and numbers begin again.
    """
    rows = _keyed(stream, fingerprint, at, watermark, F.col(status).alias("status"), F.col(status).isNull().cast("int").alias("place"))
    return _grouped(rows).groupBy("group").transformWithStateInPandas(Incidents(gap_seconds, keep_seconds), "key string, t double, number int, started double, status string, is_status boolean", "Append", "EventTime")


def adaptive_samples(stream: DataFrame, key: str, at: str, draw: str, target_per_second: float, least: float = 0.01, window_seconds: float = 1.0, growth: float = 1.1, keep_seconds: float = 86400.0, watermark: str = "10 minutes") -> DataFrame:
    """(key, t, draw, ratio, sampled): a controller a key that steers the share of rows taken towards a target rate.

    Once a window is over, its rate of rows decides: over the target the ratio shrinks in proportion (to ``least`` at least),
    otherwise it grows by ``growth`` (to 1 at most).  ``draw`` is a column of numbers in [0, 1) by which a row is taken or not.
    """
    rows = _keyed(stream, key, at, watermark, F.col(draw).cast("double").alias("draw"), F.col(draw).cast("double").alias("place"))
    return rows.groupBy("key").transformWithStateInPandas(AdaptiveRatio(target_per_second, least, window_seconds, growth, keep_seconds), "key string, t double, draw double, ratio double, sampled boolean", "Append", "EventTime")
