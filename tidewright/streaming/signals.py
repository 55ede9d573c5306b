"""Signals as streams: validation, late data, repeats, sessions, rate limits, sampling, fan-out.

The same functions take batch and streaming DataFrames wherever Spark allows that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scoring import seconds


@dataclass(frozen=True)
class Limits:
    max_labels: int = 64
    max_label_length: int = 1024
    max_message_length: int = 65_536
    skew_seconds: float = 300.0
    max_age_seconds: float = 7 * 86400.0


def validate(df: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Adds ``reason`` (NULL: accepted), ``accepted_at`` (moved back to now + tolerance if later) and ``was_clamped``.

    Columns: occurred_at, labels (map), message, required_present.
    """
    age = seconds(now) - seconds(F.col("occurred_at"))
    reason = (
        F.when(~F.col("required_present") | F.col("occurred_at").isNull(), "missing_required_field")
        .when(F.size("labels") > limits.max_labels, "too_many_labels")
        .when(F.exists(F.map_values("labels"), lambda v: F.length(v) > limits.max_label_length), "label_value_too_long")
        .when(F.length("message") > limits.max_message_length, "message_too_long")
        .when(age > limits.max_age_seconds, "timestamp_too_old")
    )
    late = F.coalesce(-age > limits.skew_seconds, F.lit(False))
    latest = F.timestamp_seconds(seconds(now) + limits.skew_seconds)
    return df.withColumn("reason", reason).withColumn("was_clamped", reason.isNull() & late).withColumn("accepted_at", F.when(reason.isNull(), F.when(late, latest).otherwise(F.col("occurred_at").cast("timestamp"))))


def first_of_batch(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of one batch: accepted signals' first by key, later ones marked as repeats; rejects keep their reason."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy(*order))
    return df.withColumn("_n", place).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), "duplicate").otherwise(F.col("reason"))).drop("_n")


def batch_status(df: DataFrame) -> DataFrame:
    """ACCEPTED, PARTIAL or REJECTED, with counts; an empty batch is accepted."""
    ok, all_ = F.count_if(F.col("reason").isNull()), F.count(F.lit(1))
    return df.agg(ok.alias("accepted"), (all_ - ok).alias("rejected"), F.count_if(F.col("reason") == "duplicate").alias("duplicates"), F.when(all_ == 0, "ACCEPTED").when(ok == 0, "REJECTED").when(ok < all_, "PARTIAL").otherwise("ACCEPTED").alias("status"))


def distinct_signals(stream: DataFrame, key: str, at: str, horizon: str) -> DataFrame:
    """Without repeats of a key within the horizon, across batches; state is dropped behind the watermark."""
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def incident_sessions(df: DataFrame, keys: list[str], at: str, gap: str = "15 minutes") -> DataFrame:
    """Incidents: signals of one fingerprint no further apart than the gap (exactly the gap still joins)."""
    return df.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "n")


def throughput(df: DataFrame, at: str, window: str, slide: str | None = None) -> DataFrame:
    return df.groupBy(F.window(at, window, slide or window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "n")


def rate_limited(stream: DataFrame, key: str, at: str, most: int, window_seconds: float, block_seconds: float, watermark: str = "10 minutes") -> DataFrame:
    """(key, at, allowed): a fixed window from a key's first hit; going over it blocks the key for a while.

    State is a few numbers a key and goes when the key has been silent for window and block.
    """

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used, blocked = state.get if state.exists else (0.0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("t")
        allowed = []
        for t in rows["t"]:
            if t < blocked:
                allowed.append(False)
                continue
            if t - start >= window_seconds or used == 0:
                start, used = t, 0
            used += 1
            if used > most:
                blocked = t + block_seconds
            allowed.append(used <= most)
        state.update((float(start), int(used), float(blocked)))
        state.setTimeoutTimestamp(int((max(blocked, start + window_seconds) + window_seconds + block_seconds) * 1000) + max(0, state.getCurrentWatermarkMs()))
        yield pd.DataFrame({"key": [keys[0]] * len(rows), "t": rows["t"].to_numpy(), "allowed": allowed})

    timed = stream.withWatermark(at, watermark).select(F.col(key).cast("string").alias("key"), F.col(at), seconds(F.col(at)).alias("t"))
    return timed.groupBy("key").applyInPandasWithState(decide, "key string, t double, allowed boolean", "start double, used int, blocked double", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_use(df: DataFrame, key: str, at: str, window: str, slide: str, most: int) -> DataFrame:
    """Keys over the limit in any sliding window: the analytic form of a sliding limiter."""
    return df.groupBy(key, F.window(at, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key, F.col("w.start").alias("started_at"), "n")


def adaptive_ratio(df: DataFrame, at: str, target_per_second: float) -> DataFrame:
    """By second: the share to sample so that about the target is kept."""
    return df.groupBy(F.window(at, "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("second"), F.least(F.lit(1.0), F.lit(target_per_second) / F.col("n")).alias("ratio"))


def fan_out(batch: DataFrame, handlers: Sequence[tuple[int, Column | str, Callable[[DataFrame], None]]]) -> list[Exception]:
    """Each handler (priority, predicate, function) gets the rows it asks for, highest priority first; failures are collected.

    For ``foreachBatch``: the batch is read once for all of them.
    """
    failed: list[Exception] = []
    batch.persist()
    try:
        for _, predicate, handle in sorted(handlers, key=lambda h: -h[0]):
            try:
                handle(batch.where(predicate))
            except Exception as problem:  # noqa: BLE001  a handler's failure must not keep the others from running
                failed.append(problem)
    finally:
        batch.unpersist()
    return failed


def snapshot_then_updates(current: DataFrame, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """A subscriber's view: the present rows first (as batch -1), then each batch of changes with its number, the same again if it is repeated."""
    sink(current, -1)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that is there, batch by batch, and waits for it.

    The sink gets a batch and its number, which is the same again if a restart repeats the batch.
    """
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def transitions(df: DataFrame, allowed: Mapping[str, list[str]], current: str, target: str) -> DataFrame:
    """Rows with ``legal``: whether the state machine allows the step; a few literal pairs, no join."""
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return df.withColumn("legal", F.concat_ws(">", current, target).isin(pairs))
