"""An event log: appended as partitioned parquet, read by time range, replayed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_LIMIT, MAX_LIMIT, RETENTION_DAYS = 1000, 10_000, 7


def append(df: DataFrame, path: str, at: str = "ts") -> None:
    """Adds events under their day, which is what reads and retention prune by."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def expired_days(spark: SparkSession, path: str, now: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """The days whose events are older than the retention, to be deleted by folder."""
    cut = F.date_sub(F.lit(now).cast("date"), days)
    return [str(r[0]) for r in spark.read.parquet(path).select("day").distinct().where(F.col("day") < cut).orderBy("day").collect()]


def query(df: DataFrame, start: Column, end: Column, predicate: Column | None = None, limit: int = DEFAULT_LIMIT, at: str = "ts", ident: str = "event_id") -> DataFrame:
    """The first ``limit`` events of [start, end] by time, and of those the ones that match: the limit comes first."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit from 1 to 10,000")
    found = df.where(F.col(at).between(start, end)).orderBy(at, ident).limit(limit)
    return found if predicate is None else found.where(predicate)


def replay(df: DataFrame, start: Column, end: Column, publish: Callable[[DataFrame], None], **criteria: object) -> int:
    """Publishes a slice of the log again and returns its size."""
    found = query(df, start, end, **criteria)
    publish(found)
    return found.count()
