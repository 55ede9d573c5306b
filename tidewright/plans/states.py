"""Queries over keyed state: streams fed in three parts, stopped and started again between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scoring import seconds
from ..session import load, shared_folder
from ..streaming import signals as SG, states as ST
from .registry import query


def _fed(spark: SparkSession, rows: DataFrame, at: str, run: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What ``run`` makes of a stream of ``rows``, which arrive in time order in ``parts`` instalments; a restart follows each."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    first, last = rows.agg(F.min(seconds(F.col(at))), F.max(seconds(F.col(at)))).first()
    place = F.least(F.floor((seconds(F.col(at)) - F.lit(first)) / F.lit(max(last - first, 1.0)) * parts), F.lit(parts - 1)) if first is not None else F.lit(0)
    dealt = rows.withColumn("part", F.coalesce(place, F.lit(0)))
    for k in range(parts):
        dealt.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        SG.drain(run(stream), f"{folder}/state", lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"))
    return spark.read.parquet(f"{folder}/out").drop("batch")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT user_id, t, n, [t] AS hits, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, t, n, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3
  FROM (SELECT e.*, list_filter(r.hits, lambda x: x > e.t - 86400) AS kept FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1))
SELECT user_id, CAST(round(t * 1000) AS BIGINT) AS at_ms, allowed, CAST(3 - len(hits) AS INTEGER) AS remaining FROM r
""")
def sliding_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At most three allowed events a user in any 24 hours."""
    out = _fed(spark, _events(spark, sf), "at", lambda s: ST.sliding_limited(s, "user_id", "at", 3, 86400.0))
    return out.select(F.col("key").cast("long").alias("user_id"), F.round(F.col("t") * 1000).cast("long").alias("at_ms"), "allowed", "remaining")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, CASE event_type WHEN 'error' THEN 'resolved' WHEN 'click' THEN 'investigating' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE 1 END, event_id) AS n FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT user_id, n, t, CASE WHEN status IS NULL THEN 1 ELSE 0 END AS number, CASE WHEN status IS NULL THEN t ELSE 0 END AS started, CASE WHEN status IS NULL THEN t ELSE 0 END AS last,
    CASE WHEN status IS NULL THEN 'new' ELSE '' END AS state, status IS NOT NULL AS is_status FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, t, number + CASE WHEN opens THEN 1 ELSE 0 END, CASE WHEN opens THEN t ELSE started END, CASE WHEN opens OR told OR joins THEN t ELSE last END,
    CASE WHEN opens THEN 'new' WHEN told THEN status ELSE state END, status IS NOT NULL
  FROM (SELECT *, status IS NULL AND NOT joins AS opens, status IS NOT NULL AND number > 0 AS told FROM (
    SELECT e.*, number, started, last, state, status IS NULL AND number > 0 AND state NOT IN ('resolved', 'closed', 'cancelled', 'merged') AND e.t - last <= 172800 AS joins
    FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1)))
SELECT user_id, CAST(number AS INTEGER) AS number, CAST(round(started * 1000) AS BIGINT) AS started_ms, CAST(round(t * 1000) AS BIGINT) AS at_ms, state AS status, is_status FROM r WHERE number > 0
""")
def status_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Errors stand for resolutions and clicks for reopenings; other events of a user are signals within two days of each other."""
    status = F.when(F.col("event_type") == "error", "resolved").when(F.col("event_type") == "click", "investigating")
    rows = _events(spark, sf).withColumn("status", status)
    out = _fed(spark, rows, "at", lambda s: ST.incidents(s, "user_id", "at", "status", 172800.0, keep_seconds=400 * 86400.0))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return out.select(F.col("key").cast("long").alias("user_id"), "number", ms("started").alias("started_ms"), ms("t").alias("at_ms"), "status", "is_status")


@query("""
WITH RECURSIVE e AS (SELECT event_type, epoch(ts) AS t, (event_id * 7919) % 1000 / 1000 AS draw, row_number() OVER (PARTITION BY event_type ORDER BY ts, (event_id * 7919) % 1000) AS n FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT event_type, n, t, draw, 1.0::DOUBLE AS ratio, t AS began, 1 AS seen FROM e WHERE n = 1
  UNION ALL
  SELECT event_type, n, t, draw, CASE WHEN NOT over THEN ratio WHEN seen / (t - began) > target THEN greatest(0.01, ratio * target / (seen / (t - began))) ELSE least(1.0, ratio * 1.1) END,
    CASE WHEN over THEN t ELSE began END, CASE WHEN over THEN 1 ELSE seen + 1 END
  FROM (SELECT e.*, r.ratio, r.began, r.seen, e.t - r.began >= 3600 AS over, 0.0004::DOUBLE AS target FROM r JOIN e ON e.event_type IS NOT DISTINCT FROM r.event_type AND e.n = r.n + 1))
SELECT event_type, CAST(round(t * 1000) AS BIGINT) AS at_ms, round(ratio, 9) AS ratio, draw < ratio AS sampled FROM r
""")
def steered_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A ratio an event type, steered hour by hour towards four events in ten thousand seconds."""
    rows = _events(spark, sf).withColumn("draw", (F.col("event_id") * 7919) % 1000 / 1000)
    out = _fed(spark, rows, "at", lambda s: ST.adaptive_samples(s, "event_type", "at", "draw", 0.0004, window_seconds=3600.0, keep_seconds=400 * 86400.0))
    return out.select(F.col("key").alias("event_type"), F.round(F.col("t") * 1000).cast("long").alias("at_ms"), F.round("ratio", 9).alias("ratio"), "sampled")
