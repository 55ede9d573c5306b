"""Queries that reach operators no other query uses: costs, increments, replays, cosines, throughput, modes, conflicts."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import aggregates as A, joins as J, money, ranking as R
from ..session import load, not_deleted, shared_folder
from ..sources import events as E
from ..streaming import signals as SG
from .registry import query


@query("""
WITH p AS (SELECT event_type, min(value) / 10 AS usd FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT event_type AS model, sum(event_id % 4000) AS tokens, round(sum(event_id % 4000) / 1000 * coalesce(max(usd), 0), 6) AS cost_usd FROM events LEFT JOIN p USING (event_type) GROUP BY 1
""")
def token_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as models, of which one has no price."""
    e = load(spark, sf, "events").withColumnRenamed("event_type", "model")
    prices = e.where("model <> 'view'").groupBy("model").agg((F.min("value") / 10).alias("usd_per_1k"))
    return money.token_cost(e.withColumn("tokens", F.col("event_id") % 4000), prices).select("model", "tokens", F.round("cost_usd", 6).alias("cost_usd"))


@query("""SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 7) * 7 AS BIGINT) AS billed FROM lineitem""")
def billed_increments(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money.minimum_increment(F.col("l_quantity"), F.lit(7)).cast("long").alias("billed"))


@query("""
SELECT event_id, n FROM (SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 1000), (SELECT least(1000, count(*)) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20')
""")
def replayed_events(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of the log published again to a folder, and how many events that were (the replay's own limit holds)."""
    out = f"{shared_folder(spark)}/replays/{uuid.uuid4().hex}"
    n = E.replay(load(spark, sf, "events"), F.lit(datetime(2024, 1, 3)), F.lit(datetime(2024, 1, 20)), lambda found: found.select("event_id").write.parquet(out))
    return spark.read.parquet(out).withColumn("n", F.lit(n).cast("long"))


@query("""
SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def neighbour_cosines(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS n FROM events GROUP BY 1""")
def event_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return SG.throughput(load(spark, sf, "events"), "ts", "6 hours").select(F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "n")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) SELECT user_id, event_type AS usual FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1
""")
def usual_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's most frequent event type, errors counting as deleted rows."""
    rows = not_deleted(load(spark, sf, "events").withColumn("deleted_at", F.when(F.col("event_type") == "error", F.col("ts"))))
    return rows.groupBy("user_id").agg(A.mode_of(F.col("event_type")).alias("usual"))


@query("""
WITH p AS (SELECT o_orderkey, date_diff('day', o_orderdate, lead(o_orderdate) OVER w) < 60 AS near, o_orderstatus = lead(o_orderstatus) OVER w AS status, o_orderpriority = lead(o_orderpriority) OVER w AS priority FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, list_filter([CASE WHEN near THEN 'schedule' END, CASE WHEN near AND status THEN 'status' END, CASE WHEN near AND priority THEN 'priority' END], lambda k: k IS NOT NULL) AS kinds FROM p WHERE near IS NOT NULL
""")
def order_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's consecutive orders as changes: do they clash in time, status, priority?"""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, sf, "orders")
    ahead = {f"next_{c}": F.lead(c).over(w) for c in ("o_orderdate", "o_orderstatus", "o_orderpriority")}
    pairs = o.withColumns(ahead).where("next_o_orderdate is not null")
    near = F.date_diff("next_o_orderdate", "o_orderdate") < 60
    sides = [(name, F.array(c), F.array(f"next_{c}")) for name, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return pairs.select("o_orderkey", J.conflict_kinds(near, sides).alias("kinds"))
