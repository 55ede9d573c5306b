"""Queries over time series, windows, aggregates and objectives."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, scoring as S
from ..operators import aggregates as A, money, statistics as ST, timeseries as TS, windows as WN
from ..session import by_rows, load
from .registry import query

NOW = datetime(2024, 1, 30)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events")


@query("""
SELECT user_id, CAST(floor((epoch(ts) - t0) / 86400) AS BIGINT) AS bucket, round(avg(value), 6) AS value, count(*) AS n
FROM events JOIN (SELECT user_id, min(epoch(ts)) AS t0 FROM events GROUP BY user_id) USING (user_id) GROUP BY ALL
""")
def downsample_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return TS.downsample(events(spark, sf), ["user_id"], "ts", "value", 86400, "AVG").withColumn("value", F.round("value", 6))


GRID = """
WITH b AS (SELECT event_type, user_id % 5 AS shard, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS bucket, count(value) AS samples, max(value) AS peak,
  CASE WHEN count(value) >= 20 THEN quantile_disc(value, 0.95) END AS p95 FROM events GROUP BY ALL),
g AS (SELECT event_type, shard, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM b GROUP BY event_type, shard),
p AS (SELECT event_type, shard, bucket, coalesce(samples, 0) AS samples, peak, p95, bucket * 21600 < 1704758400 AND 1704672000 < bucket * 21600 + 21600 AS excluded,
  least(1.0, coalesce(samples, 0) / 6.0) AS coverage FROM g LEFT JOIN b USING (event_type, shard, bucket))
"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("shard", F.col("user_id") % 5)
    return TS.grid(e, ["event_type", "shard"], "ts", "value", 21600, cadence=3600, excluded=[(1704672000.0, 1704758400.0)])


@query(GRID + "SELECT event_type, shard, bucket, samples, peak, p95, excluded, coverage FROM p")
def bucket_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("event_type", "shard", "bucket", "samples", "peak", "p95", "excluded", "coverage")


@query(GRID + """, m AS (SELECT *, samples > 0 AND NOT excluded AS ok FROM p), i AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, shard ORDER BY bucket) AS island FROM m),
r AS (SELECT event_type, shard, island, count(*) - count(*) FILTER (ok) AS gap FROM i GROUP BY ALL)
SELECT event_type, shard, CAST((SELECT count(*) FROM m WHERE m.event_type = r.event_type AND m.shard = r.shard) AS BIGINT) AS total,
  CAST((SELECT count(*) FILTER (ok) FROM m WHERE m.event_type = r.event_type AND m.shard = r.shard) AS BIGINT) AS measured, CAST(max(gap) AS BIGINT) AS largest_gap FROM r GROUP BY event_type, shard
""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return TS.coverage(_grid(spark, sf), ["event_type", "shard"]).select("event_type", "shard", "total", "measured", "largest_gap")


@query("""
SELECT user_id, CASE WHEN count(value) >= 20 THEN quantile_disc(value, 0.95) END AS nearest, round(quantile_cont(value, 0.95), 6) AS linear,
  list_sort(list(value))[greatest(1, least(count(*), CAST(round_even(0.95 * count(*), 0) AS BIGINT)))] AS rounded,
  list_sort(list(value))[greatest(1, least(count(*), CAST(floor(0.95 * count(*)) AS BIGINT)))] AS truncated,
  list_sort(list(value))[greatest(1, least(count(*), CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1))] AS spread
FROM events GROUP BY user_id
""")
def percentile_variants(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    linear = e.groupBy("user_id").agg(F.round(F.percentile("value", 0.95), 6).alias("linear"))
    places = {"nearest": A.nearest_rank(0.95), "rounded": A.rounded_rank(95), "truncated": A.truncated_rank(95), "spread": A.spread_rank(95)}
    return linear.join(A.ranked_values(e, ["user_id"], "value", places), "user_id", "left")


@query("""
SELECT event_type, list_sort(list(value))[greatest(1, CAST(round_even(0.5 * count(*), 0) AS BIGINT))] AS p50, list_sort(list(value))[greatest(1, CAST(round_even(0.95 * count(*), 0) AS BIGINT))] AS p95,
  list_sort(list(value))[greatest(1, CAST(round_even(0.99 * count(*), 0) AS BIGINT))] AS p99, max(value) AS max FROM events GROUP BY event_type
""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return A.latency_summary(events(spark, sf), ["event_type"], "value")


@query("""
SELECT k AS user_id, round(coalesce(avg(v), 0), 6) AS a, round(coalesce(sum(v), 0), 4) AS s, coalesce(min(v), 0) AS lo, coalesce(max(v), 0) AS hi, CAST(count(v) AS DOUBLE) AS n,
  round(coalesce(quantile_cont(v, 0.95), 0), 6) AS p95, round(coalesce(quantile_cont(v, 0.99), 0), 6) AS p99 FROM (SELECT user_id AS k, CASE WHEN user_id % 3 > 0 THEN value END AS v FROM events) GROUP BY k
""")
def reducers_with_empty(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("v", F.when(F.col("user_id") % 3 > 0, F.col("value")))
    r = {k: f(F.col("v")) for k, f in A.REDUCERS.items()}
    return e.groupBy("user_id").agg(F.round(r["AVG"], 6).alias("a"), F.round(r["SUM"], 4).alias("s"), r["MIN"].alias("lo"), r["MAX"].alias("hi"), r["COUNT"].alias("n"), F.round(r["P95"], 6).alias("p95"), F.round(r["P99"], 6).alias("p99"))


@query("""
SELECT user_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY ALL
""")
def hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = A.hourly_rollup(events(spark, sf), "user_id", "ts", {"errors": F.col("event_type") == "error", "purchases": F.col("event_type") == "purchase"})
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("""
WITH r AS (SELECT *, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
n AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r),
g AS (SELECT user_id, CAST(run AS BIGINT) AS run, bool_or(bad) AS bad, min(ts) AS started, count(*) AS n FROM n GROUP BY user_id, run)
SELECT user_id, run, bad, n, round(epoch(lead(started) OVER (PARTITION BY user_id ORDER BY run)) - epoch(started), 3) AS duration FROM g
""")
def availability_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("bad", F.col("event_type") == "error")
    return WN.status_runs(e, ["user_id"], "ts", "event_id", "bad").select("user_id", "run", "bad", "n", F.round("duration", 3).alias("duration"))


@query("""
WITH h AS (SELECT user_id, event_type, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch(ts) AS held FROM events),
s AS (SELECT user_id, coalesce(sum(held) FILTER (event_type IN ('click', 'purchase', 'view')), 0) AS up, coalesce(sum(held) FILTER (event_type = 'error'), 0) AS down FROM h GROUP BY user_id)
SELECT user_id, round(up, 2) AS up_seconds, round(down, 2) AS down_seconds, round(CASE WHEN up + down = 0 THEN 100 ELSE 100 * up / (up + down) END, 6) AS availability FROM s
""")
def availability_tracker(spark: SparkSession, sf: str) -> DataFrame:
    out = TS.status_seconds(events(spark, sf), ["user_id"], "ts", F.col("event_type").isin("click", "purchase", "view"), F.col("event_type") == "error")
    return out.select("user_id", F.round("up_seconds", 2).alias("up_seconds"), F.round("down_seconds", 2).alias("down_seconds"), F.round("availability", 6).alias("availability"))


@query("""
WITH e AS (SELECT *, epoch(TIMESTAMP '2024-01-30') - epoch(ts) AS age, event_type <> 'error' AS good FROM events), g AS (
SELECT user_id, count(*) AS total, count(*) FILTER (good) AS good, count(*) FILTER (age < 86400) AS fn, count(*) FILTER (age < 86400 AND NOT good) AS fb, count(*) FILTER (age < 604800) AS sn, count(*) FILTER (age < 604800 AND NOT good) AS sb FROM e GROUP BY user_id)
SELECT user_id, total, good, round(good / total, 9) AS ratio, round(1 - (1 - good / total) / 0.25, 6) AS budget_left, round(CASE WHEN fn = 0 THEN 0 ELSE fb / fn END / 0.25, 6) AS burn_fast, round(CASE WHEN sn = 0 THEN 0 ELSE sb / sn END / 0.25, 6) AS burn_slow FROM g
""")
def objective_burn(spark: SparkSession, sf: str) -> DataFrame:
    out = TS.objective_report(events(spark, sf), "user_id", F.col("event_type") != "error", 0.75, "ts", F.lit(NOW), 86400, 604800)
    return out.select("user_id", "total", "good", F.round("ratio", 9).alias("ratio"), *(F.round(c, 6).alias(c) for c in ("budget_left", "burn_fast", "burn_slow")))


@query("""
WITH m AS (SELECT user_id, median(value) AS middle FROM events GROUP BY user_id HAVING count(*) >= 10), o AS (SELECT e.*, middle, abs(value - middle) AS off FROM events e JOIN m USING (user_id)),
d AS (SELECT user_id, median(off) AS mad FROM o GROUP BY user_id HAVING median(off) > 0)
SELECT event_id, round(0.6745 * (value - middle) / mad, 6) AS z FROM o JOIN d USING (user_id) WHERE abs(0.6745 * (value - middle) / mad) > 1.2
""")
def robust_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return TS.robust_outliers(events(spark, sf), ["user_id"], "value", threshold=1.2).select("event_id", F.round("z", 6).alias("z"))


@query("""
WITH d AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL),
f AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, avg(x) AS xm FROM d GROUP BY event_type HAVING count(*) >= 3 AND regr_sxx(y, x) > 0),
e AS (SELECT event_type, x, y - a - b * x AS e FROM d JOIN f USING (event_type)), l AS (SELECT *, e - lag(e) OVER (PARTITION BY event_type ORDER BY x) AS d FROM e),
s AS (SELECT event_type, sum(e * e) AS sse, sum(d * d) AS sdd FROM l GROUP BY event_type)
SELECT event_type, n, round(b, 6) AS slope, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(sqrt(sse / (n - 2)), 5) AS residual_std, round(sqrt(sse / (n - 2)) / sqrt(sxx), 6) AS se_slope,
  round(b / (sqrt(sse / (n - 2)) / sqrt(sxx)), 4) AS t_slope, round(sdd / sse, 5) AS durbin_watson FROM f JOIN s USING (event_type)
""")
def trend_fit(spark: SparkSession, sf: str) -> DataFrame:
    d = events(spark, sf).withColumn("x", F.floor(S.seconds(F.col("ts")) / 86400).cast("long")).groupBy("event_type", "x").agg(F.count(F.lit(1)).cast("double").alias("y"))
    fit = ST.ols_fit(d, ["event_type"], "x", "y")
    return fit.select("event_type", "n", *(F.round(c, k).alias(c) for c, k in (("slope", 6), ("r2", 6), ("adjusted_r2", 6), ("residual_std", 5), ("se_slope", 6), ("t_slope", 4), ("durbin_watson", 5))))


@query("""
WITH d AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL),
s AS (SELECT a.event_type, median((b.y - a.y) / (b.x - a.x)) AS slope FROM d a JOIN d b ON a.event_type = b.event_type AND a.x < b.x GROUP BY ALL)
SELECT event_type, round(slope, 9) AS slope, round(median(y - slope * x), 4) AS intercept FROM d JOIN s USING (event_type) GROUP BY event_type, slope
""")
def trend_theil_sen(spark: SparkSession, sf: str) -> DataFrame:
    d = events(spark, sf).withColumn("x", F.floor(S.seconds(F.col("ts")) / 86400).cast("long")).groupBy("event_type", "x").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return ST.theil_sen(d, ["event_type"], "x", "y").select("event_type", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""
WITH l AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT user_id, round(median(d), 6) AS masd FROM l GROUP BY user_id
""")
def successive_differences(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("o", F.struct("ts", "event_id"))
    return ST.median_successive_difference(e, ["user_id"], "o", "value").withColumn("masd", F.round("masd", 6))


@query("""
WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY user_id ORDER BY event_type) + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0 AS b FROM events)
SELECT user_id, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS rho, count(*) AS n FROM r GROUP BY user_id
""")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return ST.spearman(events(spark, sf), ["user_id"], "value", "event_type").select("user_id", F.round("rho", 6).alias("rho"), "n")


@query("""
WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, CASE WHEN count(was) >= 2 AND min(was) < max(was) THEN round(corr(value, was), 6) END AS rho1 FROM p GROUP BY user_id
""")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("o", F.struct("ts", "event_id"))
    return ST.lag_one(e, ["user_id"], "o", "value").withColumn("rho1", F.round("rho1", 6))


@query("""
WITH p AS (SELECT event_type, event_id, value / 1000 AS p FROM events), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) + 1) * p) AS s FROM p)
SELECT event_type, event_id, round(max(s) OVER (PARTITION BY event_type ORDER BY p, event_id ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s
""")
def holm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("event_type", "event_id", (F.col("value") / 1000).alias("p"))
    return ST.holm(e, ["event_type"], "p", "event_id").select("event_type", "event_id", F.round("adjusted", 9).alias("adjusted"))


@query("""
WITH g AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket FROM events), s AS (SELECT DISTINCT event_type FROM events), o AS (SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, event_type FROM events WHERE user_id % 10 = 0)
SELECT g.bucket FROM g CROSS JOIN s LEFT JOIN o ON o.bucket = g.bucket AND o.event_type = s.event_type GROUP BY g.bucket HAVING avg(CASE WHEN o.bucket IS NULL THEN 1.0 ELSE 0.0 END) > 0.5
""")
def platform_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("bucket", F.floor(S.seconds(F.col("ts")) / 3600).cast("long"))
    return ST.platform_gaps(e, "bucket", "event_type", F.col("user_id") % 10 == 0).select("bucket")


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) SELECT user_id, max(v) AS score FROM l GROUP BY user_id
""")
def latest_risk_max(spark: SparkSession, sf: str) -> DataFrame:
    return WN.latest_then_max(events(spark, sf), ["user_id"], "event_type", "ts", "event_id", "value")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, list(value ORDER BY ts, event_id) AS trend FROM r WHERE k <= 5 GROUP BY user_id
""")
def health_trend(spark: SparkSession, sf: str) -> DataFrame:
    return WN.last_points(events(spark, sf), ["user_id"], "ts", "event_id", "value", 5)


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 40""")
def snapshot_quota(spark: SparkSession, sf: str) -> DataFrame:
    return WN.beyond_quota(events(spark, sf), ["user_id"], "ts", "event_id", 40).select("event_id")


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS v FROM events), k AS (SELECT *, CASE WHEN v IS NULL THEN 'never' WHEN v <= TIMESTAMP '2024-01-05' THEN 'overdue' ELSE 'routine' END AS reason FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY v, event_id) AS p, count(*) OVER () AS n FROM k WHERE reason = 'routine')
SELECT event_id, reason FROM k WHERE reason <> 'routine' UNION ALL SELECT event_id, reason FROM r WHERE p <= round_even(0.1 * n, 0)
""")
def verification_sample(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("v"))
    return WN.verification_sample(t, "event_id", "v", F.lit(datetime(2024, 1, 5)), 0.1).select("event_id", "reason")


@query("""
WITH f AS (SELECT user_id, min((ts, event_id)) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id)
SELECT user_id, m[2] AS event_id, epoch(m[1]) - epoch(TIMESTAMP '2024-01-10') <= 3600 AS censored FROM f
""")
def signal_onsets(spark: SparkSession, sf: str) -> DataFrame:
    start = datetime(2024, 1, 10)
    return WN.onsets(events(spark, sf).where(F.col("ts") >= F.lit(start)), ["user_id"], "ts", "event_id", F.lit(start), edge=3600).select("user_id", "event_id", "censored")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, event_id, r, t AS anchor, 0 AS g FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.r, CASE WHEN e.t - w.anchor > 86400 THEN e.t ELSE w.anchor END, CASE WHEN e.t - w.anchor > 86400 THEN g + 1 ELSE g END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, event_id, g AS group_no, count(*) OVER (PARTITION BY user_id, g) AS members FROM w
""")
def resolution_groups(spark: SparkSession, sf: str) -> DataFrame:
    return WN.resolution_groups(events(spark, sf), ["user_id"], "ts", "event_id", 86400)


@query("""
SELECT a.event_id, CASE WHEN abs(epoch(b.ts) - epoch(a.ts)) <= CASE WHEN a.user_id % 2 = b.user_id % 2 THEN 2 ELSE 30 END THEN 'indeterminate' WHEN b.ts > a.ts THEN 'precedes' ELSE 'follows' END AS verdict
FROM events a JOIN events b ON b.event_id = a.event_id + 1
""")
def signal_precedence(spark: SparkSession, sf: str) -> DataFrame:
    a = events(spark, sf)
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("later"), F.col("user_id").alias("other"))
    return a.join(b, "event_id").select("event_id", S.precedence(F.col("ts"), F.col("later"), F.col("user_id") % 2 == F.col("other") % 2).alias("verdict"))


@query("""SELECT s_suppkey, CAST(floor((row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) / 7) AS BIGINT) AS wave FROM supplier""")
def fleet_waves(spark: SparkSession, sf: str) -> DataFrame:
    return WN.waves(load(spark, sf, "supplier"), ["s_acctbal", "s_suppkey"], 7).select("s_suppkey", "wave")


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') >= 15 THEN 'unhealthy' WHEN count(*) FILTER (event_type IN ('error', 'view')) >= 25 THEN 'degraded' ELSE 'healthy' END AS overall,
  arg_min(CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'view' THEN 'warning' WHEN 'click' THEN 'degraded' ELSE 'healthy' END, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 5 END) AS worst
FROM events GROUP BY user_id
""")
def health_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "unhealthy").when(kind == "view", "warning").when(kind == "click", "degraded").otherwise("healthy")
    component = F.when(kind == "error", "critical").when(kind == "view", "warning").otherwise("ok")
    return events(spark, sf).groupBy("user_id").agg(A.component_health(component, 25, 15).alias("overall"), A.worst_status(status).alias("worst"))


@query("""
WITH r AS (SELECT l_suppkey, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.0 END AS credit, l_tax + 1 AS w, l_linenumber = 7 AS skipped, l_linestatus AS category FROM lineitem)
SELECT l_suppkey, round(coalesce(sum(credit * w) FILTER (NOT skipped) / sum(w) FILTER (NOT skipped) * 100, 0), 6) AS overall, round(sum(credit * w) FILTER (NOT skipped AND category = 'F') / sum(w) FILTER (NOT skipped AND category = 'F') * 100, 6) AS f_score FROM r GROUP BY l_suppkey
""")
def validation_scores(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(F.col("l_linenumber") == 7, "skipped").when(flag == "N", "pass").when(flag == "A", "warn").otherwise("fail")
    w = F.col("l_tax") + 1
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(A.weighted_score(status, w, 0.0), 6).alias("overall"), F.round(A.weighted_score(F.when(F.col("l_linestatus") == "F", status), w, None), 6).alias("f_score"))


@query("""
SELECT o_custkey, count(*) / 30.0 >= 0.4 AS quorum, CASE WHEN count(*) / 30.0 >= 0.4 THEN CASE WHEN bool_or(o_orderstatus = 'P') THEN 'reject' WHEN bool_or(o_orderstatus = 'O') THEN 'conditional' ELSE 'approve' END END AS outcome FROM orders GROUP BY o_custkey
""")
def board_votes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    met, outcome = A.vote_tally(F.when(s == "P", "reject").when(s == "O", "conditional").otherwise("approve"), F.lit(30.0), 0.4)
    return load(spark, sf, "orders").groupBy("o_custkey").agg(met.alias("quorum"), outcome.alias("outcome"))


@query("""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS lv, CASE WHEN l_quantity < 3 THEN 'rejected' WHEN l_quantity < 5 THEN 'pending' WHEN l_quantity < 9 THEN 'delegated' WHEN l_returnflag = 'R' THEN 'conditional' ELSE 'approved' END AS st FROM lineitem),
l AS (SELECT k, lv, CASE WHEN count(*) FILTER (st <> 'delegated') = 0 THEN 'pending' WHEN bool_or(st = 'rejected') THEN 'rejected' WHEN bool_or(st = 'pending') THEN 'pending' WHEN bool_or(st = 'conditional') THEN 'conditional' ELSE 'approved' END AS ls FROM s GROUP BY k, lv)
SELECT k AS l_orderkey, coalesce(arg_min(ls, lv) FILTER (ls IN ('pending', 'rejected')), CASE WHEN bool_or(ls = 'conditional') THEN 'conditional' ELSE 'approved' END) AS chain_status FROM l GROUP BY k
""")
def approval_chains(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    s = F.when(q < 3, "rejected").when(q < 5, "pending").when(q < 9, "delegated").when(F.col("l_returnflag") == "R", "conditional").otherwise("approved")
    return A.approval_chain(load(spark, sf, "lineitem").withColumn("st", s), "l_orderkey", "l_linenumber", "st")


@query("""
WITH v(x) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) SELECT x AS o_orderpriority, count(o_orderkey) AS n FROM v LEFT JOIN orders ON o_orderpriority = x GROUP BY x
""")
def dense_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return A.dense_histogram(load(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"])


@query("""SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY c_mktsegment""")
def channel_adoption(spark: SparkSession, sf: str) -> DataFrame:
    return A.share_of_total(load(spark, sf, "customer"), "c_mktsegment")


@query("""
SELECT 'l_returnflag' AS dimension, l_returnflag AS bucket, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
""")
def inventory_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return A.histograms(load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"), {"l_returnflag": "unknown", "l_linestatus": "unknown", "l_linenumber": "unassigned"})


@query("""SELECT round(avg(r), 6) AS macro_average FROM (SELECT 100 * avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY user_id)""")
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    return A.macro_average(events(spark, sf), "user_id", F.col("event_type") != "error").select(F.round("macro_average", 6).alias("macro_average"))


@query("""SELECT l_partkey, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS flaky FROM lineitem GROUP BY l_partkey""")
def flaky_tests(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(A.flaky(F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").alias("flaky"))


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS latest, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def latest_value(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id").agg(A.latest(F.col("value"), F.struct("ts", "event_id")).alias("latest"), F.countDistinct("event_type").alias("kinds"))


@query("""
WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal AS load, s_suppkey % 7 = 0 AS on_call, s_suppkey % 3 = 0 AS skilled FROM supplier WHERE s_suppkey % 5 <> 0), t AS (SELECT *, CASE WHEN on_call THEN 0 WHEN skilled THEN 1 ELSE 2 END AS tier FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY tier, load, s_suppkey) AS p FROM t)
SELECT s_nationkey, s_suppkey AS responder, ['on_call', 'skill_based', 'load_balanced'][tier + 1] AS method FROM k WHERE p = 1
""")
def responder_assignment(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    roster = load(spark, sf, "supplier").select("s_nationkey", k.alias("responder"), F.col("s_acctbal").alias("load"), F.when(k % 3 == 0, F.array(F.lit("db"), F.lit("net"))).otherwise(F.array(F.lit("net"))).alias("skills"), (k % 7 == 0).alias("on_call"), (k % 5 != 0).alias("available"))
    return WN.assign(roster, ["s_nationkey"], ["db"])


@query("""
WITH q AS (SELECT o_custkey, o_orderkey AS resource, 200000.0 AS lim, o_totalprice AS used, o_orderstatus = 'F' AS hard FROM orders), b AS (SELECT *, hard AND used + 5000 > lim AS blocked, greatest(0, lim - used) AS rest FROM q)
SELECT o_custkey, count(*) FILTER (blocked) = 0 AS permitted, arg_min(resource, (rest, resource)) FILTER (blocked) AS blocking FROM b GROUP BY o_custkey
""")
def quota_check(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("resource"), F.lit(200000.0).alias("limit_value"), F.col("o_totalprice").alias("consumed"), (F.col("o_orderstatus") == "F").alias("is_hard"))
    return A.quota_check(o, "o_custkey", 5000.0)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders), u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS w, CAST(price * 100 AS BIGINT) AS c FROM lineitem JOIN o ON o_orderkey = l_orderkey),
e AS (SELECT *, c * w AS x, CAST(sum(w) OVER (PARTITION BY l_orderkey) AS BIGINT) AS t FROM u), f AS (SELECT *, x // t AS fl, x % t AS rest FROM e),
k AS (SELECT *, c - sum(fl) OVER (PARTITION BY l_orderkey) AS short, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber, l_partkey, l_suppkey) AS p FROM f)
SELECT l_orderkey, l_linenumber, CAST((fl + CASE WHEN p <= short THEN 1 ELSE 0 END) AS BIGINT) AS cents FROM k
""")
def money_split(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    # only what the split needs is sorted, in partitions of about as many rows at every size
    lines = by_rows(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    lines = lines.join(o, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("line", F.struct("l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_quantity", "price", "line")
    return money.split_money(lines, ["l_orderkey"], "price", "l_quantity", "line").select("l_orderkey", "l_linenumber", (F.col("share") * 100).cast("long").alias("cents"))


@query("""
WITH c(cur, rate) AS (VALUES ('A', 1.1), ('N', 1.0)) SELECT l_suppkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(rate AS DECIMAL(4,1))) * 1000, 0) AS BIGINT) AS total_mills, count(*) FILTER (rate IS NULL) = 0 AS complete
FROM lineitem LEFT JOIN c ON cur = l_returnflag GROUP BY l_suppkey
""")
def money_convert(spark: SparkSession, sf: str) -> DataFrame:
    rates = spark.createDataFrame([("A", 1.1), ("N", 1.0)], "currency string, rate double")
    lines = load(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice").cast("decimal(18,2)"))
    return money.convert(lines, ["l_suppkey"], "price", "l_returnflag", rates).select("l_suppkey", F.round(F.col("total") * 1000, 0).cast("long").alias("total_mills"), "complete")


@query("""
SELECT l_suppkey, CAST(round(sum(CAST(CASE WHEN l_tax > 0 THEN l_extendedprice END AS DECIMAL(18,2))) * 100, 0) AS BIGINT) AS cents, bool_or(NOT l_tax > 0) AS is_lower_bound FROM lineitem GROUP BY l_suppkey
""")
def money_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).cast("decimal(18,2)")).withColumn("currency", F.lit("USD"))
    return money.sum_money(lines, ["l_suppkey"], "price", "currency").select("l_suppkey", F.round(F.col("total") * 100, 0).cast("long").alias("cents"), "is_lower_bound")


@query("""
WITH u AS (SELECT event_id, ts, event_type AS sku, CASE WHEN user_id % 4 > 0 THEN user_id END AS owner, value FROM events), r AS (SELECT event_type AS sku, ts AS f, value AS price FROM events WHERE event_id % 50 = 0),
p AS (SELECT u.*, (SELECT arg_max(price, (f, -price)) FROM r WHERE r.sku = u.sku AND r.f <= u.ts) AS price FROM u)
SELECT sku, CASE WHEN price IS NULL THEN 'unpriced' WHEN owner IS NULL THEN 'unattributed' ELSE 'attributed' END AS state, count(*) AS n FROM p GROUP BY ALL
""")
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    usage = events(spark, sf).select(F.col("event_id").alias("usage_id"), F.col("ts").alias("at"), F.col("event_type").alias("sku"), F.when(F.col("user_id") % 4 > 0, F.col("user_id")).alias("owner"), F.col("value").alias("quantity"))
    rates = events(spark, sf).where("event_id % 50 = 0").select(F.col("event_type").alias("sku"), F.col("ts").alias("valid_from"), F.col("value").alias("unit_price"))
    return money.cost_report(usage, rates, ["sku"]).select("sku", "state", "n")


@query("""
WITH s AS (SELECT event_type AS k, TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(row_number() OVER (ORDER BY event_type) AS INTEGER)) AS s0, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
n AS (SELECT k, i, s0, unnest(range(366)) AS c FROM s), o AS (SELECT k, CASE i % 3 WHEN 0 THEN s0 + to_days(CAST(c AS INTEGER)) WHEN 1 THEN s0 + to_days(CAST(7 * c AS INTEGER)) ELSE s0 + to_months(CAST(c AS INTEGER)) END AS a FROM n)
SELECT k AS entry, strftime(a, '%Y-%m-%d %H:%M:%S') AS occurs_at FROM o WHERE a < TIMESTAMP '2024-03-01' AND a + INTERVAL 2 HOUR > TIMESTAMP '2024-01-15'
""")
def calendar_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    kinds = WN.waves(events(spark, sf).select("event_type").distinct(), [F.asc_nulls_last("event_type")], 1).withColumn("i", F.col("wave") + 1)
    start = F.lit(datetime(2024, 1, 1, 9)).cast("timestamp_ntz") + F.make_dt_interval(F.col("i").cast("int"))
    recurrence = F.element_at(F.array(*map(F.lit, ("daily", "weekly", "monthly"))), (F.col("i") % 3 + 1).cast("int"))
    entries = kinds.select(F.col("event_type").alias("entry"), start.alias("starts_at"), (start + F.expr("INTERVAL 2 HOURS")).alias("ends_at"), recurrence.alias("recurrence"), F.lit(None).cast("timestamp_ntz").alias("until"))
    lit = lambda t: F.lit(t).cast("timestamp_ntz")
    out = dates.occurrences(entries, "starts_at", "ends_at", "recurrence", "until", lit(datetime(2024, 1, 15)), lit(datetime(2024, 3, 1)))
    return out.select("entry", F.date_format("occurs_at", "yyyy-MM-dd HH:mm:ss").alias("occurs_at"))


@query("""
SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end,
  datediff('day', CAST(ts AS DATE), DATE '2024-02-01') AS days_left, ts + INTERVAL 20 DAY <= TIMESTAMP '2024-01-30' AS expired,
  CASE WHEN ts >= TIMESTAMP '2024-01-02' AND (epoch(ts) - epoch(TIMESTAMP '2024-01-02')) % 604800 < 7200 THEN true ELSE false END AS in_window
FROM events
""")
def periods(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    start, end = dates.period_window(ts, "month")
    show = lambda c: F.date_format(c, "yyyy-MM-dd")
    moment = lambda *a: F.lit(datetime(*a)).cast("timestamp_ntz")
    return events(spark, sf).select(
        "event_id", show(dates.period_start(ts, "week")).alias("week"), show(start).alias("month_start"), show(end).alias("month_end"), dates.days_between(ts, moment(2024, 2, 1)).cast("long").alias("days_left"),
        dates.is_expired(ts + F.expr("INTERVAL 20 DAYS"), moment(2024, 1, 30)).alias("expired"), dates.window_active(ts, moment(2024, 1, 2), moment(2024, 1, 2, 2), F.lit("WEEKLY"), F.lit(True)).alias("in_window"),
    )


@query()
def business_due_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Due times after 600 open minutes; an order-dependent walk, checked in the tests."""
    return events(spark, sf).select("event_id", F.date_format(dates.business_due(F.col("ts"), F.lit(600)), "yyyy-MM-dd HH:mm:ss").alias("due"))


@query()
def next_cron_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Next run of a cron expression in a time zone, checked in the tests."""
    return events(spark, sf).select("event_id", F.date_format(dates.next_run(F.col("ts"), "30 6 * * 1-5", "Europe/Berlin"), "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("""SELECT CAST(count(*) FILTER (epoch(TIMESTAMP '2024-01-30') - epoch(ts) BETWEEN 0 AND 86400) / 86400.0 AS DOUBLE) AS per_second FROM events""")
def trailing_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return TS.trailing_throughput(events(spark, sf), "ts", F.lit(NOW), 86400)
