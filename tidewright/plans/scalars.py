"""Queries over scalar expressions: scoring, pricing, rates, clocks, text and hashes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S, text as T
from ..operators import ranking as R, vectors as V
from ..session import load, spread
from .registry import query


@query("""
SELECT s_suppkey, CASE WHEN x >= 75 THEN 'critical' WHEN x >= 50 THEN 'high' WHEN x >= 25 THEN 'medium' ELSE 'low' END AS risk,
  CASE WHEN x >= 90 THEN 'emergency' WHEN x >= 80 THEN 'critical' WHEN x >= 70 THEN 'high' WHEN x >= 60 THEN 'warning' WHEN x >= 50 THEN 'info' END AS level,
  CASE WHEN x / 100 >= 0.9 THEN 'critical' WHEN x / 100 >= 0.7 THEN 'warning' ELSE 'ok' END AS use_level, CASE WHEN x / 80 >= 1 THEN 'exceeded' WHEN x / 80 >= 0.9 THEN 'critical' WHEN x / 80 >= 0.7 THEN 'warning' ELSE 'ok' END AS budget,
  CASE WHEN x / 100 <= 0.2 THEN 'downsize' WHEN x / 100 >= 0.8 THEN 'upsize' ELSE 'none' END AS size_hint, CASE WHEN s_suppkey % 9 = 0 THEN 'warning' WHEN x >= 60 THEN 'critical' WHEN x >= 30 THEN 'warning' ELSE 'healthy' END AS lag,
  CASE WHEN x >= 95 THEN 'compliant' WHEN x >= 94 THEN 'at_risk' ELSE 'violated' END AS sla, CASE WHEN x - 30 <= 0 THEN 'violated' WHEN x - 30 <= 20 THEN 'at_risk' ELSE 'compliant' END AS slo
FROM (SELECT s_suppkey, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS x FROM supplier)
""")
def level_bands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = (k * 37 % 101).cast("double")
    levels = [("info", 50), ("warning", 60), ("high", 70), ("critical", 80), ("emergency", 90)]
    return load(spark, sf, "supplier").select(
        "s_suppkey", S.risk_bucket(x).alias("risk"), S.threshold_level(x, levels).alias("level"), S.utilization_level(S.utilization(F.lit(100), x), 0.7, 0.9).alias("use_level"), S.budget_status(x, F.lit(80.0), 0.7, 0.9).alias("budget"),
        S.rightsizing(S.utilization(F.lit(100), x), 0.2, 0.8).alias("size_hint"), S.lag_level(F.when(k % 9 != 0, x), 30, 60).alias("lag"), S.sla_status(x, F.lit(95.0)).alias("sla"), S.slo_status(x - 30).alias("slo"),
    )


@query("""
SELECT p_partkey, round_even(a * b / 25.0 * 100.0, 2) AS assessed, CAST(round_even(least(99.0, 45.0 + least(9.0, greatest(0, p_size - 1) * 0.5)), 2) AS DOUBLE) AS finding, greatest(a * b / 25.0, c / 5.0) AS change_score,
  CASE WHEN greatest(a * b / 25.0, c / 5.0) >= 0.75 THEN 'critical' WHEN greatest(a * b / 25.0, c / 5.0) >= 0.5 THEN 'high' WHEN greatest(a * b / 25.0, c / 5.0) >= 0.25 THEN 'medium' ELSE 'low' END AS change_level,
  CAST(round(a * 10 * 0.5 + b * 10 * 0.3 + c * 10 * 0.2, 6) AS DOUBLE) AS composite
FROM (SELECT p_partkey, p_size, p_partkey % 5 + 1 AS a, p_size % 5 + 1 AS b, p_partkey % 3 + 1 AS c FROM part)
""")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, b, c = F.col("p_partkey") % 5 + 1, F.col("p_size") % 5 + 1, F.col("p_partkey") % 3 + 1
    score = S.change_score(a, b, [c, F.lit(1)])
    return load(spark, sf, "part").select("p_partkey", S.risk_assessment(a, b).alias("assessed"), S.finding_risk(F.lit("medium"), F.col("p_size")).alias("finding"), score.alias("change_score"), S.change_risk_level(score).alias("change_level"), F.round(S.composite_score(a * 10, b * 10, c * 10), 6).alias("composite"))


@query("""
SELECT s_suppkey, round(CASE WHEN b = 0 THEN CASE WHEN c = 0 THEN 0.0 WHEN c > 0 THEN 100.0 ELSE -100.0 END ELSE (c - b) / abs(b) * 100 END, 6) AS change,
  CASE WHEN c / 400 < 0.5 THEN 'low' WHEN c / 400 < 0.75 THEN 'medium' WHEN c / 400 < 1 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN b + c = 0 THEN NULL ELSE round(c / (b + c), 9) END AS rate_null, CASE WHEN b = 0 THEN 0.0 ELSE round(c / b, 9) END AS rate_zero, CASE WHEN b = 0 THEN 100.0 ELSE round(100 * c / b, 6) END AS rate_full,
  round(c * pow(1.05, 3), 6) AS projected, CASE WHEN c >= 500 THEN 0.0 WHEN c <= 0 THEN NULL ELSE round(ln(500 / c) / ln(1.05), 6) END AS periods, (c - b) / 7 AS per_day, greatest(0, c + (b - c) / 7 * 10) AS ahead
FROM (SELECT s_suppkey, CAST(s_suppkey % 4 AS DOUBLE) AS b, CAST(s_suppkey * 13 % 450 AS DOUBLE) AS c FROM supplier)
""")
def rates_and_projections(spark: SparkSession, sf: str) -> DataFrame:
    b, c = (F.col("s_suppkey") % 4).cast("double"), (F.col("s_suppkey") * 13 % 450).cast("double")
    return load(spark, sf, "supplier").select(
        "s_suppkey", F.round(S.percent_change(b, c), 6).alias("change"), S.regression_severity(c, 400.0).alias("severity"), F.round(S.rate(c, b + c), 9).alias("rate_null"), F.round(S.rate(c, b, 0.0), 9).alias("rate_zero"), F.round(S.rate(c, b, 100.0, 100.0), 6).alias("rate_full"),
        F.round(S.project_value(c, F.lit(5.0), F.lit(3)), 6).alias("projected"), F.round(S.periods_until(c, F.lit(5.0), F.lit(500.0)), 6).alias("periods"), S.growth_per_day(b, c, F.lit(7)).alias("per_day"), S.forecast_value(c, (b - c) / 7, F.lit(10)).alias("ahead"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(least(q, 10) * 1.0 + greatest(0, least(q - 10, 10)) * 0.5 + greatest(0, least(q - 20, 20)) * 0.25 + greatest(0, q - 40) * 0.25, 6) AS tiered,
  CASE l_linenumber % 4 WHEN 0 THEN q WHEN 1 THEN q / 3 WHEN 2 THEN q / 12 ELSE 0.0 END AS mrr, round(q * (1 - l_discount * 100 / 100.0), 9) AS after_percent, greatest(0, q - 12.5) AS after_fixed,
  CASE WHEN l_linenumber % 2 = 0 THEN true ELSE q + 5 <= 30 + 10 END AS allowed FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)
""")
def pricing(spark: SparkSession, sf: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    model = F.when(n % 4 == 0, "monthly").when(n % 4 == 1, "quarterly").when(n % 4 == 2, "annual").otherwise("once")
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(S.tiered_price(q, [(10, 1.0), (10, 0.5), (20, 0.25)]), 6).alias("tiered"), S.monthly_recurring(q, model).alias("mrr"), F.round(S.percentage_discount(q, F.col("l_discount") * 100), 9).alias("after_percent"),
        S.fixed_discount(q, F.lit(12.5)).alias("after_fixed"), S.request_allowed(q, F.lit(5), F.lit(30), F.when(n % 2 == 0, "soft").otherwise("hard"), F.lit(10)).alias("allowed"),
    )


@query("""SELECT l_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS subtotal, round(coalesce(sum(l_quantity), 0), 6) AS used FROM lineitem GROUP BY l_orderkey""")
def invoice_subtotals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("subtotal"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0)), 6).alias("used"))


@query("""
WITH c AS (SELECT event_id, epoch(ts) AS s, epoch(ts) + 7200 AS due, epoch(TIMESTAMP '2024-01-30') AS now, CASE WHEN event_id % 3 = 0 THEN epoch(ts) + 3600 END AS met, CASE WHEN event_id % 5 = 0 THEN epoch(ts) + 1800 END AS paused FROM events)
SELECT event_id, round(greatest(0, coalesce(met, now) - s - (60 + coalesce(coalesce(met, now) - paused, 0))), 2) AS elapsed, CASE WHEN met IS NOT NULL THEN false WHEN paused IS NOT NULL THEN false ELSE now >= due END AS breached,
  CASE WHEN met IS NOT NULL THEN false ELSE now >= s + (due - s) * 0.8 END AS warn, CASE WHEN event_id % 2 = 0 THEN 'client' ELSE 'server' END AS winner FROM c
""")
def sla_clocks(spark: SparkSession, sf: str) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id")
    now, none = F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    met, paused = F.when(k % 3 == 0, ts + F.expr("INTERVAL 1 HOUR")), F.when(k % 5 == 0, ts + F.expr("INTERVAL 30 MINUTES"))
    due = ts + F.expr("INTERVAL 2 HOURS")
    return load(spark, sf, "events").select(
        "event_id", F.round(S.elapsed_seconds(ts, now, F.lit(60.0), paused, met, none), 2).alias("elapsed"), S.breached(due, now, paused, met, none).alias("breached"), S.should_warn(ts, due, now, 80, met, none).alias("warn"),
        S.resolve_sync("last_write_wins", F.when(k % 2 == 0, due).otherwise(ts), ts).alias("winner"),
    )


EXPERIMENT = """
WITH a AS (SELECT d.lang, count(*) FILTER (d.doc_id % 2 = 0) AS n1, count(*) FILTER (d.doc_id % 2 = 0 AND quality = 1) AS k1, count(*) FILTER (d.doc_id % 2 = 1) AS n2, count(*) FILTER (d.doc_id % 2 = 1 AND quality = 1) AS k2 FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang),
p AS (SELECT *, (k1 + k2) / (n1 + n2) AS q FROM a), s AS (SELECT *, sqrt(q * (1 - q) * (1.0 / n1 + 1.0 / n2)) AS e FROM p)
SELECT lang, n1, n2, CASE WHEN n1 < 2 OR n2 < 2 OR e = 0 THEN 0.0 ELSE round((k2 / n2 - k1 / n1) / e, 6) END AS z FROM s
"""


@query(EXPERIMENT)
def experiment_z(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    even, good = F.col("doc_id") % 2 == 0, F.col("quality") == 1
    arms = both.groupBy("lang").agg(F.count_if(even).alias("n1"), F.count_if(even & good).alias("k1"), F.count_if(~even).alias("n2"), F.count_if(~even & good).alias("k2"))
    return arms.select("lang", "n1", "n2", F.round(S.z_test(*(F.col(c) for c in ("n1", "k1", "n2", "k2"))), 6).alias("z"))


@query(f"""
WITH zs AS ({EXPERIMENT}), t AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM zs),
p AS (SELECT lang, n1, n2, z, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (((((1.330274429 * t - 1.821255978) * t + 1.781477937) * t - 0.356563782) * t + 0.319381530) * t) AS p FROM t)
SELECT lang, n1, n2, z, round(p, 6) AS p, CASE WHEN n1 < 30 OR n2 < 30 THEN 'insufficient_samples' WHEN round(p, 6) < 0.05 THEN 'significant' ELSE 'not_significant' END AS verdict FROM p
""")
def experiment_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """p-value of the z-test and a verdict behind a least number of samples."""
    z = experiment_z(spark, sf)
    p = 2 * (1 - S.normal_cdf(F.abs("z")))
    few = (F.col("n1") < 30) | (F.col("n2") < 30)
    return z.withColumn("p", F.round(p, 6)).withColumn("verdict", F.when(few, "insufficient_samples").when(F.col("p") < 0.05, "significant").otherwise("not_significant"))


@query("""
SELECT p_partkey, lower(p_type[1] || regexp_replace(p_type[2:], '([A-Z])', '_\\1', 'g')) AS t, CASE WHEN length(p_name) <= 12 THEN p_name ELSE substr(p_name, 1, 9) || '...' END AS short, CASE WHEN length(p_brand) <= 4 THEN repeat('*', length(p_brand)) ELSE repeat('*', length(p_brand) - 4) || right(p_brand, 4) END AS masked,
  sha256(p_name || '|' || p_brand || '|' || p_size) AS hash, substr(sha256(p_name || '|' || p_brand), 1, 32) AS fp, trim(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part
""")
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return load(spark, sf, "part").select(
        "p_partkey", T.snake_case(F.col("p_type")).alias("t"), T.truncate(name, 12).alias("short"), T.masked(brand).alias("masked"), T.stable_hash(name, brand, F.col("p_size")).alias("hash"), T.fingerprint(name, brand).alias("fp"), T.slugify(F.concat(name, F.lit(" #"), brand)).alias("slug"),
    )


@query("""SELECT doc_id, sha256(encode('m1') || '\\x00'::BLOB || encode(text)) AS content_hash FROM documents""")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text"), F.lit("m1")).alias("content_hash"))


@query("""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')) AS BIGINT) AS n_tokens FROM documents
""")
def search_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(T.search_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""
WITH p AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS w FROM benchmark)
SELECT item_id, CAST(sum(1 + CASE WHEN length(w) > 6 THEN ceil((length(w) - 6) / 4.0) ELSE 0 END + CASE WHEN regexp_full_match(w, '[\\x00-\\x7F]*') THEN 0 ELSE ceil(length(w) / 2.0) END) AS BIGINT) AS tokens FROM p GROUP BY item_id
""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query()
def redactions(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted texts (word boundaries are Unicode's, which DuckDB's aren't), checked in the tests."""
    found = T.redacted(spread(load(spark, sf, "documents").select("doc_id", "text")), "text")
    return found.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.array_join("kinds", ",").alias("kinds"))


@query(r"""
SELECT conv_id, turn, regexp_matches(text, '(?i)\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|from\s+now\s+on\s+you)\b') AS role_change, regexp_matches(text, '(?i)\b(?:developer\s+mode|jailbreak|do\s+anything\s+now|dan\s+mode)\b') AS bypass FROM conversations
""")
def injection_screen(spark: SparkSession, sf: str) -> DataFrame:
    found = T.injections(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_contains(found, "role_reassignment").alias("role_change"), F.array_contains(found, "safety_bypass").alias("bypass"))


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) END AS jaccard FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def answer_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.token_jaccard(F.col("text"), F.col("next_text")).alias("jaccard"))


def _last(mark: str) -> str:
    """Where the last such mark of the window ends, or NULL."""
    return f"CASE WHEN instr(v, reverse({mark})) > 0 THEN stop - instr(v, reverse({mark})) + 1 END"


SENTENCES = ", ".join(_last(m) for m in ("'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"))
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, trim(coalesce(text, ''), {BLANKS}) AS body FROM documents),
r AS (
  SELECT doc_id, rid, body, CAST(-1 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM d
  UNION ALL
  SELECT doc_id, rid, body, first, CASE WHEN cut > first THEN cut ELSE stop END FROM (
    SELECT *, CASE WHEN stop = length(body) THEN stop ELSE coalesce({_last("chr(10) || chr(10)")}, nullif(list_reduce(list_prepend(-5, list_filter([{SENTENCES}], lambda e: e IS NOT NULL)), lambda kept, e: CASE WHEN e - 2 > kept THEN e ELSE kept END), -5), {_last("' '")}, stop) END AS cut FROM (
      SELECT *, reverse(substr(body, stop - stop // 3 + 1, stop // 3)) AS v FROM (
        SELECT *, least(first + 1000, length(body)) AS stop FROM (
          SELECT doc_id, rid, body, CASE WHEN a < 0 THEN 0 ELSE greatest(b - 100, a + 1) END AS first FROM r WHERE a < 0 OR b < length(body)))))),
c AS (SELECT doc_id, rid, a, b, trim(substr(body, a + 1, b - a), {BLANKS}) AS content FROM r WHERE a >= 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY a) - 1 AS INTEGER) AS sequence, CAST(a AS INTEGER) AS start_at, CAST(b AS INTEGER) AS end_at, sha256(content) AS content_hash FROM c WHERE content <> ''
"""


@query(CHUNKS)
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of whole texts, as arrays."""
    docs = spread(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.chunked(F.col("text"), 1000, 100)).alias("c"))
    return docs.select("doc_id", "c.sequence", "c.start_at", "c.end_at", F.sha2("c.content", 256).alias("content_hash"))


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*') AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_.][a-z0-9]+)*')) AS term FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, CAST(doc_id AS VARCHAR)) AS rank FROM r)
SELECT query_id, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10
""")
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    queries = load(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    scored = R.bm25(spread(load(spark, sf, "documents").select("doc_id", "text")), queries).withColumn("score", F.round("score", 9))
    return R.top_per_query(scored, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"))


ARMS = "(SELECT vec_id % 7 AS query_id, 'a' AS arm, vec_id AS key, CAST(vec_id * 31 % 97 AS DOUBLE) AS score FROM embeddings UNION ALL SELECT vec_id % 7, 'b', vec_id, CAST(vec_id * 17 % 53 AS DOUBLE) FROM embeddings WHERE vec_id % 3 > 0)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, key) AS rank, min(score) OVER (PARTITION BY query_id, arm) AS lo, max(score) OVER (PARTITION BY query_id, arm) AS hi FROM {ARMS})"


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.windows import to_ranked

    v = load(spark, sf, "embeddings").select("vec_id")
    k = F.col("vec_id")
    a = v.select((k % 7).alias("query_id"), F.lit("a").alias("arm"), k.alias("key"), (k * 31 % 97).cast("double").alias("score"))
    b = v.where(k % 3 > 0).select((k % 7).alias("query_id"), F.lit("b").alias("arm"), k.alias("key"), (k * 17 % 53).cast("double").alias("score"))
    return to_ranked(a.unionByName(b), ["query_id", "arm"], "score", "key")


@query(f"""SELECT query_id, key, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, key) AS rank FROM (SELECT query_id, key, sum(1.0 / (60 + rank)) AS score, min(rank) AS best FROM {RANKED} GROUP BY ALL)""")
def fusion_reciprocal(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(_arms(spark, sf), "rrf").select("query_id", "key", F.round("score", 9).alias("score"), "rank")


@query(f"""SELECT query_id, key, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, key) AS rank FROM (SELECT query_id, key, sum(CASE arm WHEN 'a' THEN 0.75 ELSE 0.25 END * CASE WHEN hi <= lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS score, min(rank) AS best FROM {RANKED} GROUP BY ALL)""")
def fusion_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(_arms(spark, sf), "weighted", {"a": 0.75, "b": 0.25}).select("query_id", "key", F.round("score", 9).alias("score"), "rank")


@query(f"""SELECT query_id, key, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, key) AS rank FROM (SELECT query_id, key, max(CASE WHEN hi <= lo THEN 1 ELSE (score - lo) / (hi - lo) END) AS score, min(rank) AS best FROM {RANKED} GROUP BY ALL)""")
def fusion_max(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(_arms(spark, sf), "max").select("query_id", "key", F.round("score", 9).alias("score"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), e) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(e, e))) AS c FROM embeddings, q WHERE label <= 5)
SELECT query_id, vec_id, round(greatest(0, c), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, CAST(vec_id AS VARCHAR)) AS r FROM s) WHERE r <= 20
""")
def vector_top(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.search_exact(v.where("label <= 5"), queries, 20).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query()
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Feature hashing by blake2b (no SQL has it), checked in the tests."""
    return load(spark, sf, "benchmark").select("item_id", F.transform(R.encode(F.col("text"), 64), lambda x: F.round(x, 9)).alias("vector"))


@query("""
WITH q AS (SELECT ['mint', 'steel', 'small'] AS w), p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t, string_split(lower(p_type), ' ') AS k, string_split(lower(p_brand), ' ') AS s FROM part)
SELECT p_partkey, (3 * len(list_intersect(w, t)) + 2 * len(list_intersect(w, k)) + len(list_intersect(w, s))) / 3.0 AS score FROM p, q
""")
def field_search(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda c: F.split(F.lower(c), " ")
    q = F.array(*(F.lit(w) for w in ("mint", "steel", "small")))
    return load(spark, sf, "part").select("p_partkey", R.field_score(q, words("p_name"), words("p_type"), words("p_brand")).alias("score"))
