"""Queries over predicates, joins, paging, sets and arrays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import predicates as P
from ..operators import aggregates, joins, paging
from ..session import load, tenant_scope
from .registry import query


@query("""
SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value,
       round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type
""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").withColumnRenamed("event_type", "metric")
    out = aggregates.metric_summary(events, ["metric"], "value")
    return out.withColumn("avg_value", F.round("avg_value", 6)).withColumn("p95", F.round("p95", 6))


@query("""
SELECT c_custkey, c_name FROM customer
WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment <> 'BUILDING' AND c_name ILIKE '%1%' AND (c_nationkey = 3 OR c_nationkey >= 10) AND NOT (c_nationkey IN (11, 12))
""")
def filter_sql_dialect(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    keep = P.all_of([P.sql_predicate(F.col("c_acctbal"), "between", 0, 5000), P.sql_predicate(F.col("c_mktsegment"), "ne", "BUILDING"), P.sql_predicate(F.col("c_name"), "contains", "1"), P.any_of([P.sql_predicate(F.col("c_nationkey"), "eq", 3), P.sql_predicate(F.col("c_nationkey"), "gte", 10)]), ~P.sql_predicate(F.col("c_nationkey"), "in", [11, 12])])
    return c.where(keep).select("c_custkey", "c_name")


@query(r"""
SELECT p_partkey FROM part WHERE p_name ILIKE '%e%' AND p_type ILIKE 'S%' AND p_brand ILIKE '%2' ESCAPE '\' AND p_size < 40 AND p_size > 3 AND p_size <= 35 AND p_size >= 4
""")
def filter_text_and_bounds(spark: SparkSession, sf: str) -> DataFrame:
    fs = [P.Filter("p_name", "contains", "e"), P.Filter("p_type", "starts_with", "S"), P.Filter("p_brand", "ends_with", "2"), P.Filter("p_size", "lt", 40), P.Filter("p_size", "gt", 3), P.Filter("p_size", "lte", 35), P.Filter("p_size", "gte", 4)]
    return load(spark, sf, "part").where(P.all_of([P.sql_predicate(F.col(f.field), f.op, f.value, f.value2) for f in fs])).select("p_partkey")


NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)"


@query(f"""
SELECT 'sql' AS dialect, count(*) AS n FROM {NULLED} WHERE s <> 'O'
UNION ALL SELECT 'display', count(*) FROM {NULLED} WHERE coalesce(CAST(s AS VARCHAR) <> 'O', true)
UNION ALL SELECT 'event', count(*) FROM {NULLED} WHERE coalesce(s <> 'O', false)
UNION ALL SELECT 'display_not_in', count(*) FROM {NULLED} WHERE coalesce(CAST(s AS VARCHAR) NOT IN ('O', 'F'), true)
UNION ALL SELECT 'event_not_in', count(*) FROM {NULLED} WHERE coalesce(s NOT IN ('O', 'F'), false)
UNION ALL SELECT 'is_null', count(*) FROM {NULLED} WHERE s IS NULL
""")
def null_dialects(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    s = F.col("s")
    kinds = {"sql": P.sql_predicate(s, "ne", "O"), "display": P.display_predicate(s, "ne", "O"), "event": P.event_predicate(s, "ne", "O"), "display_not_in": P.display_predicate(s, "not_in", ["O", "F"]), "event_not_in": P.event_predicate(s, "not_in", ["O", "F"]), "is_null": P.sql_predicate(s, "is_null")}
    # one pass for all dialects
    counts = o.agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dialect"), F.col(k).alias("n")) for k in kinds))).alias("x")).select("x.dialect", "x.n")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20
""")
def json_field_between(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").where(P.sql_predicate(F.col("props"), "jsonb_has_key", "k") & P.display_predicate(k, "between", 10, 20)).select("event_id", k.cast("long").alias("k"))


@query("""SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def json_contains(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").where(P.sql_predicate(F.col("props"), "jsonb_contains", {"k": 7})).select("event_id")


@query("""SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_nationkey = 7""")
def tenant_scoped(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return tenant_scope(c, F.col("c_nationkey"), 7).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("""
SELECT event_id FROM events WHERE (value > 60 AND NOT (event_type = 'view')) OR event_type = 'error'
""")
def rule_tree_filter(spark: SparkSession, sf: str) -> DataFrame:
    leaf = {"high": F.col("value") > 60, "view": F.col("event_type") == "view", "error": F.col("event_type") == "error"}
    return load(spark, sf, "events").where(P.rule_tree({"any": [{"all": ["high", {"not": "view"}]}, "error"]}, leaf)).select("event_id")


@query("""SELECT event_id FROM events WHERE (value >= 30 AND event_type = 'click') OR NOT (value < 95.5)""")
def expression_filter(spark: SparkSession, sf: str) -> DataFrame:
    names = {"value": F.col("value"), "kind": F.col("event_type")}
    wanted = P.any_of([P.all_of([names["value"] >= 30, names["kind"] == "click"]), ~(names["value"] < 95.5)])
    return load(spark, sf, "events").where(wanted).select("event_id")


@query("""
WITH routes(route, kind, least) AS (VALUES ('all', NULL, 0.0), ('errors', 'error', 0.0), ('big_clicks', 'click', 50.0))
SELECT event_id, route FROM events JOIN routes ON (kind IS NULL OR kind = event_type) AND value >= least
""")
def route_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    routes = spark.createDataFrame([("all", None, 0.0), ("errors", "error", 0.0), ("big_clicks", "click", 50.0)], "route string, kind string, least double")
    match = (F.col("kind").isNull() | (F.col("kind") == F.col("event_type"))) & (F.col("value") >= F.col("least"))
    return joins.theta_join(load(spark, sf, "events"), routes, match).select("event_id", "route")


@query("""
SELECT page_id, regexp_matches(path, '^/[^/]+/[0-9]+$') AS by_segment, true AS by_any, regexp_matches(path, '^/en(/.*)?$') AS by_prefix
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '\\.html$', '') AS path FROM pages)
""")
def path_globs(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1), r"\.html$", "")
    return load(spark, sf, "pages").select("page_id", (path.rlike(P.path_pattern("/*/*")) & path.rlike(r"^/[^/]+/[0-9]+$")).alias("by_segment"), path.rlike(P.path_pattern("/**")).alias("by_any"), path.rlike(P.path_pattern("/en/**")).alias("by_prefix"))


@query("""
WITH t(topic, target) AS (VALUES ('c*', 'a'), ('?iew', 'b'), ('[ep]*', 'c'))
SELECT target, count(*) AS n FROM events JOIN t ON event_type GLOB topic GROUP BY target
""")
def topic_routing(spark: SparkSession, sf: str) -> DataFrame:
    topics = spark.createDataFrame([(P.topic_pattern(p), t) for p, t in (("c*", "a"), ("?iew", "b"), ("[ep]*", "c"))], "pattern string, target string")
    # event types are few: routed once each, then joined by equality
    events = load(spark, sf, "events").groupBy("event_type").count()
    return joins.theta_join(events, topics, F.expr("event_type RLIKE pattern")).groupBy("target").agg(F.sum("count").alias("n"))


@query("""
SELECT c_custkey, c_nationkey % 3 <= 1 AND (c_custkey % 4 = 0 OR c_custkey % 4 = 1) AND (c_custkey % 5 <> 0 OR c_mktsegment = 'BUILDING') AS readable FROM customer
""")
def row_level_access(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    roles = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 4 == 1, F.array(F.lit(" Ops "))).otherwise(F.array(F.lit("finance")))
    project = F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment"))
    ok = P.tenant_readable(F.lit("o"), F.col("c_nationkey") % 3, roles, project, organization_id="o", clearance=1, roles=["ops"], projects=["BUILDING"])
    return c.select("c_custkey", ok.alias("readable"))


@query("""
SELECT s_suppkey, s_nationkey % 2 = 0 AND NOT (s_suppkey % 3 = 0) AS placed FROM supplier
""")
def label_placement(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.create_map(F.lit("env"), F.when(F.col("s_nationkey") % 2 == 0, "prod").otherwise("staging"), F.lit("risk"), F.when(F.col("s_suppkey") % 3 == 0, "high").otherwise("low"))
    return load(spark, sf, "supplier").select("s_suppkey", P.labels_match(labels, {"env": "prod"}, {"risk": "high"}).alias("placed"))


@query("""
SELECT c_custkey, (CAST(('0x' || substr(sha256('beta:' || c_name), 1, 8)) AS BIGINT) % 10000) / 100.0 AS bucket,
       (CAST(('0x' || substr(sha256('beta:' || c_name), 1, 8)) AS BIGINT) % 10000) / 100.0 < 25.0 AND c_custkey % 10 <> 0 AS enabled
FROM customer
""")
def flag_rollout(spark: SparkSession, sf: str) -> DataFrame:
    b = P.rollout_bucket(F.lit("beta"), F.col("c_name"))
    none = F.lit(None).cast("timestamp")
    on = P.flag_enabled(F.lit(True), F.col("c_custkey") % 10 == 0, F.lit(25.0), b, none, none, F.lit(datetime(2024, 1, 1)))
    return load(spark, sf, "customer").select("c_custkey", b.alias("bucket"), on.alias("enabled"))


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate > TIMESTAMP '1996-01-01' OR (o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey > 100)) ORDER BY o_orderdate, o_orderkey LIMIT 51)
""")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return paging.keyset_page(o, "o_orderdate", "o_orderkey", (datetime(1996, 1, 1), 100), 50).select("o_orderkey")


@query("""SELECT c_custkey, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer) > 60 AS has_next FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 20 OFFSET 40""")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    fields = paging.parse_sort("c_mktsegment,c_acctbal:desc,c_custkey:asc:nulls_last")
    page = paging.offset_page(load(spark, sf, "customer"), fields, page=3, size=20)
    return page.rows.select("c_custkey", F.lit(page.total).cast("long").alias("total"), F.lit(page.has_next).alias("has_next"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE value > 90 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")
def error_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.top_counts(load(spark, sf, "events").where("value > 90"), "event_type", 3)


@query("""SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10""")
def slowest(spark: SparkSession, sf: str) -> DataFrame:
    return paging.top_by(load(spark, sf, "events"), "value", ["event_id"], 10).select("event_id", "value")


@query("""SELECT DISTINCT c_nationkey FROM customer""")
def distinct_tenants(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_nationkey").distinct()


@query("""SELECT c_nationkey AS tenant FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation""")
def tenant_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = [load(spark, sf, t).select(F.col(c).alias("tenant")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""SELECT DISTINCT p_brand, p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49""")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").join(load(spark, sf, "lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_brand", "p_type").distinct()


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def exists_orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").join(load(spark, sf, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 2
""")
def latest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_per_key(load(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("""
SELECT s_suppkey, count(l_orderkey) AS lines FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' GROUP BY s_suppkey
""")
def vendor_performance(spark: SparkSession, sf: str) -> DataFrame:
    # aggregated first, so what is joined has a row for each vendor
    lines = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    s = load(spark, sf, "supplier")
    return s.join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""SELECT c_custkey, coalesce(n_name, CAST(k AS VARCHAR)) AS nation FROM (SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 100 ELSE 0 END AS k FROM customer) LEFT JOIN nation ON n_nationkey = k""")
def lookup_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").withColumn("k", F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 100).otherwise(0))
    return joins.with_lookup(c, load(spark, sf, "nation"), "k", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("""
WITH a AS (SELECT * FROM events WHERE event_type = 'error'), p AS (
  SELECT a.event_id AS id, c.event_id AS cid, a.user_id <> c.user_id AS apart, CASE c.event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS rank, c.ts AS t
  FROM a JOIN events c ON c.ts <= a.ts AND a.ts - c.ts <= INTERVAL 30 MINUTE AND a.event_id <> c.event_id)
SELECT id, cid AS parent_id, CASE WHEN apart THEN 'time' ELSE 'dependency' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY apart, rank, t DESC, cid) AS r FROM p) WHERE r = 1
""")
def alert_correlation(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2).alias("rank"), F.array(F.col("user_id").cast("string")).alias("refs"), "event_type")
    return joins.correlate(e.where("event_type = 'error'").drop("event_type"), e.drop("event_type"), 1800)


@query("""
WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), p AS (SELECT user_id, ts, event_id AS pid FROM events WHERE event_type = 'signup'),
j AS (SELECT r.event_id, p.pid, row_number() OVER (PARTITION BY r.event_id ORDER BY p.ts DESC NULLS LAST, p.pid) AS k FROM r LEFT JOIN p ON p.user_id = r.user_id AND p.ts <= r.ts),
f AS (SELECT user_id, min(ts) AS first_at FROM p GROUP BY user_id)
SELECT r.event_id, j.pid AS point, CASE WHEN f.first_at IS NULL THEN 'no_points_available' WHEN j.pid IS NULL THEN 'requested_before_earliest' END AS refusal
FROM r JOIN j ON j.event_id = r.event_id AND k = 1 LEFT JOIN f ON f.user_id = r.user_id
""")
def asof_restore_point(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    requests = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    points = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("available_at"), F.col("event_id").alias("point"))
    found = joins.asof_join(requests, points, ["user_id"], "ts", "available_at", "point")
    none = F.lit(None).cast("timestamp")
    return found.select("event_id", F.col("found_point").alias("point"), joins.restore_refusal(F.col("found_at"), F.col("first_at"), none, none).alias("refusal"))


ORDER_SPANS = "(SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_shipdate) > o_orderdate)"


@query(f"""
SELECT a.k AS o_custkey, a.id AS left_id, b.id AS right_id FROM {ORDER_SPANS} a JOIN {ORDER_SPANS} b ON a.k = b.k AND a.id < b.id
WHERE epoch(a.s) - 3600 < epoch(b.e) AND epoch(b.s) < epoch(a.e) + 3600
""")
def interval_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    last = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ends_at"))
    spans = load(spark, sf, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey")).where("ends_at > o_orderdate").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("starts_at"), "ends_at")
    return joins.interval_join(spans, "o_custkey", "o_orderkey", "starts_at", "ends_at", slack=3600)


@query("""
WITH w(scope, a, b) AS (VALUES (NULL, TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 06:00:00'), ('7', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-20 00:00:00'))
SELECT event_id AS id, CASE WHEN EXISTS (SELECT 1 FROM w WHERE (scope IS NULL OR scope = CAST(user_id AS VARCHAR)) AND ts BETWEEN a AND b) THEN 'maintenance_window' WHEN user_id = 9 THEN 'suppression' END AS suppressed_by
FROM events WHERE event_type = 'error'
""")
def alert_suppression(spark: SparkSession, sf: str) -> DataFrame:
    alerts = load(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.array(F.col("user_id").cast("string")).alias("refs"))
    windows = spark.createDataFrame([(None, datetime(2024, 1, 5), datetime(2024, 1, 5, 6)), ("7", datetime(2024, 1, 1), datetime(2024, 1, 20))], "scope string, starts_at timestamp_ntz, ends_at timestamp_ntz")
    rules = spark.createDataFrame([("9",)], "scope string")
    return joins.suppressed(alerts, windows, rules).select("id", "suppressed_by")


@query("""
SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY k
""")
def merged_counters(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return joins.merge_counts(a, b, ["k"], ["n"])


@query("""
SELECT caller, callee, count(*) AS calls FROM (
  SELECT p.user_id % 10 AS caller, c.user_id % 10 AS callee FROM events p JOIN events c ON c.event_id = p.event_id + 1) WHERE caller <> callee GROUP BY caller, callee
""")
def service_edges(spark: SparkSession, sf: str) -> DataFrame:
    spans = load(spark, sf, "events").select(F.lit(0).alias("trace_id"), F.col("event_id").alias("span_id"), (F.col("event_id") - 1).alias("parent_span_id"), (F.col("user_id") % 10).alias("service"))
    return joins.spans_to_edges(spans)


@query("""SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def repeated_texts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS r FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM f WHERE r = 1)
SELECT conv_id, role, count(*) AS n FROM k WHERE q <= 3 GROUP BY conv_id, role
""")
def message_digest(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.digest(load(spark, sf, "conversations"), "conv_id", "role", ["role", "text"], ["turn"], 3)


@query("""
SELECT doc_id, list_count(list_filter(string_split(lower(text), ' '), lambda x: x = 'the')) AS n_the, len(list_distinct(string_split(lower(text), ' '))) AS n_distinct FROM documents
""")
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(F.lower("text"), " ")
    return load(spark, sf, "documents").select("doc_id", F.size(F.filter(words, lambda x: x == "the")).cast("long").alias("n_the"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("""
SELECT o_orderkey, [x for x in ['owner', 'team'] if x = 'team' AND o_orderkey % 2 = 0 OR x = 'owner' AND o_orderkey % 3 = 0] AS missing FROM orders
""")
def tag_policy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.create_map(F.lit("team"), F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("ops")), F.lit("owner"), F.when(k % 3 != 0, F.lit("me")))
    missing = F.filter(F.array(F.lit("owner"), F.lit("team")), lambda t: F.trim(F.coalesce(F.element_at(tags, t), F.lit(""))) == "")
    return load(spark, sf, "orders").select("o_orderkey", missing.alias("missing"))
