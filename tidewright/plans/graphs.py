"""Queries over graphs, sources, streams and state machines."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S
from ..operators import graph as G
from ..sources import documents as D, events as E
from ..session import load, shared_folder
from ..streaming import signals as SG
from .registry import query

NATION_EDGES = "(SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customer nation -> supplier nation, over all orders."""
    o = load(spark, sf, "orders")
    lines = load(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    c, s = load(spark, sf, "customer").select("c_custkey", "c_nationkey"), load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    both = lines.join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return both.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query(f"""SELECT dst AS neighbour, 'out' AS direction FROM {NATION_EDGES} WHERE src = 5 UNION ALL SELECT src, 'in' FROM {NATION_EDGES} WHERE dst = 5""")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return G.neighbours(nation_edges(spark, sf), 5)


TREE = "(SELECT c_custkey AS dst, (c_custkey - 1) // 3 AS src, c_custkey AS edge_id FROM customer WHERE c_custkey >= 1)"


def tree(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").where("c_custkey >= 1").select(F.col("c_custkey").alias("dst"), F.floor((F.col("c_custkey") - 1) / 3).cast("long").alias("src"), F.col("c_custkey").alias("edge_id"))


LINKED = """e AS (SELECT src, dst, src * 4 + n AS edge_id FROM (
  SELECT c_custkey AS src, unnest([2 * c_custkey, 2 * c_custkey + 1, c_custkey // 3, c_custkey + 7]) AS dst, unnest([0, 1, 2, 3]) AS n FROM customer) WHERE dst IN (SELECT c_custkey FROM customer))"""


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with up to four edges each: to twice their key, one more, a third of it, and seven on."""
    k = F.col("c_custkey")
    ends = F.array(k * 2, k * 2 + 1, F.floor(k / 3).cast("long"), k + 7)
    c = load(spark, sf, "customer").select(k)
    edges = c.select(k.alias("src"), F.posexplode(ends).alias("n", "dst"))
    return edges.join(c.select(k.alias("dst")), "dst", "left_semi").select("src", "dst", (F.col("src") * 4 + F.col("n")).alias("edge_id"))


@query(f"""
WITH RECURSIVE {LINKED},
p AS (SELECT dst AS node, 1 AS distance, [edge_id] AS used FROM e WHERE src = 3 UNION ALL SELECT e.dst, distance + 1, list_append(used, edge_id) FROM p JOIN e ON e.src = p.node AND NOT list_contains(used, edge_id) WHERE distance < 4)
SELECT DISTINCT node, distance FROM p
""")
def dependency_paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.bounded_paths(linked(spark, sf), 3, 4)


@query(f"""
WITH RECURSIVE p AS (SELECT src AS node, 1 AS distance FROM {TREE} WHERE dst = 100 UNION ALL SELECT t.src, distance + 1 FROM p JOIN {TREE} t ON t.dst = p.node WHERE distance < 5) SELECT DISTINCT node, distance FROM p
""")
def impact_paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.bounded_paths(tree(spark, sf), 100, 5, reverse=True)


@query(f"""
WITH d AS (SELECT src AS node, 1 AS o, 0 AS i FROM {NATION_EDGES} UNION ALL SELECT dst, 0, 1 FROM {NATION_EDGES}) SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM d GROUP BY node
""")
def topology_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(nation_edges(spark, sf))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT s_suppkey AS node FROM supplier), e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey + 7 IN (SELECT node FROM n)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT node, node AS c FROM n UNION SELECT b.b, r.c FROM r JOIN b ON b.a = r.node) SELECT node, min(c) AS component FROM r GROUP BY node
""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    nodes = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).distinct()
    edges = nodes.where("node % 10 <> 0").select(F.col("node").alias("src"), (F.col("node") + 7).alias("dst")).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return G.connected_components(nodes, edges)


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT s_suppkey AS node FROM supplier), e AS (SELECT DISTINCT s_suppkey AS src, s_suppkey + 5 + s_suppkey % 3 AS dst FROM supplier WHERE s_suppkey + 5 + s_suppkey % 3 IN (SELECT node FROM n)),
p AS (SELECT node, 0 AS l FROM n UNION SELECT e.dst, l + 1 FROM p JOIN e ON e.src = p.node) SELECT node, CAST(max(l) AS INTEGER) AS level FROM p GROUP BY node
""")
def execution_levels(spark: SparkSession, sf: str) -> DataFrame:
    nodes = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).distinct()
    return G.levels(nodes, nodes.select(F.col("node").alias("src"), (F.col("node") + 5 + F.col("node") % 3).alias("dst")))


@query("""
WITH s AS (SELECT l_orderkey AS t, l_linenumber AS id, l_partkey % 100 AS st, CAST(l_quantity AS BIGINT) AS d FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
k AS (SELECT c.t, p.id, greatest(c.st, p.st) AS a, least(c.st + c.d, p.st + p.d) AS b FROM s c JOIN s p ON c.t = p.t AND p.id = c.id // 2 AND c.id > 1), v AS (SELECT * FROM k WHERE b > a),
m AS (SELECT *, max(b) OVER (PARTITION BY t, id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM v), g AS (SELECT t, id, sum(greatest(0, b - greatest(a, coalesce(was, a)))) AS blocking FROM m GROUP BY t, id)
SELECT s.t AS trace_id, s.id AS span_id, CAST(coalesce(blocking, 0) AS BIGINT) AS blocking_time, CAST(d - coalesce(blocking, 0) AS BIGINT) AS self_time FROM s LEFT JOIN g USING (t, id)
""")
def span_self_times(spark: SparkSession, sf: str) -> DataFrame:
    one = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    spans = one.select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.when(F.col("l_linenumber") > 1, F.floor(F.col("l_linenumber") / 2).cast("int")).alias("parent_span_id"), (F.col("x.l_partkey") % 100).alias("start_at"), F.col("x.l_quantity").cast("long").alias("duration"), F.lit(True).alias("blocking"),
    )
    return G.self_times(spans)


@query("""
SELECT o_orderkey, (s = 'O' AND t IN ('F', 'P')) OR (s = 'P' AND t = 'F') AS legal FROM (SELECT o_orderkey, o_orderstatus AS s, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders) WHERE t IS NOT NULL
""")
def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = load(spark, sf, "orders").withColumn("target", F.lead("o_orderstatus").over(w)).where("target is not null")
    return SG.transitions(steps, {"O": ["F", "P"], "P": ["F"]}, "o_orderstatus", "target").select("o_orderkey", "legal")


@query("""
SELECT page_id, 'html' AS format, CAST(0.9 AS DOUBLE) AS confidence, CASE WHEN regexp_matches(url, '\\.html$') THEN 'html' END AS kind FROM pages
""")
def page_formats(spark: SparkSession, sf: str) -> DataFrame:
    g = D.detect_format(F.encode("html", "UTF-8"), F.col("url"), F.lit(None).cast("string"))
    kind = D.detect_kind(F.col("url"), F.lit(None).cast("string"))
    return load(spark, sf, "pages").select("page_id", g["format"].alias("format"), g["confidence"].alias("confidence"), F.when(F.endswith("url", F.lit(".html")), kind).alias("kind"))


@query("""
WITH s AS (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 999) // 1000))) AS page FROM documents) SELECT doc_id, CAST(page AS INTEGER) AS page, length(substr(text, page * 1000 + 1, 1000)) AS n FROM s
""")
def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.posexplode(D.pages_of(F.col("text"), 1000)).alias("page", "body"))
    return docs.select("doc_id", "page", F.length("body").cast("long").alias("n"))


@query("""
SELECT event_id FROM (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 500) WHERE event_type = 'error'
""")
def event_log_query(spark: SparkSession, sf: str) -> DataFrame:
    return E.query(load(spark, sf, "events"), F.lit(datetime(2024, 1, 5)), F.lit(datetime(2024, 1, 10)), F.col("event_type") == "error", 500).select("event_id")


@query("""
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'missing_required_field' WHEN epoch(TIMESTAMP '2024-01-20') - epoch(ts) > 604800 THEN 'timestamp_too_old' END AS reason,
  user_id % 11 <> 0 AND epoch(ts) - epoch(TIMESTAMP '2024-01-20') > 300 AS was_clamped FROM events
""")
def signal_validation(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", F.col("ts").alias("occurred_at"), F.create_map(F.lit("kind"), F.col("event_type")).alias("labels"), F.col("props").alias("message"), (F.col("user_id") % 11 != 0).alias("required_present"))
    return SG.validate(e, F.lit(datetime(2024, 1, 20))).select("event_id", "reason", "was_clamped")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS n FROM s GROUP BY user_id, k
""")
def incident_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return SG.incident_sessions(load(spark, sf, "events"), ["user_id"], "ts", "6 hours").select("user_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "n")


def _sink_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _batches(folder: str):
    """A sink that a restart can repeat: each batch overwrites its own folder."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


@query("""
SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL
""")
def streamed_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A windowed aggregate over a stream, run until all input is read; the last state of each window counts."""
    counts = _as_stream(spark, sf).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = _sink_dir(spark, "daily")
    counts.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{out}/data")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def _as_stream(spark: SparkSession, sf: str) -> DataFrame:
    batch = load(spark, sf, "events")
    out = _sink_dir(spark, "source")
    # a file stream reads folders: the table goes into one
    batch.write.parquet(out)
    return spark.readStream.schema(batch.schema).parquet(out)


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS d FROM events) GROUP BY ALL""")
def streamed_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats dropped across batches by key within a watermark."""
    key = F.concat_ws("|", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    stream = SG.distinct_signals(_as_stream(spark, sf).withColumn("key", key).withColumn("at", F.col("ts").cast("timestamp")), "key", "at", "60 days")
    out = _sink_dir(spark, "distinct")
    SG.drain(stream, f"{out}/state", _batches(f"{out}/data"))
    return spark.read.parquet(f"{out}/data").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT user_id, n, t, t AS began, 1 AS used, 0.0::DOUBLE AS blocked, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, t, CASE WHEN fresh THEN t ELSE began END, CASE WHEN shut THEN used ELSE now END, CASE WHEN NOT shut AND now > 3 THEN t + 43200 ELSE blocked END, NOT shut AND now <= 3
  FROM (SELECT *, CASE WHEN fresh THEN 1 ELSE used + 1 END AS now FROM (
    SELECT e.*, r.began, r.used, r.blocked, e.t < r.blocked AS shut, e.t >= r.blocked AND (e.t - r.began >= 21600 OR r.used = 0) AS fresh FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.n = r.n + 1)))
SELECT user_id, t, allowed FROM r
""")
def streamed_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed window from a key's first hit; going over it blocks the key for a while."""
    stream = _as_stream(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    limited = SG.rate_limited(stream, "user_id", "at", 3, 6 * 3600.0, 12 * 3600.0)
    out = _sink_dir(spark, "limited")
    SG.drain(limited, f"{out}/state", _batches(f"{out}/data"))
    return spark.read.parquet(f"{out}/data").select(F.col("key").cast("long").alias("user_id"), "t", "allowed")


@query("""
SELECT event_id, CASE WHEN value > 50 THEN 'client' ELSE 'server' END AS winner FROM events
""")
def sync_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, sf, "events").select("event_id", S.resolve_sync("last_write_wins", F.when(F.col("value") > 50, ts + F.expr("INTERVAL 1 SECOND")).otherwise(ts), ts).alias("winner"))
