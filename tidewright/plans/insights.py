"""Queries over vectors, attribute paths, distributions, chunks, shapes of series and critical services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import payloads as P, scoring as S, text as T
from ..operators import aggregates as A, graph as G, series_pairs as SP, shapes as SH, vectors as V
from ..session import cut, load, spread
from .networks import CALLS, calls, services
from .registry import query
from .scalars import CHUNKS

# --- vectors


def _queries(vectors: DataFrame, ident: str) -> DataFrame:
    return vectors.where(F.col(ident) % 100 == 0).select(F.col(ident).alias("query_id"), F.col("embedding").alias("query"))


@query("""
WITH v AS (SELECT vec_id AS id, label, embedding AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings),
w AS (SELECT v.* FROM v JOIN documents d ON d.doc_id = v.id WHERE label <= 6),
p AS (SELECT q.id AS query_id, w.id AS chunk_id, round(CASE WHEN q.norm * w.norm > 0 THEN list_dot_product(CAST(q.e AS DOUBLE[]), CAST(w.e AS DOUBLE[])) / (q.norm * w.norm) ELSE 0 END, 9) AS s FROM v q, w WHERE q.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, CAST(chunk_id AS VARCHAR)) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, d.doc_id AS document_id, d.source AS title, sha256(coalesce(d.text, '')) AS content_hash, round(1 - greatest(0, s), 6) AS distance FROM k JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5
""")
def similar_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as chunks of the document with their number; all cells are asked, so the answer is exact."""
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    docs = load(spark, sf, "documents")
    centroids = V.fit_cells(v, 16, ident="chunk_id")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    owners = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    found = V.search_similar(V.with_cells(v, centroids, "embedding"), centroids, _queries(v, "chunk_id"), chunks, owners, 5, 16, F.col("label") <= 6)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "document_id", "title", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), F.round("distance", 6).alias("distance"))


@query("""SELECT count(*) AS queries, true AS at_least_nine_tenths FROM embeddings WHERE vec_id % 100 = 0""")
def cell_search_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of ten neighbours from twelve of sixteen cells (these vectors lie in no clusters), against the exact search over all rows."""
    v = load(spark, sf, "embeddings").select("vec_id", "embedding")
    centroids, queries = V.fit_cells(v, 16), _queries(v, "vec_id")
    found = cut(V.search_cells(V.with_cells(v, centroids, "embedding"), centroids, queries, 10, 12))
    share = V.recall(found, cut(V.search_exact(v, queries, 10)))
    return queries.agg(F.count(F.lit(1)).alias("queries")).withColumn("at_least_nine_tenths", F.lit(share >= 0.9))


# --- attribute paths

PATHS = ("user.id", "user.tags.0", "user.tags.1", "user.tags.2", "note", "user.0", "value.x", "7")


@query(f"""
WITH d AS (SELECT event_id, '{{"user":{{"id":' || user_id || ',"tags":["' || event_type || '",null]}},"7":' || event_id || ',"value":[' || user_id || ']' || CASE WHEN user_id % 3 = 0 THEN ',"note":null' WHEN user_id % 3 = 1 THEN ',"note":"n"' ELSE '' END || '}}' AS doc FROM events),
p AS (SELECT unnest({list(PATHS)!r}) AS path, unnest(['$.user.id', '$.user.tags[0]', '$.user.tags[1]', '$.user.tags[2]', '$.note', '$.user."0"', '$.value.x', '$."7"']) AS loc)
SELECT event_id, path, NOT json_exists(doc, loc) AS missing, json_exists(doc, loc) AND json_type(doc, loc) = 'NULL' AS is_null, json_extract_string(doc, loc) AS value FROM d, p
""")
def attribute_paths(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    note = F.when(u % 3 == 0, ',"note":null').when(u % 3 == 1, ',"note":"n"').otherwise("")
    text = F.concat(F.lit('{"user":{"id":'), u, F.lit(',"tags":["'), F.col("event_type"), F.lit('",null]},"7":'), F.col("event_id"), F.lit(',"value":['), u, F.lit("]"), note, F.lit("}"))
    docs = load(spark, sf, "events").select("event_id", F.parse_json(text).alias("doc"))
    found = [F.struct(F.lit(path).alias("path"), P.resolved(F.col("doc"), path).alias("at")) for path in PATHS]
    # a VARIANT can't be exploded in an array with other types, so each path's answer is made plain first
    plain = [F.struct(x["path"].alias("path"), P.is_missing(x["at"]).alias("missing"), F.coalesce(F.is_variant_null(x["at"]), F.lit(False)).alias("is_null"), F.try_variant_get(x["at"], "$", "string").alias("value")) for x in found]
    return docs.select("event_id", F.explode(F.array(*plain)).alias("x")).select("event_id", "x.*")


# --- distributions


@query("""
WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN r >= 75 THEN 'critical' WHEN r >= 50 THEN 'high' WHEN r >= 25 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN o_orderdate >= m - INTERVAL 30 DAY THEN 'last_30_days' ELSE 'before' END AS growth
  FROM (SELECT *, o_totalprice / 5000 AS r, max(o_orderdate) OVER () AS m FROM orders))
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'risk', risk, count(*) FROM o GROUP BY 2
UNION ALL SELECT 'growth', growth, count(*) FROM o GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM o
""")
def asset_distributions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as assets: status, priority, risk and growth over the last thirty days in one pass."""
    orders = load(spark, sf, "orders")
    latest = orders.agg(F.max("o_orderdate")).first()[0]
    growth = F.when(F.col("o_orderdate") >= F.lit(latest) - F.expr("INTERVAL 30 DAYS"), "last_30_days").otherwise("before")
    return A.distributions(orders, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "risk": S.risk_bucket(F.col("o_totalprice") / 5000), "growth": growth})


# --- chunks as a table function


@query(CHUNKS)
def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    rows = docs.lateralJoin(T.ChunkText(F.col("text").outer(), F.lit(1000), F.lit(100)))
    return rows.select("doc_id", "sequence", "start_at", "end_at", F.sha2("content", 256).alias("content_hash"))


# --- shapes of series and merged findings


@query("""
WITH e AS (SELECT user_id, event_id AS o, value - avg(value) OVER (PARTITION BY user_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM e),
g AS (SELECT user_id, max(n) AS n, sum(x * x) AS total, max(x * x) AS far, arg_max(o, (x * x, o)) AS far_at, max(c * c / p + c * c / (n - p)) FILTER (p > 0) AS gain, sum(x * (p - (n - 1) / 2)) AS xi, sum((p - (n - 1) / 2) * (p - (n - 1) / 2)) AS ii FROM s GROUP BY 1),
h AS (SELECT g.*, round(far * n / (n - 1) / total, 9) AS spike, round(gain / total, 9) AS step, round(xi * xi / ii / total, 9) AS drift FROM g WHERE total > 0 AND n >= 5)
SELECT g.user_id, g.n, CASE WHEN g.n >= 5 THEN coalesce(CASE WHEN greatest(spike, step, drift) < 0.1 THEN 'steady' WHEN spike >= greatest(step, drift) THEN 'spike' WHEN step >= drift THEN 'step' ELSE 'drift' END, 'steady') END AS shape,
  round(CASE WHEN g.n >= 5 THEN coalesce(greatest(spike, step, drift), 0) END, 6) AS share FROM g LEFT JOIN h USING (user_id)
""")
def series_shapes(spark: SparkSession, sf: str) -> DataFrame:
    found = SH.shapes(load(spark, sf, "events"), ["user_id"], "event_id", "value", least=0.1)
    return found.select("user_id", "n", "shape", F.round("share", 6).alias("share"))


@query("""
WITH f AS (SELECT user_id, event_type AS method, CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'info' END AS severity, round(value - 50, 6) AS deviation, event_id % 90 AS samples FROM events)
SELECT user_id, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, list(DISTINCT method ORDER BY method) AS methods, arg_max(deviation, (abs(deviation), deviation)) AS deviation, max(samples) AS samples FROM f GROUP BY 1
""")
def merged_findings(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    rows = load(spark, sf, "events").select("user_id", F.col("event_type").alias("method"), F.when(v > 80, "critical").when(v > 40, "warning").otherwise("info").alias("severity"), F.round(v - 50, 6).alias("deviation"), (F.col("event_id") % 90).alias("samples"))
    return SH.merged_outcomes(rows, ["user_id"])


# --- critical services

ROUNDS = ",".join(f"""
p{k + 1} AS MATERIALIZED (SELECT p.node, 0.15 + 0.85 * (coalesce(g.given, 0) + CASE WHEN p.node IN (SELECT src FROM e) THEN 0 ELSE p.score END) AS score FROM p{k} p LEFT JOIN (
  SELECT dst AS node, sum(score / ways) AS given FROM e JOIN w USING (src) JOIN p{k} q ON q.node = e.src GROUP BY dst) g USING (node))""" for k in range(20))  # fmt: skip
RANKED = f"""WITH {CALLS}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM calls), w AS (SELECT src, count(*) AS ways FROM e GROUP BY src), p0 AS (SELECT node, 1.0::DOUBLE AS score FROM n),{ROUNDS},
scored AS (SELECT node, score * CASE WHEN node % 10 = 0 THEN 3 ELSE 1 END AS score FROM p20)"""


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    return services(spark, sf).where("node % 10 = 0").select("node", F.lit(3.0).alias("weight"))


@query(f"{RANKED} SELECT node, round(score, 6) AS score FROM scored")
def service_criticality(spark: SparkSession, sf: str) -> DataFrame:
    return G.criticality(services(spark, sf), calls(spark, sf), _declared(spark, sf)).select("node", F.round("score", 6).alias("score"))


@query(f"""
{RANKED}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
d AS (SELECT n.node, (SELECT count(*) FROM e WHERE src = n.node) + (SELECT count(*) FROM e WHERE dst = n.node) AS degree FROM n),
low AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT node, node AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node) SELECT node, min(c) AS c FROM r GROUP BY node)),
best AS (SELECT list(node ORDER BY score DESC, node) AS critical_assets FROM (SELECT node, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, node LIMIT 10))
SELECT count(*) AS node_count, CAST(sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS orphan_count, round(avg(degree), 4) AS average_degree, max(degree) AS max_degree, (SELECT count(*) FROM e) AS relationship_count,
  (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)) AS density, (SELECT count(DISTINCT c) FROM low) AS components, (SELECT critical_assets FROM best) AS critical_assets FROM d
""")
def service_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_statistics(services(spark, sf), calls(spark, sf), _declared(spark, sf))


# --- pairs of series


@query("""
WITH c AS (SELECT user_id AS s, CAST(floor(epoch(ts) / 172800) AS BIGINT) AS b, avg(value) AS v FROM events GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY s ORDER BY b) AS p FROM c),
auto AS (SELECT s, coalesce(CASE WHEN count(p) >= 2 AND min(p) < max(p) THEN corr(v, p) FILTER (p IS NOT NULL) END > 0.5, false) AS auto FROM l GROUP BY s),
x AS (SELECT s, b, v AS y, false AS d FROM l UNION ALL SELECT s, b, v - p, true FROM l WHERE p IS NOT NULL), g AS (SELECT unnest([-2, -1, 0, 1, 2]) AS lag),
m AS (SELECT a.s AS first, z.s AS second, lag, a.d AS differenced, a.y AS ya, z.y AS yz FROM x a JOIN x z ON a.s < z.s AND a.d = z.d JOIN auto fa ON fa.s = a.s JOIN auto fz ON fz.s = z.s, g WHERE z.b = a.b + lag AND a.d = (fa.auto OR fz.auto)),
r AS (SELECT *, rank() OVER (PARTITION BY first, second, lag ORDER BY ya) + (count(*) OVER (PARTITION BY first, second, lag, ya) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY first, second, lag ORDER BY yz) + (count(*) OVER (PARTITION BY first, second, lag, yz) - 1) / 2.0 AS rz FROM m),
k AS (SELECT first, second, lag, differenced, round(corr(ra, rz), 9) AS rho, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 5 AND min(ra) < max(ra) AND min(rz) < max(rz)),
best AS (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY abs(rho) DESC, abs(lag), lag) AS place FROM k)
SELECT first, second, CAST(lag AS INTEGER) AS lag, round(rho, 6) AS rho, n, differenced FROM best WHERE place = 1 AND abs(rho) >= round(greatest(0.5, least(1, 2.576 / sqrt(n - 1))), 9)
""")
def series_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose mean values move together, over two-day buckets."""
    e = load(spark, sf, "events").withColumn("b", F.floor(S.seconds(F.col("ts")) / 172800).cast("long"))
    # rounded by arithmetic, as SQL does: round() goes through decimals, which takes longer than all else that the JVM does for a pair
    rho = F.signum("rho") * F.floor(F.abs("rho") * 1_000_000 + 0.5) / 1_000_000
    return SP.correlated_pairs(e, "user_id", "b", "value", [-2, -1, 0, 1, 2]).withColumn("rho", rho)
