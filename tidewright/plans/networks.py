"""Queries over a graph of services: cycles, dominators, topology, criticality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G
from ..session import load
from .registry import query

#: Suppliers as services: each is called by the one with half its key, some also by others; some calls are messages, some are weak.
CALLS = """n AS (SELECT DISTINCT s_suppkey AS node FROM supplier),
calls AS (SELECT src, dst, CASE WHEN (src + dst) % 6 = 0 THEN 'async_message' ELSE 'sync_call' END AS kind, ['weak', 'likely', 'proven'][(src * 7 + dst) % 5 // 2 + 1] AS band FROM (
  SELECT node // 2 AS src, node AS dst FROM n WHERE node > 1 UNION SELECT node // 3, node FROM n WHERE node % 4 = 0 UNION SELECT node, node - 5 FROM n WHERE node % 11 = 0 UNION SELECT node, node // 2 FROM n WHERE node % 7 = 0 UNION SELECT node, node // 4 FROM n WHERE node % 13 = 0)
  WHERE src <> dst AND src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n))"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    nodes = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).distinct()
    n = F.col("node")
    pairs = nodes.where("node > 1").select(F.floor(n / 2).cast("long").alias("src"), n.alias("dst"))
    pairs = pairs.unionAll(nodes.where("node % 4 = 0").select(F.floor(n / 3).cast("long"), n)).unionAll(nodes.where("node % 11 = 0").select(n, n - 5)).unionAll(nodes.where("node % 7 = 0").select(n, F.floor(n / 2).cast("long"))).unionAll(nodes.where("node % 13 = 0").select(n, F.floor(n / 4).cast("long"))).distinct()
    pairs = pairs.where("src <> dst").join(nodes.select(n.alias("src")), "src", "left_semi").join(nodes.select(n.alias("dst")), "dst", "left_semi")
    s, d = F.col("src"), F.col("dst")
    band = F.element_at(F.array(*map(F.lit, G.BANDS)), (F.floor((s * 7 + d) % 5 / 2) + 1).cast("int"))
    return pairs.select("src", "dst", F.when((s + d) % 6 == 0, "async_message").otherwise("sync_call").alias("kind"), band.alias("band"))


def services(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).distinct()


REACH = "r AS (SELECT src AS a, dst AS b FROM calls UNION SELECT r.a, c.dst FROM r JOIN calls c ON c.src = r.b)"


@query(f"""
WITH RECURSIVE {CALLS}, {REACH}, c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT list(node ORDER BY node) AS members FROM c GROUP BY component
""")
def service_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.cycle_members(services(spark, sf), calls(spark, sf))


@query(f"""
WITH RECURSIVE {CALLS}, {REACH}, c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
s AS (SELECT c.component, c.node, min(dst) AS next FROM c JOIN calls ON src = node JOIN c d ON d.node = dst AND d.component = c.component GROUP BY ALL),
w AS (SELECT component, node AS first, node, next, 0 AS place FROM s UNION ALL SELECT w.component, first, s.node, s.next, place + 1 FROM w JOIN s ON s.node = w.next WHERE s.node <> first AND place < (SELECT count(*) FROM s)),
ring AS (SELECT component, first FROM w WHERE next = first GROUP BY ALL HAVING count(*) > 0), low AS (SELECT component, min(first) AS first FROM ring GROUP BY component),
told AS (SELECT component, first, min(place) AS n FROM w JOIN low USING (component, first) WHERE next = first GROUP BY ALL)
SELECT component, CAST(place AS INTEGER) AS place, node FROM w JOIN told USING (component, first) WHERE place <= n UNION ALL SELECT component, CAST(n + 1 AS INTEGER), first FROM told
""")
def service_cycle_paths(spark: SparkSession, sf: str) -> DataFrame:
    """One closed way for each cycle of services, by smallest successors."""
    return G.cycle_paths(services(spark, sf), calls(spark, sf)).select("component", F.col("place").cast("int").alias("place"), "node")


AVOID = """x AS (SELECT d.node AS gone, 1 AS node FROM n d WHERE d.node <> 1 UNION SELECT gone, dst FROM x JOIN calls ON src = x.node AND dst <> gone),
reached AS (SELECT 1 AS node UNION SELECT dst FROM reached JOIN calls ON src = reached.node),
dom AS (SELECT v.node, d.node AS dominator FROM reached v, reached d WHERE d.node = v.node OR d.node = 1 OR NOT EXISTS (SELECT 1 FROM x WHERE x.gone = d.node AND x.node = v.node)),
depth AS (SELECT node, count(*) AS depth FROM dom GROUP BY node)"""


@query(f"""
WITH RECURSIVE {CALLS}, {AVOID}
SELECT d.node, CAST(d.depth AS INTEGER) AS depth, p.dominator AS parent FROM depth d LEFT JOIN (SELECT dom.node, dominator, e.depth FROM dom JOIN depth e ON e.node = dominator) p ON p.node = d.node AND p.depth = d.depth - 1
""")
def immediate_dominators(spark: SparkSession, sf: str) -> DataFrame:
    return G.dominator_tree(calls(spark, sf), services(spark, sf).where("node = 1")).select("node", F.col("depth").cast("int").alias("depth"), "parent")


@query(f"""
WITH RECURSIVE {CALLS.replace("calls AS", "every AS")}, calls AS (SELECT * FROM every WHERE band <> 'weak'), v AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls), {REACH},
hard AS (SELECT DISTINCT src, dst FROM calls WHERE kind = 'sync_call'), entry AS (SELECT node FROM v WHERE node NOT IN (SELECT dst FROM calls)),
x AS (SELECT v.node AS gone, entry.node FROM v, entry WHERE v.node <> entry.node UNION SELECT gone, dst FROM x JOIN hard ON src = x.node AND dst <> gone),
seen AS (SELECT node FROM entry UNION SELECT dst FROM seen JOIN hard ON src = seen.node),
below AS (SELECT g.node, count(*) AS dominates FROM seen g, seen s WHERE s.node <> g.node AND NOT EXISTS (SELECT 1 FROM x WHERE x.gone = g.node AND x.node = s.node) GROUP BY g.node),
lost AS (SELECT l_suppkey AS node, count(*) AS unnamed_callers FROM lineitem WHERE l_quantity = 50 GROUP BY 1),
t AS (SELECT v.node, (SELECT count(DISTINCT src) FROM calls WHERE dst = v.node) AS fan_in, (SELECT count(DISTINCT dst) FROM calls WHERE src = v.node) AS fan_out, v.node IN (SELECT a FROM r WHERE a = b) AS in_cycle, v.node IN (SELECT node FROM entry) AS is_entry,
  coalesce(unnamed_callers, 0) AS unnamed_callers, coalesce(dominates, 0) AS dominates FROM v LEFT JOIN below USING (node) LEFT JOIN lost USING (node))
SELECT *, dominates >= 3 AS single_point_of_failure, list_filter([CASE WHEN fan_in >= 3 THEN 'high_fan_in' END, CASE WHEN dominates >= 3 THEN 'dominates_many' END, CASE WHEN in_cycle THEN 'in_cycle' END, CASE WHEN unnamed_callers > 0 THEN 'unobserved_dependents' END], lambda q: q IS NOT NULL) AS criticality_inputs FROM t
""")
def service_topology(spark: SparkSession, sf: str) -> DataFrame:
    """All services with likely or proven calls; lines of fifty stand for spans whose caller was not seen."""
    missing = load(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("callee"))
    return G.topology(calls(spark, sf), missing, least="likely")
