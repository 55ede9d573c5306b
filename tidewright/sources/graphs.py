"""Graph sinks: CSV with both kinds of record, JSON with counts, GraphML, MERGE statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, then edges, with a ``record_type``; columns of the other kind are empty."""
    both = nodes.select(F.lit("node").alias("record_type"), "*").unionByName(edges.select(F.lit("edge").alias("record_type"), "*"), allowMissingColumns=True)
    both.write.mode("overwrite").option("header", True).csv(path)


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line for the counts, one for each node and one for each edge: no row holds the whole graph."""
    kinds = nodes.select(F.lit(True).alias("is_node")).unionAll(edges.select(F.lit(False)))
    counts = kinds.agg(F.count_if("is_node").alias("node_count"), F.count_if(~F.col("is_node")).alias("edge_count"))
    lines = [counts.select(F.to_json(F.struct("node_count", "edge_count")).alias("value")), nodes.select(F.to_json(F.struct(F.struct("*").alias("node"))).alias("value")), edges.select(F.to_json(F.struct(F.struct("*").alias("edge"))).alias("value"))]
    return lines[0].unionAll(lines[1]).unionAll(lines[2])


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): the elements of a GraphML file; part 0 opens it and part 3 closes it."""
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_text(F.col("node").cast("string")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_text(F.col("src").cast("string")), F.lit('" target="'), xml_text(F.col("dst").cast("string")), F.lit('"/>')).alias("value"))
    return frame.unionAll(n).unionAll(e)


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): a MERGE statement for each node, then for each edge; quotes are escaped."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))

    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (:Node {key: "), quoted("node"), F.lit("});")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a:Node {key: "), quoted("src"), F.lit("}), (b:Node {key: "), quoted("dst"), F.lit("}) MERGE (a)-[:LINK]->(b);")).alias("value"))
    return n.unionAll(e)
