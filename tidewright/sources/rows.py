"""Row files: CSV and JSON by Spark's readers, reports in several formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and text values only; a byte order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The named fields in their order; other columns are left out."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Files that hold an array of objects; any other top level is an error."""
    heads = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("v")).where(~F.startswith("v", F.lit("[")))
    if not heads.isEmpty():
        raise ValueError("a JSON source must be an array of objects")
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One text column with each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def html_cell(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_report(df: DataFrame, path: str, kind: str) -> None:
    """csv, json, xml, markdown or html; the text forms have a row a line and a header file part."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    if kind == "csv":
        return write_csv(df, path, df.columns)
    if kind == "json":
        return write_json(df, path)
    if kind == "xml":
        return df.write.mode("overwrite").format("xml").option("rowTag", "row").option("rootTag", "report").save(path)
    if kind == "markdown":
        lines = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(c, F.lit("|"), F.lit("\\|")) for c in shown)), F.lit(" |"))
        head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    elif kind == "html":
        lines = F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *map(html_cell, shown)), F.lit("</td></tr>"))
        head = "<tr><th>" + "</th><th>".join(df.columns) + "</th></tr>"
    else:
        raise ValueError(f"unknown report format {kind}")
    spark = df.sparkSession
    spark.createDataFrame([(head,)], "value string").coalesce(1).unionAll(df.select(lines.alias("value"))).write.mode("overwrite").text(path)
