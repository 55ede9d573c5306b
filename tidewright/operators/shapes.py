"""The shape of a series (spike, step, drift or steady), and findings of several detectors merged.

A series is one window over its key, in order; sums run along it, so a point's best split costs a few additions
and nothing is collected.  Series whose points number tens of millions should be bucketed first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Grades of a finding, from the least on.
SEVERITIES = ("info", "warning", "critical")


def change_points(df: DataFrame, keys: Sequence[str], order: str | Column, value: str) -> DataFrame:
    """``df`` with place, n, the squared spread of the whole series (``total``) and what is left of it (``rest``) if the series is split before the row; NULL values are skipped."""
    whole, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(F.col(value).isNotNull()).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("_x", F.col(value) - F.avg(value).over(whole))
    rows = rows.withColumn("place", F.count(F.lit(1)).over(along)).withColumn("_s", F.sum("_x").over(along)).withColumn("total", F.sum(F.col("_x") * F.col("_x")).over(whole))
    # centred values add up to 0, so both sides' means follow from the sum of one
    gain = F.col("_s") * F.col("_s") / F.col("place") + F.col("_s") * F.col("_s") / (F.col("n") - F.col("place"))
    return rows.withColumn("rest", F.when(F.col("place") > 0, F.col("total") - gain)).drop("_s")


def shapes(df: DataFrame, keys: Sequence[str], order: str, value: str, least: float = 0.5, points: int = 5) -> DataFrame:
    """(keys, n, shape, share, at): what explains the largest share of a series' spread, if that is ``least`` or more.

    spike: its farthest point alone (``at``); step: one split into two levels (``at`` is the first row of the second); drift: a straight
    line; otherwise steady.  Ties go to spike, then step.  With fewer than ``points`` values, or without spread, the shape is NULL or steady.
    """
    rows = change_points(df, keys, F.col(order), value)
    n, total = F.max("n"), F.max("total")
    x, i = F.col("_x"), F.col("place") - (F.col("n") - 1) / 2
    found = rows.groupBy(*keys).agg(
        n.alias("n"), total.alias("total"),
        F.max(F.struct((x * x).alias("far"), F.col(order).alias("at"))).alias("peak"),
        F.min_by(F.struct("rest", F.col(order).alias("at")), F.struct(F.coalesce("rest", F.lit(float("inf"))), F.col(order))).alias("split"),
        F.sum(x * i).alias("xi"), F.sum(i * i).alias("ii"),
    )
    # without its farthest point the mean moves too: n / (n - 1) of its square goes
    share = lambda c: F.when(F.col("total") > 0, F.round(c / F.col("total"), 9)).otherwise(0.0)
    found = found.withColumn("spike", share(F.col("peak.far") * F.col("n") / (F.col("n") - 1))).withColumn("step", share(F.col("total") - F.col("split.rest"))).withColumn("drift", share(F.col("xi") * F.col("xi") / F.col("ii")))
    best = F.greatest("spike", "step", "drift")
    told = F.when(best < least, "steady").when(F.col("spike") == best, "spike").when(F.col("step") == best, "step").otherwise("drift")
    found = found.withColumn("shape", F.when(F.col("n") >= points, told)).withColumn("share", F.when(F.col("n") >= points, best))
    return found.select(*keys, "n", "shape", "share", F.when(F.col("shape") == "spike", F.col("peak.at")).when(F.col("shape") == "step", F.col("split.at")).alias("at"))


def merged_outcomes(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, severity, methods, deviation, samples): one outcome a key from findings (method, severity, deviation, samples) of several detectors.

    The highest severity counts, the methods that agree on any severity are listed, the deviation is the one farthest from 0.
    """
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy(*keys).agg(
        F.max_by("severity", order).alias("severity"), F.sort_array(F.collect_set("method")).alias("methods"),
        F.max_by("deviation", F.struct(F.abs("deviation"), F.col("deviation"))).alias("deviation"), F.max("samples").alias("samples"),
    )
