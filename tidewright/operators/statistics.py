"""Fits and correlations: least squares, Theil-Sen, intervals, rank correlation, lags, adjusted p-values."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_THEIL_SEN = 400
#: Two-sided Student quantiles by degrees of freedom, 1 to 30; above, a series expansion.
T_TABLE = {
    0.90: [6.314, 2.920, 2.353, 2.132, 2.015, 1.943, 1.895, 1.860, 1.833, 1.812, 1.796, 1.782, 1.771, 1.761, 1.753, 1.746, 1.740, 1.734, 1.729, 1.725, 1.721, 1.717, 1.714, 1.711, 1.708, 1.706, 1.703, 1.701, 1.699, 1.697],
    0.95: [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042],
    0.99: [63.657, 9.925, 5.841, 4.604, 4.032, 3.707, 3.499, 3.355, 3.250, 3.169, 3.106, 3.055, 3.012, 2.977, 2.947, 2.921, 2.898, 2.878, 2.861, 2.845, 2.831, 2.819, 2.807, 2.797, 2.787, 2.779, 2.771, 2.763, 2.756, 2.750],
}


def t_quantile(confidence: float, df: int) -> float:
    if df < 1:
        raise ValueError("degrees of freedom from 1")
    table = T_TABLE[confidence]
    if df <= len(table):
        return table[df - 1]
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)


def normal_quantile(p: float) -> float:
    """Only the central region (this library: 0.02425 to 0.97575) is answered."""
    if not 0.02425 <= p <= 0.97575:
        raise ValueError("p is outside the central region")
    return NormalDist().inv_cdf(p)


def ols_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, order: str | None = None) -> DataFrame:
    """By key: n, slope, intercept, r2, adjusted r2, residual deviation, slope's error and t, Durbin-Watson, class.

    A constant y has slope 0 and no r2; fewer than three points or no spread in x: no row is fitted (class NULL).
    """
    c = [F.col(k) for k in keys]
    fit = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*c).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.avg(x).alias("x_mean"))
    fit = fit.where("n >= 3 and sxx > 0")
    rows = df.join(fit, list(keys))
    w = Window.partitionBy(*keys).orderBy(order or x)
    resid = rows.withColumn("e", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")).withColumn("d", F.col("e") - F.lag("e").over(w))
    extra = resid.groupBy(*c).agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.sum(F.col("d") * F.col("d")).alias("sdd"))
    joined = fit.join(extra, list(keys))
    constant = F.col("syy") == 0
    s = F.sqrt(F.col("sse") / (F.col("n") - 2))
    se = s / F.sqrt("sxx")
    return joined.select(
        *c, "n", F.when(constant, 0.0).otherwise(F.col("slope")).alias("slope"), "intercept", F.when(~constant, F.col("r2")).alias("r2"), F.when(~constant, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adjusted_r2"),
        F.when(constant, 0.0).otherwise(s).alias("residual_std"), F.when(~constant, se).alias("se_slope"), F.when(~constant & (se > 0), F.col("slope") / se).alias("t_slope"), F.when(~constant & (F.col("sse") > 0), F.col("sdd") / F.col("sse")).alias("durbin_watson"), "x_mean", "sxx", F.when(constant, "constant").otherwise("linear").alias("fit_class"),
    )


def prediction_band(fit: DataFrame, x: float, confidence: float) -> DataFrame:
    """A Student band around the prediction at x; of zero width for a constant series."""
    quantile = F.lit(0.0)
    table = F.array(*(F.lit(v) for v in T_TABLE[confidence]))
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    dof = F.col("n") - 2
    beyond = F.lit(z) + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof * dof)
    quantile = F.when(dof <= len(T_TABLE[confidence]), F.element_at(table, dof.cast("int"))).otherwise(beyond)
    half = quantile * F.col("residual_std") * F.sqrt(1 + 1.0 / F.col("n") + F.pow(F.lit(x) - F.col("x_mean"), 2) / F.col("sxx"))
    mid = F.col("intercept") + F.col("slope") * x
    return fit.withColumn("predicted", mid).withColumn("lower", mid - half).withColumn("upper", mid + half)


def slope_interval(fit: DataFrame, confidence: float) -> DataFrame:
    table = F.array(*(F.lit(v) for v in T_TABLE[confidence]))
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    t = F.when(F.col("n") - 2 <= 30, F.element_at(table, (F.col("n") - 2).cast("int"))).otherwise(F.lit(z))
    return fit.withColumn("slope_lower", F.col("slope") - t * F.col("se_slope")).withColumn("slope_upper", F.col("slope") + t * F.col("se_slope"))


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """By key the median of pairwise slopes, and the median of y - slope x; series of up to 400 points only.

    The bound is the operator's own: longer series have no row.
    """
    sized = df.join(df.groupBy(*keys).count().where(F.col("count") <= MAX_THEIL_SEN), list(keys)).drop("count")
    a, b = sized.alias("a"), sized.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.join(b, [*same, F.col(f"a.{x}") < F.col(f"b.{x}")]).select(*(F.col(f"a.{k}").alias(k) for k in keys), ((F.col(f"b.{y}") - F.col(f"a.{y}")) / (F.col(f"b.{x}") - F.col(f"a.{x}"))).alias("m"))
    slopes = pairs.groupBy(*keys).agg(F.median("m").alias("slope"))
    return sized.join(slopes, list(keys)).groupBy(*keys, "slope").agg(F.median(F.col(y) - F.col("slope") * F.col(x)).alias("intercept"))


MIN_FOR_RESIDUALS = 20


def residual_interval(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str, at: float, confidence: float) -> DataFrame:
    """Around a Theil-Sen prediction at ``at`` the band of the residuals' quantiles; keys of under 20 points (this library's bound) have none."""
    rows = df.join(fit, list(keys)).withColumn("_e", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    band = rows.groupBy(*keys, "slope", "intercept").agg(F.count(F.lit(1)).alias("n"), F.percentile("_e", low).alias("_l"), F.percentile("_e", high).alias("_h")).where(F.col("n") >= MIN_FOR_RESIDUALS)
    mid = F.col("slope") * at + F.col("intercept")
    return band.select(*keys, "n", mid.alias("predicted"), (mid + F.col("_l")).alias("lower"), (mid + F.col("_h")).alias("upper"))


def exhaustion(fit: DataFrame, now: float, ceiling: float) -> DataFrame:
    """Buckets from ``now`` until the fitted line reaches a ceiling: 0 if it is there, NULL if it never will be; with a refusal where nothing was fitted well."""
    value = F.col("intercept") + F.col("slope") * now
    left = F.when(value >= ceiling, 0.0).when(F.col("slope") > 0, (ceiling - value) / F.col("slope"))
    return fit.withColumn("current_value", value).withColumn("buckets_left", left).withColumn("refusal", F.when(F.col("fit_class") == "constant", "constant_series").when(F.col("slope") <= 0, "not_growing"))


def expected_false_positives(comparisons: Column, level: float = 0.01) -> Column:
    """How many of so many comparisons look significant by chance."""
    return comparisons * level


def variance_inflation(rho: Column, least: float = 0.2, cap: float = 0.9) -> Column:
    """sqrt((1 + r) / (1 - r)), r capped at 0.9; 1 below 0.2 (this library's bound) or unmeasured."""
    r = F.least(rho, F.lit(cap))
    return F.when(rho.isNull() | (rho < least), 1.0).otherwise(F.sqrt((1 + r) / (1 - r)))


def influential(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Points by Cook's distance above 4 / n, most influential first within a key; none without residual spread."""
    rows = df.join(fit.where("residual_std > 0"), list(keys))
    e = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    h = 1.0 / F.col("n") + F.pow(F.col(x) - F.col("x_mean"), 2) / F.col("sxx")
    cook = e * e / (2 * F.pow("residual_std", 2)) * h / F.pow(1 - h, 2)
    return rows.withColumn("influence", cook).where(F.col("influence") > 4.0 / F.col("n"))


def median_successive_difference(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The median of absolute first differences; NULL for one point."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(*keys).agg(F.median("_d").alias("masd"))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation over the pairs; NULL without spread (the built-in aggregate divides by it)."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with ties averaged; NULL without spread or below two pairs."""

    def averaged(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0

    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_ra", averaged(a)).withColumn("_rb", averaged(b))
    spread = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    return ranked.groupBy(*keys).agg(F.when(spread, correlation("_ra", "_rb")).alias("rho"), F.count(F.lit(1)).alias("n"))


def rho_critical(n: int) -> float:
    """What a rank correlation must exceed: 1 for n = 3, falling with n, never below 0.5 (2.576 / sqrt(n - 1), ours)."""
    return 1.0 if n <= 3 else max(0.5, min(1.0, 2.576 / math.sqrt(n - 1)))


def lag_one(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Correlation of each value with the one before; NULL below three points."""
    w = Window.partitionBy(*keys).orderBy(order)
    pairs = df.withColumn("_p", F.lag(value).over(w))
    spread = (F.count("_p") >= 2) & (F.min("_p") < F.max("_p"))
    return pairs.groupBy(*keys).agg(F.when(spread, correlation(value, "_p")).alias("rho1"))


def lagged_correlation(df: DataFrame, series: str, bucket: str, value: str, anchor: object, lags: Sequence[int]) -> DataFrame:
    """For each other series its best lag against one anchor series, over buckets both observed (rank correlation).

    The anchor is one series of a bounded number of buckets; every other series is a key of its own.
    """
    a = df.where((F.col(series) == F.lit(anchor)) & F.col(value).isNotNull()).select(F.col(bucket).alias("_b"), F.col(value).alias("_a"))
    moved = df.where((F.col(series) != F.lit(anchor)) & F.col(value).isNotNull()).withColumn("lag", F.explode(F.array(*(F.lit(int(k)) for k in lags)))).withColumn("_b", F.col(bucket) - F.col("lag"))
    rho = spearman(moved.join(a, "_b"), [series, "lag"], value, "_a").where("rho is not null and n >= 5")
    return rho.groupBy(series).agg(F.max_by("lag", F.struct(F.abs("rho"), -F.abs("lag"), -F.col("lag"))).alias("best_lag"), F.max_by("rho", F.struct(F.abs("rho"), -F.abs("lag"), -F.col("lag"))).alias("rho"))


def holm(df: DataFrame, keys: Sequence[str], p: str, ident: str) -> DataFrame:
    """Holm's adjusted p-values within a key; unmeasured rows pass through."""
    measured = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*keys).orderBy(p, ident)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = measured.withColumn("_s", F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s").unionByName(df.where(F.col(p).isNull()).withColumn("adjusted", F.lit(None).cast("double")))


def platform_gaps(rows: DataFrame, bucket: str, series: str, observed: Column) -> DataFrame:
    """Buckets in which more than half of all series are silent; ``observed`` says which rows count as heard.

    Every series in each bucket that was heard is counted once, against the number of series in all: no bucket meets
    every series.
    """
    many = rows.select(series).distinct().count()
    heard = rows.groupBy(bucket).agg(F.count_distinct(F.when(observed, F.col(series))).alias("_heard"))
    return heard.withColumn("silent", 1 - F.col("_heard") / F.lit(max(many, 1))).where("silent > 0.5").select(bucket, "silent")


def specificity(inside: Column, baseline: Column) -> Column:
    return 1 - F.try_divide(inside.cast("double"), baseline.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; NULL if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))
