"""Aggregations: percentile variants, reducers with stated empty values, scores over groups, histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import CREDIT, STATUS_RANK, lookup

MIN_FOR_P95 = 20
#: Reducers by name; of no rows they give 0.0.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "AVG": lambda c: F.coalesce(F.avg(c), F.lit(0.0)), "SUM": lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0)), "MIN": lambda c: F.coalesce(F.min(c).cast("double"), F.lit(0.0)),
    "MAX": lambda c: F.coalesce(F.max(c).cast("double"), F.lit(0.0)), "COUNT": lambda c: F.count(c).cast("double"), "P95": lambda c: F.coalesce(F.percentile(c, 0.95), F.lit(0.0)), "P99": lambda c: F.coalesce(F.percentile(c, 0.99), F.lit(0.0)),
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def latest(value: Column, at: Column) -> Column:
    return F.max_by(value, at)


Place = Callable[[Column], Column]


def nearest_rank(share: float, least: int = MIN_FOR_P95) -> Place:
    """Place ceil(share n); none below ``least`` values, where it would be the maximum."""
    return lambda n: F.when(n >= least, F.ceil(F.lit(share) * n))


def rounded_rank(p: float) -> Place:
    """Place round(p / 100 n), half to even."""
    return lambda n: F.bround(F.lit(p / 100.0) * n)


def truncated_rank(p: float) -> Place:
    """Place int(p / 100 n)."""
    return lambda n: F.floor(F.lit(p / 100.0) * n)


def spread_rank(p: float) -> Place:
    """Place round(p / 100 (n - 1)) + 1, half to even."""
    return lambda n: F.bround(F.lit(p / 100.0) * (n - 1)) + 1


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Place]) -> DataFrame:
    """By key the values at 1-based places of the sorted values, clamped to [1, n]; keys without values have no row.

    Equal values are counted first; the running counts of a key's distinct values go by a window, which
    spills, so no task holds a key's values in an array.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("_n").over(key.orderBy(value))).withColumn("_all", F.sum("_n").over(key))
    n = F.col("_all")
    return upto.groupBy(*keys).agg(*(F.min(F.when(place(n).isNotNull() & (F.col("_upto") >= F.least(F.greatest(place(n), F.lit(1)), n)), F.col(value))).alias(name) for name, place in places.items()))


def latency_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rounded places and the maximum; 0.0 of no values."""
    places = ranked_values(df, keys, value, {"p50": rounded_rank(50), "p95": rounded_rank(95), "p99": rounded_rank(99)})
    top = df.groupBy(*keys).agg(F.max(value).alias("max"))
    return top.join(places, list(keys), "left").select(*keys, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "max")))


def metric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    c = F.col(value)
    return df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("avg_value"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.percentile(c, 0.95).alias("p95"))


def worst_status(status: Column, maintenance: bool = False) -> Column:
    """The worst status by rank; of none it is unknown; maintenance overrides all."""
    return F.lit("maintenance") if maintenance else F.coalesce(F.min_by(status, lookup(STATUS_RANK, status)), F.lit("unknown"))


def component_health(status: Column, degraded: int, unhealthy: int) -> Column:
    critical, warning = F.count_if(status == "critical"), F.count_if(status == "warning")
    return F.when(F.count(F.lit(1)) == 0, "unknown").when(critical >= unhealthy, "unhealthy").when(critical + warning >= degraded, "degraded").otherwise("healthy")


def weighted_score(status: Column, weight: Column, empty: float | None) -> Column:
    """Credit (1, 1/2, 0) by weight, in percent; other statuses don't count."""
    credit = lookup(CREDIT, status)
    w = F.when(credit.isNotNull(), F.coalesce(weight, F.lit(1.0)))
    out = F.try_divide(F.sum(credit * w), F.sum(w)) * 100
    return out if empty is None else F.coalesce(out, F.lit(empty))


def vote_tally(vote: Column, invited: Column, quorum: float) -> tuple[Column, Column]:
    """(quorum met, outcome): a rejection beats a condition beats an approval; no outcome without quorum."""
    met = F.coalesce(F.try_divide(F.count(vote).cast("double"), F.max(invited)) >= quorum, F.lit(False))
    outcome = F.when(F.count_if(vote == "reject") > 0, "reject").when(F.count_if(vote == "conditional") > 0, "conditional").when(F.count_if(vote == "approve") > 0, "approve")
    return met, F.when(met, outcome)


def approval_chain(steps: DataFrame, chain: str, level: str, status: str) -> DataFrame:
    """(chain, status): the first level that is pending or rejected decides; a condition sticks; delegated steps don't count."""
    s = F.col(status)
    active = F.count_if(s != "delegated")
    by_level = steps.groupBy(chain, level).agg(
        F.when(active == 0, "pending").when(F.count_if(s == "rejected") > 0, "rejected").when(F.count_if(s.isin("approved", "conditional")) < active, "pending").when(F.count_if(s == "conditional") > 0, "conditional").otherwise("approved").alias("level_status")
    )
    open_level = F.col("level_status").isin("pending", "rejected")
    first = F.min_by(F.when(open_level, F.col("level_status")), F.when(open_level, F.col(level)))
    return by_level.groupBy(chain).agg(F.coalesce(first, F.when(F.count_if(F.col("level_status") == "conditional") > 0, "conditional").otherwise("approved")).alias("chain_status"))


def dense_histogram(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A row for each of the values, with zero where none was seen."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Each key's share of all rows; the total comes from the few grouped rows."""
    counts = df.groupBy(key).count()
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(key, F.when(total == 0, 0.0).otherwise(F.col("count") / total).alias("share"))


def histograms(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Histograms of several columns in one pass, NULL by its own name for each column."""
    filled = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(name)).alias(c) for c, name in columns.items()))
    sets = ", ".join(f"({c})" for c in columns)
    which = F.expr("CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns) + " END")
    names = [F.col(c) for c in columns]
    grouped = filled.groupingSets([[F.col(c)] for c in columns], *names).agg(F.count(F.lit(1)).alias("n"), which.alias("dimension")) if sets else filled
    return grouped.select("dimension", F.coalesce(*names).alias("bucket"), "n")


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(n)


def flaky(passed: Column, failed: Column) -> Column:
    return F.bool_or(passed) & F.bool_or(failed)


def macro_average(df: DataFrame, target: str, part: Column, empty: float = 100.0) -> DataFrame:
    """The mean of each target's percentage (not the percentage of all rows)."""
    each = df.groupBy(target).agg((F.avg(part.cast("double")) * 100).alias("ratio"))
    return each.agg(F.coalesce(F.avg("ratio"), F.lit(empty)).alias("macro_average"))


def hourly_rollup(df: DataFrame, key: str, at: str, parts: dict[str, Column]) -> DataFrame:
    """Counts by key and wall-clock hour, with conditional counts."""
    hour = F.date_trunc("hour", F.col(at)).alias("hour")
    return df.groupBy(key, hour).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(name) for name, c in parts.items()))


def digest(df: DataFrame, user: str, kind: str, parts: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """By user and kind: messages without repeats (first wins), at most ``most`` a user."""
    first = df.withColumn("r", F.row_number().over(Window.partitionBy(user, *parts).orderBy(*order))).where("r = 1")
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("r") <= most)
    return kept.groupBy(user, kind).agg(F.count(F.lit(1)).alias("n"))


def quota_check(states: DataFrame, key: str, amount: float) -> DataFrame:
    """By key: permitted or not, and the blocking hard quota that has least left (ties by resource)."""
    limited = F.col("limit_value") > 0
    blocked = limited & (F.col("consumed") + amount > F.col("limit_value")) & F.col("is_hard")
    left = F.greatest(F.lit(0.0), F.col("limit_value") - F.col("consumed"))
    tightest = F.min_by(F.when(blocked, F.col("resource")), F.when(blocked, F.struct(left, F.col("resource"))))
    return states.groupBy(key).agg((F.count_if(blocked) == 0).alias("permitted"), tightest.alias("blocking"))


def mode_of(value: Column) -> Column:
    return F.mode(value, True)


def distributions(df: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """(dimension, value, n): the counts of every dimension's values and the total (dimension NULL), in one pass by grouping sets."""
    named = df.select(*(c.cast("string").alias(name) for name, c in dimensions.items()))
    sets = [[F.col(name)] for name in dimensions] + [[]]
    marks = [F.grouping(F.col(name)).alias(f"_no_{name}") for name in dimensions]
    grouped = named.groupingSets(sets, *(F.col(name) for name in dimensions)).agg(*marks, F.count(F.lit(1)).alias("n"))
    dimension = F.coalesce(*(F.when(F.col(f"_no_{name}") == 0, F.lit(name)) for name in dimensions))
    value = F.coalesce(*(F.when(F.col(f"_no_{name}") == 0, F.col(name)) for name in dimensions))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")
