"""Time series: anchored and gridded buckets, coverage, retention, objectives, anomalies, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scoring import seconds
from .aggregates import REDUCERS, nearest_rank, ranked_values


def downsample(df: DataFrame, keys: Sequence[str], at: str, value: str, width: int, function: str) -> DataFrame:
    """Buckets of ``width`` seconds from each series' first point; empty ones are left out."""
    first = df.groupBy(*keys).agg(F.min(at).alias("t0"))
    bucket = F.floor((seconds(F.col(at)) - seconds(F.col("t0"))) / width).cast("long")
    return df.join(first, list(keys)).withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(REDUCERS[function](F.col(value)).alias("value"), F.count(F.lit(1)).alias("n"))


def grid(df: DataFrame, keys: Sequence[str], at: str, value: str, width: int, origin: float = 0.0, cadence: float | None = None, excluded: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """A fixed grid of ``width`` seconds from ``origin`` (seconds since 1970), each series' empty buckets included.

    Coverage is against the samples a cadence leads to expect; a bucket that overlaps an excluded
    half-open window is marked.
    """
    index = F.floor((seconds(F.col(at)) - F.lit(origin)) / width).cast("long")
    dealt = df.withColumn("bucket", index)
    full = dealt.groupBy(*keys, "bucket").agg(F.count(value).alias("samples"), F.max(value).alias("peak"), F.avg(value).alias("mean"), F.min(value).alias("minimum"))
    full = full.join(ranked_values(dealt, [*keys, "bucket"], value, {"p95": nearest_rank(0.95)}), [*keys, "bucket"], "left")
    # the span comes from the buckets, which are far fewer than the samples
    span = full.groupBy(*keys).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    every = span.select(*keys, F.explode(F.sequence("low", "high")).alias("bucket"))
    expected = None if not cadence else max(1, round(width / cadence))
    start = F.col("bucket") * width + F.lit(origin)
    inside = F.lit(False)
    for a, b in excluded:
        inside = inside | ((start < b) & (F.lit(a) < start + width))
    out = every.join(full, [*keys, "bucket"], "left").withColumn("samples", F.coalesce("samples", F.lit(0))).withColumn("excluded", inside)
    return out.withColumn("coverage", F.lit(None).cast("double") if expected is None else F.least(F.lit(1.0), F.col("samples") / float(expected)))


def coverage(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of a grid: measured and excluded buckets, and the longest run of unmeasured ones (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    missing = points.withColumn("measured", (F.col("samples") > 0) & ~F.col("excluded")).withColumn("island", F.sum(F.col("measured").cast("int")).over(w))
    runs = missing.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.count_if("measured").alias("m"), F.count_if("excluded").alias("x"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("m").alias("measured"), F.sum("x").alias("excluded"), F.max(F.col("n") - F.col("m")).alias("largest_gap")).withColumn("ratio", F.col("measured") / F.col("total"))


def align(moment: Column, width: int, epoch: float = 0.0) -> Column:
    """Seconds since 1970 of the grid line at or before a moment."""
    return F.floor((seconds(moment) - epoch) / width) * width + epoch


def retention_days(metric: DataFrame, policies: DataFrame, kind: str, default: int = 90) -> DataFrame:
    """Days by metric kind: the kind's own policy, else the policy without a kind, else ``default``."""
    active = policies.where("is_active")
    own = active.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.max("retention_days").alias("own"))
    other = active.where(F.col(kind).isNull()).agg(F.max("retention_days").alias("other")).first()["other"]
    return metric.join(own, kind, "left").withColumn("days", F.coalesce("own", F.lit(other).cast("int"), F.lit(default))).drop("own")


def archive_action(archived_at: Column, tier: Column, legal_hold: Column, locked_until: Column, now: Column, archive_after: int, retain: int) -> Column:
    """delete, veto:legal_hold, veto:retention_locked, tier or keep."""
    age = seconds(now) - seconds(archived_at)
    deletion = F.when(legal_hold, "veto:legal_hold").when(F.coalesce(locked_until > now, F.lit(False)), "veto:retention_locked").otherwise("delete")
    return F.when(age >= retain * 86400, deletion).when((age >= archive_after * 86400) & (tier == "hot"), "tier").otherwise("keep")


def tiered_retention(now: float, raw_days: int, coarse_days: int, raw_watermark: float | None, coarse_watermark: float | None, interval: int, epoch: float = 0.0) -> dict[str, float | None]:
    """Cut-offs in seconds: what to downsample up to, and what to delete, never past the watermark of what has been downsampled."""

    def down(t: float) -> float:
        return (t - epoch) // interval * interval + epoch

    raw_cut, coarse_cut = down(now - raw_days * 86400), down(now - coarse_days * 86400)
    return {"downsample_until": raw_cut, "delete_raw_before": None if raw_watermark is None else min(raw_cut, down(raw_watermark)), "delete_coarse_before": None if coarse_watermark is None else min(coarse_cut, down(coarse_watermark))}


def objective_report(df: DataFrame, key: str, good: Column, target: float, at: str, now: Column, fast: int, slow: int) -> DataFrame:
    """Ratio indicator, error budget left, and burn over a fast and a slow trailing window, in one pass."""
    age = seconds(now) - seconds(F.col(at))
    allowed = 1 - target

    def burn(span: int) -> Column:
        n, bad = F.count_if(age < span), F.count_if((age < span) & ~good)
        return F.coalesce(F.try_divide(bad.cast("double"), n.cast("double")), F.lit(0.0)) / allowed

    total = F.count(F.lit(1))
    ratio = F.coalesce(F.try_divide(F.count_if(good).cast("double"), total.cast("double")), F.lit(1.0))
    return df.groupBy(key).agg(total.alias("total"), F.count_if(good).alias("good"), ratio.alias("ratio"), (1 - (1 - ratio) / allowed).alias("budget_left"), burn(fast).alias("burn_fast"), burn(slow).alias("burn_slow"))


def robust_outliers(df: DataFrame, keys: Sequence[str], value: str, threshold: float = 3.5, least: int = 10) -> DataFrame:
    """Modified z-score 0.6745 (x - median) / MAD; series with few points or no spread have none.

    The threshold and the least number of points are this library's choice.
    """
    middle = df.groupBy(*keys).agg(F.median(value).alias("middle"), F.count(value).alias("n"))
    off = df.join(middle.where(F.col("n") >= least), list(keys)).withColumn("off", F.abs(F.col(value) - F.col("middle")))
    spread = off.groupBy(*keys).agg(F.median("off").alias("mad"))
    scored = off.join(spread.where("mad > 0"), list(keys)).withColumn("z", 0.6745 * (F.col(value) - F.col("middle")) / F.col("mad"))
    return scored.where(F.abs("z") > threshold)


def status_seconds(df: DataFrame, keys: Sequence[str], at: str, up: Column, down: Column) -> DataFrame:
    """Seconds up and down between successive records; other statuses count as neither; none known: 100 %."""
    w = Window.partitionBy(*keys).orderBy(at)
    held = df.withColumn("up", up).withColumn("down", down).withColumn("held", seconds(F.lead(at).over(w)) - seconds(F.col(at)))
    out = held.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("up"), F.col("held"))), F.lit(0.0)).alias("up_seconds"), F.coalesce(F.sum(F.when(F.col("down"), F.col("held"))), F.lit(0.0)).alias("down_seconds"))
    return out.withColumn("availability", F.coalesce(F.try_divide(F.col("up_seconds"), F.col("up_seconds") + F.col("down_seconds")) * 100, F.lit(100.0)))


def trailing_throughput(df: DataFrame, at: str, now: Column, window: int) -> DataFrame:
    age = seconds(now) - seconds(F.col(at))
    return df.agg((F.count_if((age >= 0) & (age <= window)) / float(window)).alias("per_second"))


def successive_difference(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """First differences of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("difference", F.col(value) - F.lag(value).over(w)).where("difference is not null")
