"""Joins on time and on rules: range, interval, as-of, anti with a reason, theta, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import seconds


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, window: int) -> DataFrame:
    """Pairs with 0 <= left_at - right_at <= window, by an equi-join on keys and window-wide buckets.

    A left row meets its own bucket and the one before; no pair is found twice.  Right columns get
    the prefix ``r_``.
    """
    bucket = F.floor(seconds(F.col(left_at)) / window).cast("long")
    near = left.withColumn("bucket", F.explode(F.array(bucket, bucket - 1)))
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("r_bucket", F.floor(seconds(F.col(f"r_{right_at}")) / window).cast("long"))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    gap = seconds(F.col(left_at)) - seconds(F.col(f"r_{right_at}"))
    return near.join(other, [*same, F.col("bucket") == F.col("r_bucket")]).where(gap.between(0, window)).drop("bucket", "r_bucket")


def correlate(alerts: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """Each alert's parent: among candidates within the window before it, those that share a reference value first,
    then the most severe, then the latest, then the smallest id.

    Columns of both: id, at, rank (0 most severe), refs (array of reference values).  No pairs are made:
    of each severity only the latest candidate before an alert can be its parent (or the one before
    that, if the latest is the alert itself), and a running maximum over window-wide buckets finds it,
    once among all candidates and once among those of each reference value.
    """
    from pyspark.sql import Window

    ranks = sorted(r[0] for r in candidates.select("rank").distinct().collect())  # severities are few
    bucket = F.floor(seconds(F.col("at")) / window).cast("long")

    def latest(apart: bool) -> DataFrame:
        keys = ["bucket"] if apart else ["bucket", "ref"]
        # a candidate serves its own bucket and the next one
        own = candidates.select("id", "at", "rank", *([] if apart else [F.explode("refs").alias("ref")])).withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
        before = Window.partitionBy(*keys, "rank").orderBy("at", F.desc("id"))
        one = F.struct("at", "id")
        known = own.withColumn("c", F.struct(one.alias("last"), F.lag(one).over(before).alias("prior"))).select(*keys, "at", "id", F.lit(0).alias("side"), "rank", "c")
        asked = alerts.select("id", "at", *([] if apart else [F.explode(F.array_distinct("refs")).alias("ref")])).withColumn("bucket", bucket).select(*keys, "at", "id", F.lit(1).alias("side"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast(known.schema["c"].dataType).alias("c"))
        upto = Window.partitionBy(*keys).orderBy("at", "side", F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = known.unionByName(asked).select("id", "at", "side", *(F.last(F.when(F.col("rank") == r, F.col("c")), ignorenulls=True).over(upto).alias(f"c{k}") for k, r in enumerate(ranks)))
        options = [F.when(F.col(f"c{k}.last.id") == F.col("id"), F.col(f"c{k}.prior")).otherwise(F.col(f"c{k}.last")) for k in range(len(ranks))]
        found = [F.when(seconds(F.col("at")) - seconds(o["at"]) <= window, F.struct(F.lit(apart).alias("apart"), F.lit(r).alias("rank"), (-seconds(o["at"])).alias("ago"), o["id"].alias("r_id"))) for o, r in zip(options, ranks)]
        return both.where("side = 1").select("id", F.coalesce(*found).alias("b") if found else F.lit(None)).where("b is not null")

    if not ranks:
        return alerts.select("id", F.col("id").alias("parent_id"), F.lit("time").alias("kind")).limit(0)
    best = latest(True).unionByName(latest(False)).groupBy("id").agg(F.min("b").alias("b"))
    return best.select("id", F.col("b.r_id").alias("parent_id"), F.when(F.col("b.apart"), "time").otherwise("dependency").alias("kind"))


def asof_join(requests: DataFrame, points: DataFrame, keys: Sequence[str], requested_at: str, available_at: str, point: str) -> DataFrame:
    """Each request's latest point at or before it, in one pass: both sides sorted by time within a key.

    No pair of a request and its many earlier points is ever made.  ``first_at`` is the key's first
    point, which tells a request before all of them from a key without any.
    """
    from pyspark.sql import Window

    a = requests.withColumn("_at", F.col(requested_at)).withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(points.schema[point].dataType)).withColumn("_pt", F.lit(None).cast(points.schema[available_at].dataType))
    b = points.select(*keys, F.col(available_at).alias("_at"), F.lit(0).alias("_side"), F.col(point).alias("_p"), F.col(available_at).alias("_pt"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_p").desc_nulls_last())
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    found = both.withColumn(f"found_{point}", F.last("_p", ignorenulls=True).over(back)).withColumn("found_at", F.last("_pt", ignorenulls=True).over(back)).withColumn("first_at", F.min("_pt").over(Window.partitionBy(*keys)))
    return found.where("_side = 1").drop("_at", "_side", "_p", "_pt")


def restore_refusal(found_at: Column, first_at: Column, expires_at: Column, now: Column) -> Column:
    """Why no point can be restored, or NULL."""
    return F.when(first_at.isNull(), "no_points_available").when(found_at.isNull(), "requested_before_earliest").when(F.coalesce(expires_at <= now, F.lit(False)), "point_expired")


def interval_join(df: DataFrame, key: str, ident: str, start: str, end: str, slack: float = 0.0, width: float | None = None) -> DataFrame:
    """Pairs of one key whose intervals, the first padded by ``slack`` seconds, overlap strictly; each pair once.

    Two intervals overlap just if the later start lies inside the other one: starts go to one bucket each,
    intervals to the buckets that they touch.  A bucket is as wide as the median interval, unless given,
    so most intervals touch two.
    """
    s, e = seconds(F.col(start)), seconds(F.col(end))
    if width is None:
        width = max(1.0, float(df.agg(F.percentile_approx(e - s, 0.5)).first()[0] or 0.0) + 2 * slack)
    spans = df.select(F.col(key).alias("k"), F.col(ident).alias("i"), s.alias("s"), e.alias("e"))
    # what lies in the reach of an interval's padding counts as well
    held = spans.select("k", F.col("i").alias("hi"), F.col("s").alias("hs"), F.col("e").alias("he"), F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") + slack) / width))).alias("bucket"))
    points = spans.withColumn("bucket", F.floor(F.col("s") / width))
    # the later start (equal starts: the larger id) lies in the other interval
    later = (F.col("s") > F.col("hs")) | ((F.col("s") == F.col("hs")) & (F.col("i") > F.col("hi")))
    pairs = held.join(points, ["k", "bucket"]).where(later & (F.col("hi") != F.col("i")) & (F.col("s") < F.col("he") + slack) & (F.col("hs") - slack < F.col("e")))
    return pairs.select(F.col("k").alias(key), F.least("hi", "i").alias("left_id"), F.greatest("hi", "i").alias("right_id"))


def overlapping_entries(df: DataFrame, starts_at: str, ends_at: str, until: str, start: Column, end: Column, kind: Column | None = None) -> DataFrame:
    """Calendar entries that could touch a range: begun before its end and, with their recurrence, not over before its start."""
    found = df.where((F.col(starts_at) < end) & (F.coalesce(F.col(until), F.col(ends_at)) >= start))
    return found if kind is None else found.where(kind)


def conflict_kinds(schedule: Column, sides: Sequence[tuple[str, Column, Column]]) -> Column:
    """The kinds of conflict of an overlapping pair: the schedule, and each dimension with a shared value."""
    return F.array_compact(F.array(F.when(schedule, F.lit("schedule")), *(F.when(schedule & F.arrays_overlap(a, b), F.lit(kind)) for kind, a, b in sides)))


def suppressed(alerts: DataFrame, windows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Alerts with the kind that suppresses them: an active maintenance window first, then a suppression; NULL scope is all.

    Alerts: id, at, refs.  Windows: scope, starts_at, ends_at (end included).  Suppressions: scope.
    Both rule tables are few; Spark broadcasts them by their size.
    """
    scope = (F.col("scope").isNull()) | F.array_contains("refs", F.col("scope"))
    in_window = alerts.join(windows, scope & F.col("at").between(F.col("starts_at"), F.col("ends_at")), "left_semi").select("id", F.lit("maintenance_window").alias("by_window"))
    in_rule = alerts.join(suppressions, scope, "left_semi").select("id", F.lit("suppression").alias("by_rule"))
    return alerts.join(in_window, "id", "left").join(in_rule, "id", "left").select(*alerts.columns, F.coalesce("by_window", "by_rule").alias("suppressed_by"))


def theta_join(left: DataFrame, rules: DataFrame, matches: Column) -> DataFrame:
    """Each row with every rule whose condition holds (routes, subscriptions, placements)."""
    return left.join(rules, matches)


def merge_counts(table: DataFrame, changes: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """MERGE as a union and a re-aggregation: counters add up, new keys come in."""
    columns = [*keys, *counts]
    return table.select(columns).unionByName(changes.select(columns)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The n newest rows of each key; ``order`` must be total."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def with_lookup(df: DataFrame, names: DataFrame, key: str, name_key: str, name: str, out: str) -> DataFrame:
    """A dimension's name by id, or the id as text where there is none."""
    dim = names.select(F.col(name_key).alias("_k"), F.col(name).alias("_v"))
    return df.join(dim, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_v", F.col(key).cast("string"))).drop("_k", "_v")


def spans_to_edges(spans: DataFrame) -> DataFrame:
    """Caller to callee edges across services, with calls counted; spans: trace_id, span_id, parent_span_id, service."""
    p, c = spans.alias("p"), spans.alias("c")
    both = p.join(c, (F.col("p.trace_id") == F.col("c.trace_id")) & (F.col("p.span_id") == F.col("c.parent_span_id")))
    return both.where("p.service <> c.service").groupBy(F.col("p.service").alias("caller"), F.col("c.service").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))
