"""Order-dependent operators: ranks, runs, quotas, escalation, onsets, resolution groups, sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scoring import seconds


def to_ranked(df: DataFrame, keys: Sequence[str], score: str, ident: str) -> DataFrame:
    """Dense places 1..n by falling score, then by id."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), F.asc(ident))))


def status_runs(df: DataFrame, keys: Sequence[str], at: str, ident: str, status: str) -> DataFrame:
    """Runs of equal status: first and last moment and seconds until the next run (NULL: still open)."""
    order = Window.partitionBy(*keys).orderBy(at, ident)
    changed = F.coalesce((F.col(status) != F.lag(status).over(order)).cast("int"), F.lit(1))
    runs = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(order)).groupBy(*keys, "run").agg(F.first(status).alias(status), F.min(at).alias("started_at"), F.count(F.lit(1)).alias("n"))
    after = F.lead("started_at").over(Window.partitionBy(*keys).orderBy("run"))
    return runs.withColumn("duration", seconds(after) - seconds(F.col("started_at")))


def latest_then_max(df: DataFrame, keys: Sequence[str], kind: str, at: str, ident: str, score: str) -> DataFrame:
    """The highest of each kind's latest score: latest by an aggregate, so no sort is needed."""
    newest = df.groupBy(*keys, kind).agg(F.max_by(score, F.struct(at, ident)).alias("score"))
    return newest.groupBy(*keys).agg(F.max("score").alias("score"))


def last_points(df: DataFrame, keys: Sequence[str], at: str, ident: str, value: str, n: int) -> DataFrame:
    """Each key's last n values in time order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(ident))
    kept = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, ident, value))), lambda x: x[value]).alias("trend"))


def beyond_quota(df: DataFrame, keys: Sequence[str], at: str, ident: str, n: int) -> DataFrame:
    """The rows past the newest n of each key: what a quota removes."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(ident)))).where(F.col("_n") > n).drop("_n")


def verification_sample(df: DataFrame, ident: str, verified_at: str, max_age: Column, fraction: float) -> DataFrame:
    """Never verified, overdue, and the oldest round(fraction n) of the rest; with the reason.

    The rest's cut-off is a rank among its rows' dates: dates are counted first, so the running sum
    goes over days and not over rows; within the last day, ids decide.
    """
    kind = F.when(F.col(verified_at).isNull(), "never").when(F.col(verified_at) <= max_age, "overdue").otherwise("routine")
    tagged = df.withColumn("reason", kind)
    rest = tagged.where("reason = 'routine'")
    days = rest.groupBy(F.to_date(verified_at).alias("_day")).count()
    before = days.withColumn("_before", F.sum("count").over(Window.orderBy("_day")) - F.col("count")).withColumn("_all", F.sum("count").over(Window.partitionBy()))
    wanted = F.bround(F.lit(fraction) * F.col("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_day").orderBy(verified_at, ident))
    picked = rest.withColumn("_day", F.to_date(verified_at)).join(before, "_day").withColumn("_place", place).where(F.col("_place") <= wanted).select(tagged.columns)
    return tagged.where("reason <> 'routine'").unionByName(picked)


def escalation_levels(raw: Column) -> Column:
    """Array of (level, after): delays add up in array order; entries without a delay are passed over."""
    valid = F.filter(raw, lambda x: x["delay"].isNotNull() & (x["delay"] >= 0))
    start = F.array().cast("array<struct<level:int,after:double>>")

    def step(acc: Column, x: Column) -> Column:
        so_far = F.when(F.size(acc) > 0, F.element_at(acc, -1)["after"]).otherwise(0.0)
        return F.array_append(acc, F.struct((F.size(acc) + 1).cast("int").alias("level"), (so_far + x["delay"]).alias("after")))

    return F.aggregate(valid, start, step)


def due_level(levels: Column, elapsed: Column) -> Column:
    """The last level whose time has come, or NULL."""
    reached = F.filter(levels, lambda x: x["after"] <= elapsed)
    return F.when(F.size(reached) > 0, F.element_at(reached, -1)["level"])


def due_steps(levels: Column, elapsed: Column, fired: Column) -> Column:
    """All levels whose time has come and that haven't fired."""
    return F.array_except(F.transform(F.filter(levels, lambda x: x["after"] <= elapsed), lambda x: x["level"]), fired)


def onsets(df: DataFrame, keys: Sequence[str], at: str, ident: str, window_start: Column, edge: float = 30.0) -> DataFrame:
    """Each key's earliest signal; NULL time if it lies within the edge of the window's start (censored)."""
    first = df.groupBy(*keys).agg(F.min(F.struct(at, ident)).alias("f"))
    censored = seconds(F.col(f"f.{at}")) - seconds(window_start) <= edge
    return first.select(*keys, F.col(f"f.{ident}").alias(ident), F.when(~censored, F.col(f"f.{at}")).alias("onset_at"), censored.alias("censored"))


def resolution_groups(df: DataFrame, keys: Sequence[str], at: str, ident: str, tolerance: float) -> DataFrame:
    """Groups that begin at an anchor and take what follows within ``tolerance`` seconds of it (not of each other).

    (key, id, group, size of the group).  Rows stream by key and time through a task that remembers one
    anchor, so no key's history is gathered.
    """
    t, rows = "_t", df.where(F.col(at).isNotNull())
    narrow = rows.select(*keys, ident, seconds(F.col(at)).alias(t)).repartition(*keys).sortWithinPartitions(*keys, t, ident)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor, group = None, 0.0, 0
        for batch in batches:
            out = []
            for key, moment in zip(zip(*(batch[k] for k in keys)), batch[t]):
                if key != now:
                    now, anchor, group = key, moment, 0
                elif moment - anchor > tolerance:
                    anchor, group = moment, group + 1
                out.append(group)
            yield batch.drop(columns=t).assign(group_no=np.array(out, np.int32))

    numbered = narrow.mapInPandas(number, T.StructType([*(narrow.schema[c] for c in (*keys, ident)), T.StructField("group_no", T.IntegerType())]))
    return numbered.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy(*keys, "group_no")))


def validation_backlog(df: DataFrame, validated: str, expires_at: str, now: Column, order: Sequence[Column]) -> DataFrame:
    """What isn't validated and hasn't expired, newest first by ``order``."""
    return df.where(~F.coalesce(F.col(validated), F.lit(False)) & ~F.coalesce(now >= F.col(expires_at), F.lit(False))).orderBy(*order)


def timeline(df: DataFrame, keys: Sequence[str], at: str, ident: str, censored: str, tolerance: float) -> DataFrame:
    """(key, id, censored, unplaceable, group_no, members): onsets with a time in resolution groups, the rest kept visible."""
    groups = resolution_groups(df, keys, at, ident, tolerance)
    marked = df.select(*keys, ident, F.col(censored).alias("censored"), (F.col(at).isNull() & ~F.col(censored)).alias("unplaceable"))
    return marked.join(groups, [*keys, ident], "left")


def resolved_configuration(df: DataFrame, keys: Sequence[str], platform: str, environment: str, enabled: str, order: str, value: str, *, on: str, within: str) -> DataFrame:
    """By key the value in force: enabled entries of the environment; those of the platform beat those of none, later ones earlier ones."""
    fitting = df.where(F.col(enabled) & (F.col(environment) == within) & (F.col(platform).isNull() | (F.col(platform) == on)))
    return fitting.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(platform).isNotNull(), F.col(order))).alias("value"))


def chosen_instances(df: DataFrame, keys: Sequence[str], ident: str, healthy: str, circuit_open: str, connections: str, counter: int) -> DataFrame:
    """By service, of the healthy instances behind closed circuits: the least loaded (ties by id) and the round-robin's next."""
    viable = df.where(F.col(healthy) & ~F.col(circuit_open))
    least = viable.groupBy(*keys).agg(F.min(F.struct(connections, ident)).alias("l"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ident)) - 1
    turn = viable.withColumn("_p", place).join(least, list(keys)).where(F.col("_p") == F.lit(counter) % F.col("n"))
    return turn.select(*keys, F.col(f"l.{ident}").alias("least_connections"), F.col(ident).alias("round_robin"))


def assign(roster: DataFrame, keys: Sequence[str], required: Sequence[str], prefer_on_call: bool = True) -> DataFrame:
    """By key the responder: on call, else with all skills, else anyone available; least loaded, then id.

    Roster columns: responder, load, skills (array), on_call, available.
    """
    skilled = F.size(F.array_except(F.array(*(F.lit(x) for x in required)), F.col("skills"))) == 0 if required else F.lit(False)
    tier = F.when(F.col("on_call") & F.lit(prefer_on_call), 0).when(skilled, 1).otherwise(2)
    best = F.min(F.struct(tier.alias("tier"), F.col("load"), F.col("responder")))
    return roster.where("available").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.responder").alias("responder"), F.element_at(F.array(F.lit("on_call"), F.lit("skill_based"), F.lit("load_balanced")), F.col("b.tier") + 1).alias("method"))


def waves(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Ordered groups of ``size``: range-partitioned and numbered part by part, so no task gets all rows."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").count()
    # one row for each partition: a bounded table
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(before, "_part").withColumn("wave", F.floor(place / size).cast("long")).drop("_part", "_before")
