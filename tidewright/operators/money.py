"""Money in decimals: sums with missing prices, conversion, exact splits, increments, costs by rate card."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MONEY = "decimal(38,10)"


def sum_money(df: DataFrame, keys: Sequence[str], amount: str, currency: str) -> DataFrame:
    """By key and currency: the total, and whether a missing amount makes it a lower bound."""
    return df.groupBy(*keys, currency).agg(F.coalesce(F.sum(F.col(amount).cast("decimal(28,10)")), F.lit(0).cast(MONEY)).alias("total"), (F.count_if(F.col(amount).isNull()) > 0).alias("is_lower_bound"))


def convert(df: DataFrame, keys: Sequence[str], amount: str, currency: str, rates: DataFrame) -> DataFrame:
    """By key the total in one currency; incomplete where a rate is missing.  rates: currency, rate."""
    known = df.join(rates.select(F.col("currency").alias(currency), "rate"), currency, "left")
    value = F.col(amount).cast("decimal(24,6)") * F.col("rate").cast("decimal(12,6)")
    return known.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,6)").alias("total"), (F.count_if(F.col("rate").isNull() | F.col(amount).isNull()) == 0).alias("complete"))


def split_money(df: DataFrame, keys: Sequence[str], amount: str, weight: str, ident: str, places: int = 2) -> DataFrame:
    """Each row's share of its key's amount, in units of 10^-places, by largest remainder: the parts sum to it exactly.

    Equal remainders go by id.
    """
    unit, group = 10**places, Window.partitionBy(*keys)
    # decimals throughout: equal remainders must be equal
    units = F.round(F.col(amount).cast("decimal(16,4)") * unit).cast("decimal(14,0)")
    whole = F.sum(F.col(weight).cast("decimal(12,4)")).over(group)
    parts = df.withColumn("_units", units).withColumn("_part", units * F.col(weight).cast("decimal(12,4)")).withColumn("_all", whole).withColumn("_floor", F.expr("_part div _all")).withColumn("_rest", F.expr("_part % _all"))
    short = F.col("_units") - F.sum("_floor").over(group)
    place = F.row_number().over(group.orderBy(F.desc("_rest"), ident))
    return parts.withColumn("share", ((F.col("_floor") + F.when(place <= short, 1).otherwise(0)) / F.lit(unit)).cast(f"decimal(20,{places})")).drop("_units", "_part", "_all", "_floor", "_rest")


def minimum_increment(quantity: Column, increment: Column) -> Column:
    """Rounded up to a multiple of the increment."""
    return F.ceil(quantity / increment) * increment


def cost_report(usage: DataFrame, rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Usage (usage_id, at, sku, owner, quantity) priced by the rate in force at its time.

    Repeats of a usage_id count once; without a rate it is unpriced, without an owner unattributed.
    rates: sku, valid_from, unit_price.
    """
    from .joins import asof_join

    once = usage.withColumn("_n", F.row_number().over(Window.partitionBy("usage_id").orderBy("at"))).where("_n = 1").drop("_n")
    priced = asof_join(once, rates, ["sku"], "at", "valid_from", "unit_price")
    state = F.when(F.col("found_unit_price").isNull(), "unpriced").when(F.col("owner").isNull(), "unattributed").otherwise("attributed")
    cost = (F.col("quantity") * F.col("found_unit_price")).cast("decimal(28,6)")
    return priced.withColumn("state", state).withColumn("cost", cost).groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(38,6)").alias("cost"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token sums and cost by model; prices: model, usd_per_1k."""
    return usage.join(prices, "model", "left").groupBy("model").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") / 1000 * F.coalesce("usd_per_1k", F.lit(0.0))).alias("cost_usd"))
