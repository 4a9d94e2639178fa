"""Energy scenarios to area demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.operators.statistics import group_quantiles


def energy_key(first: Column, second: Column, mapping: dict[str, str]) -> Column:
    """The first of two technology columns that the mapping knows."""
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(first))), F.try_element_at(known, F.upper(F.trim(second))))


def mix(df: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Sums by part and their share of the keys' total."""
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("twh"))
    totals = parts.groupBy(*keys).agg(F.sum("twh").alias("total_twh"))
    return parts.join(totals, keys).withColumn("share", F.when(F.col("total_twh") != 0, F.col("twh") / F.col("total_twh")))


def planned(df: DataFrame, scenario: str, year: int, scale: float) -> DataFrame:
    return df.where((F.col("scenario") == scenario) & (F.col("year") == year)).withColumn("value_twh", F.col("value_twh") * scale)


def rebalance(df: DataFrame, wind_share: float, keys: list[str]) -> DataFrame:
    """A new wind share of wind and solar together, their total unchanged."""
    total = F.sum(F.when(F.col("energy_key").isin("wind", "solar"), F.col("value_twh"))).over(Window.partitionBy(*keys))
    share = F.when(F.col("energy_key") == "wind", wind_share).when(F.col("energy_key") == "solar", 1 - wind_share)
    return df.withColumn("value_twh", F.when(share.isNotNull(), total * share).otherwise(F.col("value_twh")))


def area_demand(df: DataFrame, factors: DataFrame) -> DataFrame:
    """TWh times square kilometres for each TWh; an unknown factor gives null."""
    return df.join(factors, "energy_key", "left").withColumn("area_km2", F.col("value_twh") * F.col("km2_per_twh"))


def observed_factors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, middle and largest known value of each group, and how many are known."""
    n = df.groupBy(*keys).agg(F.count(value).alias("n"))
    return n.join(group_quantiles(df, keys, value, {"low": (0.0, 7), "mid": (0.5, 7), "high": (1.0, 7)}), keys, "left").select(*keys, "low", "mid", "high", "n")
