"""Projections, filters, joins, set operations and reshaping over hexagon frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.functions import hexgrid


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by a lookup of old to new names."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def reindex(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns; those that are missing as nulls."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def in_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Trimmed and without regard to case; no filter if the column is absent."""
    if column not in df.columns:
        return df
    return df.where(F.lower(F.trim(F.col(column))).isin([v.strip().lower() for v in values]))


def first_by_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in a stated order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def active_rows(df: DataFrame, signals: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in which any signal is positive, and the complement."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in signals))
    return df.where(total > 0), df.where(total <= 0)


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with a sample deviation above 0, found in one pass."""
    row = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def merge_layers(layers: list[DataFrame], key: str, value: str = "value", name: str = "layer") -> DataFrame:
    """Full outer join of many layers as one union and one pivot: a single shuffle."""
    stacked = reduce(lambda a, b: a.unionByName(b), (df.select(key, F.lit(n).alias(name), F.col(value).cast("double").alias(value)) for n, df in layers))
    return stacked.groupBy(key).pivot(name, [n for n, _ in layers]).agg(F.first(value))


def parent_distances(cells: DataFrame, distances: DataFrame, fine: int, coarse: int, cell: str = "cell") -> DataFrame:
    """Cross-resolution join: a coarse table reaches fine cells through their parent, an equi-join."""
    lifted = cells.withColumn("__parent", hexgrid.parent(F.col(cell), coarse))
    return lifted.join(distances.withColumnRenamed(cell, "__parent"), "__parent", "left").drop("__parent")


def lifted_distances(distances: DataFrame, coarse: int, cell: str = "cell") -> DataFrame:
    """A fine distance table brought to a coarser resolution: least distance, any intersection."""
    up = distances.withColumn(cell, hexgrid.parent(F.col(cell), coarse))
    return up.groupBy(cell).agg(F.min("distance_m").alias("distance_m"), F.bool_or("intersects").alias("intersects"))


def outside(all_cells: DataFrame, some: DataFrame, key: str) -> DataFrame:
    return all_cells.join(some, key, "left_anti")


def union_max(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).groupBy(key).agg(F.max(value).alias(value))


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; missing columns become nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_wide(df: DataFrame, key: str, child: str, value: str, children: list[str]) -> DataFrame:
    """A column for each child, their total, zeros for none."""
    wide = df.groupBy(key).pivot(child, children).agg(F.sum(value)).fillna(0.0, children)
    return wide.withColumn("total", reduce(lambda a, b: a + b, (F.col(f"`{c}`") for c in children)))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def upsert(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``log`` with the same key."""
    return log.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolve_columns(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """The first alias that exists, for each wanted name; raises for one that has none."""
    lower = {c.lower(): c for c in columns}
    out = {}
    for wanted, names in aliases.items():
        hit = next((lower[n.lower()] for n in names if n.lower() in lower), None)
        if hit is None:
            raise KeyError(f"no column for {wanted}: one of {names}")
        out[wanted] = hit
    return out
