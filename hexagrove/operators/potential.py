"""Scores, acceptance and siting potential of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions.scalars import class_of, clip, round_even
from hexagrove.operators.statistics import BREAKS


def positive_mean(columns: list[str], cap: float) -> Column:
    """Mean over the known columns, each cut to 0..cap and scaled to 0..1."""
    parts = F.filter(F.array(*(clip(F.col(c), 0.0, cap) / cap for c in columns)), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.0)


def cluster_term(cluster: Column, reference: str, weight: float) -> Column:
    return F.when(cluster.cast("string") == reference, weight).otherwise(0.0)


def score(df: DataFrame, base: float, cluster: str, cluster_terms: dict[str, float], role_terms: list[tuple[list[str], float]], cap: float = 2.0, out: str = "score", breaks=BREAKS) -> DataFrame:
    """Base plus cluster and role terms, cut to 0..100, one decimal, with its class."""
    terms = [cluster_term(F.col(cluster), ref, w) for ref, w in cluster_terms.items()]
    terms += [positive_mean(cols, cap) * w for cols, w in role_terms]
    total = reduce(lambda a, b: a + b, terms, F.lit(float(base)))
    df = df.withColumn(out, round_even(clip(total, 0.0, 100.0), 1))
    return df.withColumn(f"{out}_class", class_of(F.col(out), breaks))


def distance_conflict(distance: Column, intersects: Column, threshold: float, unknown: float = 0.0) -> tuple[Column, Column]:
    """Acceptance rises from the threshold to twice it; an unknown distance is ``unknown`` but not blocked."""
    if threshold <= 0:
        return F.when(intersects, 0.0).otherwise(1.0), intersects
    end = max(threshold * 2, threshold + 1)
    ramp = F.coalesce(clip((distance - threshold) / (end - threshold), 0.0, 1.0), F.lit(unknown))
    return F.when(intersects, 0.0).otherwise(ramp), intersects | F.coalesce(distance <= threshold, F.lit(False))


def proximity(distance: Column, intersects: Column, threshold: float, unknown: float = 0.0) -> tuple[Column, Column]:
    """Acceptance falls from 1 at the thing to 0 at the threshold; an unknown distance is ``unknown``, not blocked."""
    reach = max(threshold, 1.0)
    near = F.coalesce(clip(1 - distance / reach, 0.0, 1.0), F.lit(unknown))
    return F.when(intersects, 1.0).otherwise(near), ~intersects & F.coalesce(distance > reach, F.lit(False))


def hard_exclusion(distance: Column, intersects: Column, threshold: float) -> tuple[Column, Column]:
    blocked = intersects if threshold <= 0 else intersects | F.coalesce(distance <= threshold, F.lit(False))
    return F.when(blocked, 0.0).otherwise(1.0), blocked


KERNELS = {"distance_conflict": distance_conflict, "proximity_feasibility": proximity}


def acceptance(kind: str, distance: Column, intersects: Column, threshold: float, unknown: float = 0.0) -> tuple[Column, Column]:
    """An unknown kind is a hard exclusion; ``unknown`` is the others' acceptance where no distance is known (0 in the reference)."""
    intersects = F.coalesce(intersects, F.lit(False))
    return KERNELS[kind](distance, intersects, threshold, unknown) if kind in KERNELS else hard_exclusion(distance, intersects, threshold)


def group_distances(distances: DataFrame, cell: str = "cell") -> DataFrame:
    """Many layers' distances in long form to one row for each cell and group: no N-way join."""
    return distances.groupBy(cell, "group_id").agg(F.min("distance_m").alias("distance_m"), F.bool_or(F.coalesce("intersects", F.lit(False))).alias("intersects"))


def accepted(base: DataFrame, grouped: DataFrame, groups: list[tuple[str, str, float]], cell: str = "cell", score_col: str = "score", least: float = 45.0, unknown: float = 0.0) -> DataFrame:
    """The least acceptance over the groups times the score; hard-blocked cells score 0.

    ``groups``: (id, kind, threshold); ``unknown`` as in ``acceptance``. Long table to wide by one pivot, then ``least``.
    """
    names = [g for g, _, _ in groups]
    wide = grouped.where(F.col("group_id").isin(names)).groupBy(cell).pivot("group_id", names).agg(F.first("distance_m").alias("d"), F.first("intersects").alias("x"))
    df = base.join(wide, cell, "left")
    values, blocks, hards, blockers = [], [], [], []
    for name, kind, threshold in groups:
        value, blocked = acceptance(kind, F.col(f"{name}_d"), F.col(f"{name}_x"), threshold, unknown)
        values.append(value)
        blocks.append(blocked)
        blockers.append(F.when(blocked, F.lit(name)))
        if kind not in KERNELS:
            hards.append(blocked)
    any_of = lambda flags: reduce(lambda a, b: a | b, flags, F.lit(False))
    df = df.withColumn("acceptance", F.least(*values) if len(values) > 1 else values[0]).withColumn("blocked", any_of(blocks)).withColumn("hard_blocked", any_of(hards))
    df = df.withColumn("blocking", F.concat_ws(", ", *blockers))
    final = F.when(F.col("hard_blocked"), 0.0).otherwise(clip(F.col(score_col) * F.col("acceptance"), 0.0, 100.0))
    df = df.withColumn("final_score", round_even(final, 1)).withColumn("potential_area", (F.col("final_score") >= least) & ~F.col("hard_blocked"))
    return df.drop(*(f"{n}_{s}" for n in names for s in "dx"))


def scenario_rules(df: DataFrame, rules: list[tuple[str, str, dict[str, float]]], scenarios: list[str], score_col: str, keys: list[str]) -> DataFrame:
    """Rules as (name, condition column with ``{limit}``, limits by scenario) to long results by scenario.

    A cell is allowed if no rule fails; the reason lists those that do.
    """
    parts = []
    for scenario in scenarios:
        fails = [F.when(F.expr(condition.format(limit=limits[scenario])), F.lit(name)) for name, condition, limits in rules]
        parts.append(F.struct(F.lit(scenario).alias("scenario"), F.concat_ws(", ", *fails).alias("reason")))
    long = df.select(*keys, score_col, F.explode(F.array(*parts)).alias("s"))
    return long.select(*keys, "s.scenario", "s.reason", (F.col("s.reason") == "").alias("allowed"), F.when(F.col("s.reason") == "", F.col(score_col)).alias("score"))
