"""Numeric classes: quantile bins and natural breaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.operators.statistics import counts_before


def histogram(df: DataFrame, value: str, most: int = 2048) -> list[tuple[float, int, float]]:
    """(value, rows, sum of squared deviations) of the finite values, rising: each distinct value, or where there are
    more than ``most``, the means of that many slices of equal width. What the driver gets is bounded by ``most``."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select((v + 0.0).alias("v"))
    low, high, distinct = rows.agg(F.min("v"), F.max("v"), F.approx_count_distinct("v")).first()
    if low is None:
        return []
    if distinct <= most * 0.9:
        found = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(most + 1).collect()
        if len(found) <= most:
            return [(r["v"], r["n"], 0.0) for r in found]
    slot = F.least(F.floor((F.col("v") - low) / ((high - low) / most)), F.lit(most - 1))
    found = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).orderBy("slot").collect()
    return [(r["mean"], r["n"], r["var"] * r["n"]) for r in found]


def natural_breaks(slots: list[tuple[float, int, float]], k: int) -> list[float]:
    """The least value, and the largest of each of ``k`` classes (fewer, if there are fewer values) with the least
    sum of squared deviations from the classes' means; of equal ones the lower breaks.

    A dynamic program over the slots: the best split of the first j into c classes extends one of c - 1.
    """
    if not slots:
        return []
    values, n, own = (np.array(x, float) for x in zip(*slots))
    k = min(k, len(values))
    middle = values.mean()
    total, first, second, inside = (np.concatenate(([0.0], np.cumsum(x))) for x in (n, n * (values - middle), n * (values - middle) ** 2, own))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Of slots i up to j - 1 as one class."""
        w, s = total[j] - total[i], first[j] - first[i]
        return np.maximum(0.0, second[j] - second[i] - s * s / w) + inside[j] - inside[i]

    best = np.array([0.0, *(cost(np.array([0]), j)[0] for j in range(1, len(values) + 1))])
    cuts = []
    for c in range(2, k + 1):
        new, cut = np.full(len(values) + 1, np.inf), np.zeros(len(values) + 1, int)
        for j in range(c, len(values) + 1):
            i = np.arange(c - 1, j)
            tried = best[i] + cost(i, j)
            cut[j] = i[int((tried <= tried.min() * (1 + 1e-12) + 1e-12).argmax())]
            new[j] = tried.min()
        best = new
        cuts.append(cut)
    ends = [len(values)]
    for cut in reversed(cuts):
        ends.append(int(cut[ends[-1]]))
    return [float(values[0]), *(float(values[e - 1]) for e in reversed(ends))]


def quantile_breaks(df: DataFrame, value: str, k: int) -> list[float]:
    """The distinct quantiles at steps of 1 / k, interpolated between ranks, by range partitions: no task holds all values."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    counted = counts_before(rows, "v")
    total = rows.count()
    if not total:
        return []
    places = [(total - 1) * i / k for i in range(k + 1)]
    wanted = sorted({int(x) for p in places for x in (p, min(p + 1, total - 1))})
    hits = F.filter(F.lit(np.array(wanted, np.int64)), lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__peers")))
    at = dict(counted.select(F.explode(hits).alias("rank"), "v").collect())
    found = [at[int(p)] + (p - int(p)) * (at[min(int(p) + 1, total - 1)] - at[int(p)]) for p in places]
    return sorted(set(found))


def binned(df: DataFrame, value: str, breaks: list[float], out: str = "bin") -> DataFrame:
    """``df`` with the number from 1 of the class whose upper break is the first not below the value; null outside."""
    v = F.col(value).cast("double")
    number = F.array_position(F.transform(F.lit(np.array(breaks[1:] or [0.0])), lambda b: (v <= b).cast("int")), 1)
    inside = v.between(breaks[0], breaks[-1]) if len(breaks) > 1 else F.lit(False)
    return df.withColumn(out, F.when(inside & ~F.isnan(v), number.cast("int")))
