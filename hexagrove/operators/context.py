"""Multiscalar neighbourhood context, nearest joins and layer-to-cell aggregation in the plane.

Neighbour searches are equi-joins on square bins: each point looks in its bin and the eight around, and is
done once what it needs lies within the distance that those bins cover for certain; the rest goes on with
bins of twice the size. Dense bins cost their own pairs only; no cross join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.operators.lineage import written


def binned(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("bx", F.floor(F.col(x) / size)).withColumn("by", F.floor(F.col(y) / size))


def around(ring: int) -> Column:
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    return F.flatten(F.transform(steps, lambda a: F.transform(steps, lambda b: F.struct(a.alias("a"), b.alias("b")))))


def candidates(points: DataFrame, others: DataFrame, ring: int) -> DataFrame:
    """Pairs of ``points`` (id, x, y, bx, by) with ``others`` (oid, ox, oy, obx, oby, …) in the bins around."""
    near = points.withColumn("s", F.explode(around(ring))).withColumn("obx", F.col("bx") + F.col("s.a")).withColumn("oby", F.col("by") + F.col("s.b")).drop("s")
    return near.join(others, ["obx", "oby"]).withColumn("d", F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))


def sure(ring: int, size: float) -> float:
    """The distance within which ``ring`` bins around hold every other point."""
    return ring * size


def fitting(df: DataFrame, size: float, wanted: float, x: str = "x", y: str = "y") -> float:
    """A size of bins to start with: quartered from ``size`` until a row meets at most ``wanted`` in its bin, on average over rows.

    Dense tables thus start with small bins, and only rows that lie apart go on to large ones. Many rows at one place
    stay together in any bin: where a quarter no longer parts them, it ends.
    """

    def crowd(step: float) -> float:
        bins = binned(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), step, x, y).groupBy("bx", "by").agg(F.count(F.lit(1)).cast("double").alias("n"))
        return bins.agg(F.sum(F.col("n") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).first()[0] or 0.0

    now = crowd(size)
    while now > wanted:
        finer = crowd(size / 4)
        if finer > 0.9 * now:
            break
        size, now = size / 4, finer
    return size


def weighted_context(points: DataFrame, values: list[str], ks: list[float], size: float) -> DataFrame:
    """For each id and k: nearest neighbours, itself first, until their weights reach k; the weighted means,
    weighted population deviations, the radius and the total. ``points``: id, x, y, w, values.

    Ties of distance go by id. Points whose neighbours never reach k use all there are: bins
    double until three side by side cover the measured extent.
    """
    base = written(points)
    others = base.select(*(F.col(c).alias("o" + c) for c in ["id", "x", "y", "w", *values]))
    width = base.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    waiting, parts = base.select("id", "x", "y"), []
    top = max(ks)
    order = Window.partitionBy("id").orderBy("d", "oid")
    size = fitting(base, size, 16.0)
    while True:
        last = size > width
        pairs = candidates(binned(waiting, size), binned(others, size, "ox", "oy").withColumnsRenamed({"bx": "obx", "by": "oby"}), 1)
        if not last:
            pairs = pairs.where(F.col("d") <= sure(1, size))
        run = pairs.withColumn("cs", F.sum("ow").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        run = written(run.where(F.col("cs") - F.col("ow") < top).select("id", "d", "cs", "ow", *("o" + v for v in values)))
        if last:
            parts.append(run)
            break
        done = run.groupBy("id").agg(F.max("cs").alias("m")).where(F.col("m") >= top).select("id")
        parts.append(run.join(done, "id", "left_semi"))
        waiting = written(waiting.join(done, "id", "left_anti"))
        if not waiting.limit(1).count():
            break
        size *= 2
    found = reduce(lambda a, b: a.unionByName(b), parts).withColumn("k", F.explode(F.array(*(F.lit(float(k)) for k in ks))))
    found = found.where(F.col("cs") - F.col("ow") < F.col("k"))
    moments = [F.sum(F.col("ow") * F.col("o" + v)).alias("s_" + v) for v in values] + [F.sum(F.col("ow") * F.col("o" + v) * F.col("o" + v)).alias("q_" + v) for v in values]
    out = found.groupBy("id", "k").agg(F.sum("ow").alias("total"), F.max("d").alias("radius"), *moments)
    stats = []
    for v in values:
        mean = F.col("s_" + v) / F.col("total")
        stats += [mean.alias("mean_" + v), F.sqrt(F.greatest(F.lit(0.0), F.col("q_" + v) / F.col("total") - mean * mean)).alias("std_" + v)]
    return out.select("id", "k", "radius", "total", *stats)


def nearest(points: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """(id, oid, distance): the nearest other of each point, the smaller id of equals.

    Bins start as small as the others lie dense and double in size, so that a far search looks in nine bins as well; it ends when nothing waits or
    three bins side by side cover the measured extent of both tables.
    """
    waiting = written(points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL"))
    rest = written(others.select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy")).where("ox IS NOT NULL AND oy IS NOT NULL"))
    both = waiting.select("x", "y").unionByName(rest.select(F.col("ox").alias("x"), F.col("oy").alias("y")))
    width = both.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    parts = []
    size = fitting(rest, size, 4.0, "ox", "oy")
    while True:
        last = size > width
        best = candidates(binned(waiting, size), binned(rest, size, "ox", "oy").withColumnsRenamed({"bx": "obx", "by": "oby"}), 1)
        best = best.groupBy("id").agg(F.min(F.struct("d", "oid")).alias("m")).select("id", "m.oid", F.col("m.d").alias("distance"))
        best = written(best if last else best.where(F.col("distance") <= sure(1, size)))
        parts.append(best)
        waiting = written(waiting.join(best, "id", "left_anti"))
        if last or not waiting.limit(1).count():
            break
        size *= 2
    return reduce(lambda a, b: a.unionByName(b), parts)


def hex_of(x: Column, y: Column, edge: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon of ``edge`` that holds a point (cube rounding)."""
    q = (x * (3**0.5 / 3) - y / 3) / edge
    r = y * (2 / 3) / edge
    s = -q - r
    rq, rr, rs = F.bround(q), F.bround(r), F.bround(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    out_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    out_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return out_q.cast("int"), out_r.cast("int")


def hex_center(q: Column, r: Column, edge: float) -> tuple[Column, Column]:
    return edge * (3**0.5) * (q + r / 2), edge * 1.5 * r


def points_per_hex(points: DataFrame, grid: DataFrame, edge: float, value: str) -> DataFrame:
    """Count and sum of points in each grid cell; cells without any get 0."""
    q, r = hex_of(F.col("x"), F.col("y"), edge)
    hits = points.select(q.alias("q"), r.alias("r"), value).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"), (F.max(value) - F.min(value)).alias("relief"))
    return grid.join(hits, ["q", "r"], "left").fillna(0, ["n"]).fillna(0.0, ["total", "top", "relief"])


def line_length_per_hex(lines: DataFrame, edge: float) -> DataFrame:
    """Length of segments (x1, y1, x2, y2) in each hexagon: candidate cells around the segment, then the
    part of the segment inside the six half-planes of the convex cell, as plain expressions."""
    q1, r1 = hex_of(F.col("x1"), F.col("y1"), edge)
    q2, r2 = hex_of(F.col("x2"), F.col("y2"), edge)
    box = lines.withColumns({"qa": F.least(q1, q2) - 1, "qb": F.greatest(q1, q2) + 1, "ra": F.least(r1, r2) - 1, "rb": F.greatest(r1, r2) + 1})
    cells = box.withColumn("q", F.explode(F.sequence("qa", "qb"))).withColumn("r", F.explode(F.sequence("ra", "rb")))
    cx, cy = hex_center(F.col("q"), F.col("r"), edge)
    cells = cells.withColumn("cx", cx).withColumn("cy", cy)
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    inner = edge * 3**0.5 / 2


    for k in range(6):
        nx, ny = math.cos(math.radians(60 * k)), math.sin(math.radians(60 * k))
        a = (F.col("x1") - F.col("cx")) * nx + (F.col("y1") - F.col("cy")) * ny - inner
        slope = (F.col("x2") - F.col("x1")) * nx + (F.col("y2") - F.col("y1")) * ny
        high.append(F.when(slope > 1e-12, -a / slope).when((F.abs(slope) <= 1e-12) & (a > 0), -1.0).otherwise(1.0))
        low.append(F.when(slope < -1e-12, -a / slope).otherwise(0.0))
    part = F.greatest(F.lit(0.0), F.least(*high) - F.greatest(*low))
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return cells.withColumn("length", part * length).where("length > 1e-9").groupBy("q", "r").agg(F.sum("length").alias("length"))
