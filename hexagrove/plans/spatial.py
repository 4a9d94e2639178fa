"""Spatial aggregation (G) onto a planar hexagon grid, and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.operators import context
from hexagrove.plans.domain import points
from hexagrove.plans.registry import query, read
from hexagrove.streaming import recent

EDGE = 0.04


def grid(spark, d):
    q, r = context.hex_of(F.col("x"), F.col("y"), EDGE)
    return points(spark, d).select(q.alias("q"), r.alias("r")).distinct()


@query("G1_points_per_hex")
def g1(spark, d):
    return context.points_per_hex(points(spark, d), grid(spark, d), EDGE, "v")


@query("G2_line_length_per_hex")
def g2(spark, d):
    e = F.col("embedding")
    ends = read(spark, d, "embeddings").select(*(e[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))
    return context.line_length_per_hex(ends, EDGE)


@query("G14_occupied_cells", "SELECT floor(embedding[1]::DOUBLE / 0.05)::BIGINT AS bx, floor(embedding[2]::DOUBLE / 0.05)::BIGINT AS \"by\", count(*) AS n FROM embeddings GROUP BY 1, 2")
def g14(spark, d):
    return context.binned(points(spark, d), 0.05).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


@query("E1_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def e1(spark, d):
    out = recent.windowed_counts(read(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
