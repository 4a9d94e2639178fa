"""Feature matrix of cells (G4, G8 to G10): elevation, protected share, turbines and people of each cell's polygon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.operators import context, shapes

#: Names under which a layer may hold its heights, in order (fixed values).
ELEVATION = ("Elevation", "ELEVATION", "elevation", "KOTE", "kote", "Hojde", "HOJDE", "height", "HEIGHT")


def elevation_column(columns: list[str]) -> str:
    found = next((c for c in ELEVATION if c in columns), None)
    if found is None:
        raise KeyError(f"no column of heights: one of {ELEVATION}")
    return found


def layer_values(cells: DataFrame, layer: DataFrame, key: str, cell_shape: str, layer_shape: str, value: str, tile: float) -> DataFrame:
    """For each cell the count, least, largest and mean value of the features that touch it, and their spread, 0 without any."""
    hits = shapes.spatial_join(cells.select(key, cell_shape), layer.select(F.col(layer_shape).alias("feature"), F.col(value).cast("double").alias("v")), cell_shape, "feature", tile)
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    out = cells.select(key).join(found, key, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("spread", F.coalesce(F.col("high") - F.col("low"), F.lit(0.0)))


def elevation(cells: DataFrame, contours: DataFrame, key: str, cell_shape: str, layer_shape: str, tile: float) -> DataFrame:
    out = layer_values(cells, contours, key, cell_shape, layer_shape, elevation_column(contours.columns), tile)
    return out.select(key, F.col("low").alias("elev_min"), F.col("high").alias("elev_max"), F.col("mean").alias("elev_mean"), F.col("spread").alias("relief"))


def protected_share(cells: DataFrame, areas: DataFrame, key: str, cell_shape: str, area_shape: str, tile: float) -> DataFrame:
    """The share of each convex cell that protected polygons cover; above 1 where they overlap."""
    common = shapes.overlay(areas.select(F.col(area_shape).alias("polygon")), cells.select(key, cell_shape), "polygon", cell_shape, tile)
    sums = common.groupBy(key).agg(F.sum("common").alias("m2"))
    return cells.join(sums, key, "left").select(key, (F.coalesce("m2", F.lit(0.0)) / shapes.area(F.col(cell_shape)["paths"])).alias("protected_share"))


def turbines(cells: DataFrame, points: DataFrame, key: str, cell_shape: str, tile: float) -> DataFrame:
    """Turbines (id, x, y) in each cell, the distance from the middle of its box to the nearest, and its logarithm."""
    at = shapes.shape("point", F.array(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")))))
    hits = layer_values(cells, points.withColumn("at", at), key, cell_shape, "at", "id", tile).select(key, F.col("n").alias("n_turbines"))
    b = shapes.box(F.col(cell_shape)["paths"])
    middles = cells.select(F.col(key).alias("id"), ((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))
    near = context.nearest(middles, points, tile).select(F.col("id").alias(key), F.col("distance").alias("dist_to_nearest_turbine"))
    return hits.join(near, key, "left").withColumn("dist_turbine_log", F.log1p("dist_to_nearest_turbine"))


def people(cells: DataFrame, points: DataFrame, key: str, cell_shape: str, at: str, persons: str, tile: float) -> DataFrame:
    hits = shapes.spatial_join(cells.select(key, cell_shape), points.select(F.col(at).alias("place"), F.col(persons).cast("double").alias("v")), cell_shape, "place", tile)
    sums = hits.groupBy(key).agg(F.sum("v").alias("persons"))
    return cells.select(key).join(sums, key, "left").select(key, F.coalesce("persons", F.lit(0.0)).alias("persons"), F.log1p(F.coalesce("persons", F.lit(0.0))).alias("persons_log"))


def feature_matrix(cells: DataFrame, key: str, protected: DataFrame, wind: DataFrame, population: DataFrame, heights: DataFrame) -> DataFrame:
    """One row for each cell: protected_share (0 if unknown), dist_turbine_log, persons_log, relief."""
    out = reduce(lambda a, b: a.join(b, key, "left"), (protected, wind, population, heights), cells.select(key))
    return out.select(key, F.coalesce("protected_share", F.lit(0.0)).alias("protected_share"), "dist_turbine_log", "persons_log", "relief")
