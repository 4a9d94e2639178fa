"""Surfaces on a grid of cells (row, col): interpolation, terrain, majority filters, class outlines.

A raster is a long frame with one row for each known cell. Neighbourhoods run on square tiles with a halo: a cell goes to
its own tile and to those whose halo it lies in, so a task holds (size + 2 * halo)**2 cells at most, whatever the raster's size.
Edges of tiles leave no trace in the result. Repeated cells count once, with the last value of the tile's order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.operators import shapes

TILE = 256


def on_tiles(df: DataFrame, value: str, halo: int, function: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outs: list[str], size: int = TILE) -> DataFrame:
    """Rows (row, col, ``outs``) of ``function`` over each tile with its halo: the grid of values, NaN where none is known,
    and which cells are the raster's. Only those have a row."""

    def near(n: str) -> Column:
        return F.sequence(F.floor((F.col(n) - halo) / size), F.floor((F.col(n) + halo) / size))

    cells = df.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col(value).cast("double").alias("value"))
    cells = cells.withColumn("ty", F.explode(near("row"))).withColumn("tx", F.explode(near("col")))

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
        row, col = (table[n].to_numpy() - t * size + halo for n, t in (("row", ty), ("col", tx)))
        grid, cells = np.full((size + 2 * halo,) * 2, np.nan), np.zeros((size + 2 * halo,) * 2, bool)
        grid[row, col] = table["value"].to_numpy(zero_copy_only=False)
        cells[row, col] = True
        own = slice(halo, halo + size)
        r, c = np.nonzero(cells[own, own])
        found = function(grid, cells) if len(r) else {}
        columns = [pa.array(r + ty * size, pa.int64()), pa.array(c + tx * size, pa.int64())]
        columns += [pa.array(found[n][own, own][r, c], pa.float64(), from_pandas=True) if len(r) else pa.array([], pa.float64()) for n in outs]
        return pa.table(columns, names=["row", "col", *outs])

    return cells.groupBy("ty", "tx").applyInArrow(run, ", ".join(["row long", "col long", *(f"`{n}` double" for n in outs)]))


def box_sums(grid: np.ndarray, reach: int) -> np.ndarray:
    """The sum over the square of ``reach`` cells around each cell, by a summed-area table."""
    padded = np.pad(grid, reach)
    total = np.pad(padded.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    w = 2 * reach + 1
    return total[w:, w:] - total[:-w, w:] - total[w:, :-w] + total[:-w, :-w]


def focal_mean(grid: np.ndarray, reach: int) -> np.ndarray:
    """The mean of the known cells around each cell."""
    known = ~np.isnan(grid)
    middle = grid[known].mean() if known.any() else 0.0
    n = box_sums(known.astype(float), reach)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0.5, box_sums(np.where(known, grid - middle, 0.0), reach) / np.round(n) + middle, np.nan)


def slope_degrees(grid: np.ndarray, width: float) -> np.ndarray:
    """The slope from the eight neighbours, those beside weighing double; unknown where one of them is."""
    p = np.pad(grid, 1, constant_values=np.nan)
    at = {(i, j): p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)}
    dx = (at[-1, 1] + 2 * at[0, 1] + at[1, 1] - at[-1, -1] - 2 * at[0, -1] - at[1, -1]) / (8 * width)
    dy = (at[1, -1] + 2 * at[1, 0] + at[1, 1] - at[-1, -1] - 2 * at[-1, 0] - at[-1, 1]) / (8 * width)
    return np.where(np.isnan(grid), np.nan, np.degrees(np.arctan(np.hypot(dx, dy))))


def majority(grid: np.ndarray, reach: int) -> np.ndarray:
    """The most frequent known class around each cell, the least of equally frequent ones."""
    best, most = np.full(grid.shape, np.nan), np.zeros(grid.shape)
    for value in np.unique(grid[~np.isnan(grid)]):
        n = np.round(box_sums((grid == value).astype(float), reach))
        more = n > most
        best[more], most[more] = value, n[more]
    return best


def terrain(dem: DataFrame, value: str, width: float, reach: int = 10, size: int = TILE) -> DataFrame:
    """Slope in degrees, the mean of the (2 * reach + 1)**2 cells around, and how far a cell lies below it."""

    def measures(grid: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
        mean = focal_mean(grid, reach)
        return {"slope": slope_degrees(grid, width), "local_mean": mean, "valley_depth": np.where(mean > grid, mean - grid, np.where(np.isnan(grid), np.nan, 0.0))}

    return on_tiles(dem, value, max(reach, 1), measures, ["slope", "local_mean", "valley_depth"], size)


def interpolated(points: DataFrame, x: str, y: str, value: str, width: float, radius: float, out: str = "value") -> DataFrame:
    """The surface of inverse squared distances: each cell with a point within ``radius`` of its centre is the
    weighted mean of these points; points at the centre itself decide alone.

    A point deals its weight to the cells around it, and sums meet by cell: no cell gathers its points.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull())
    spans = {n: F.sequence(F.floor((F.col(c) - radius) / width), F.floor((F.col(c) + radius) / width)) for n, c in (("col", x), ("row", y))}
    cells = known.withColumn("col", F.explode(spans["col"])).withColumn("row", F.explode(spans["row"]))
    square = F.pow((F.col("col") + 0.5) * width - F.col(x), 2) + F.pow((F.col("row") + 0.5) * width - F.col(y), 2)
    near = cells.select("row", "col", F.col(value).cast("double").alias("z"), square.alias("d2")).where(F.col("d2") <= radius * radius)
    weight = F.when(F.col("d2") > 0, 1 / F.when(F.col("d2") > 0, F.col("d2")))
    sums = near.groupBy("row", "col").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("z")).alias("wz"), F.avg(F.when(F.col("d2") == 0, F.col("z"))).alias("here"))
    return sums.select("row", "col", F.coalesce("here", F.col("wz") / F.col("w")).alias(out))


def filled(raster: DataFrame, value: str, passes: int = 5, reach: int = 3, size: int = TILE) -> DataFrame:
    """Unknown cells of the raster take the majority around them, in passes; known ones stay. All passes run on one
    tile with a halo as wide as they can reach together."""

    def fill(grid: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
        for _ in range(passes):
            empty = np.isnan(grid) & cells
            if not empty.any():
                break
            grid = np.where(empty, majority(grid, reach), grid)
        return {value: grid}

    return on_tiles(raster, value, passes * reach, fill, [value], size)


def smoothed(raster: DataFrame, value: str, reach: int = 1, size: int = TILE) -> DataFrame:
    """Every cell of the raster takes the majority around it, its own class included."""
    return on_tiles(raster, value, reach, lambda grid, _: {value: majority(grid, reach)}, [value], size)


def polygonised(raster: DataFrame, value: str, width: float) -> DataFrame:
    """The outlines of each class's cells: rows (class, ring, path, area), holes with negative area."""
    cells = raster.where(F.col(value).isNotNull()).select(value, F.col("col").alias("bx"), F.col("row").alias("by")).distinct()
    return shapes.dissolve(shapes.squares_as_shapes(cells, width), value, "square")
