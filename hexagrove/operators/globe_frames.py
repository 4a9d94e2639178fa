"""Frames of cells on the globe: map frames, points and samples by cell, zones, rings, buffers, schematic disks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions import globe, hexgrid
from hexagrove.operators import shapes, zones
from hexagrove.operators.lineage import written


def is_cell(cell: Column) -> Column:
    """Whether a number is a cell: its kind, a base cell that exists, digits up to its resolution and sevens after them."""
    res = hexgrid.resolution(cell)
    digit = lambda r: F.call_function("shiftrightunsigned", cell, (15 - r) * 3).bitwiseAND(hexgrid.long(7))
    fits = F.forall(F.sequence(F.lit(1), F.lit(15)), lambda r: (digit(r) == 7) == (r > res))
    return F.coalesce((F.shiftrightunsigned(cell, 59).bitwiseAND(hexgrid.long(31)) == 1) & (F.shiftrightunsigned(cell, 45).bitwiseAND(hexgrid.long(127)) < 122) & fits, F.lit(False))


def map_frame(df: DataFrame, cell: str = "cell") -> DataFrame:
    """``df`` with lat, lng, ring and area_km2 of each cell; rows without a valid cell go."""
    out = globe.with_boundary(globe.with_centre(df.where(is_cell(F.col(cell))), cell), cell, "ring")
    metres = F.transform("ring", lambda p: shapes.equal_area(p["lng"], p["lat"]))
    return out.withColumn("area_km2", shapes.ring_area(metres) / 1e6)


def points_per_cell(points: DataFrame, grid: DataFrame, level: int, value: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Count, sum, largest and spread of points in each cell of the grid; cells without any get 0."""
    hits = globe.with_cell(points, F.col(lat), F.col(lng), level, "cell").groupBy("cell")
    sums = hits.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"), (F.max(value) - F.min(value)).alias("spread"))
    return grid.select("cell").distinct().join(sums, "cell", "left").fillna(0, ["n"]).fillna(0.0, ["total", "top", "spread"])


def class_shares(samples: DataFrame, level: int, cls: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(cell, class, n, share, dominant) of samples; unknown classes count for nothing, and of equal classes the least is dominant."""
    counts = globe.with_cell(samples.where(F.col(cls).isNotNull()), F.col(lat), F.col(lng), level, "cell").groupBy("cell", F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("cell").agg(F.sum("n").alias("total"), F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("first"))
    return counts.join(whole, "cell").select("cell", "class", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("class") == F.col("first")).alias("dominant"))


def cell_zones(cells: DataFrame, level: int, cls: str = "cls") -> DataFrame:
    """(cell, zone, zone_size): components of neighbouring cells of one class; the zone is its least cell."""
    own = written(cells.select("cell", F.col(cls).alias("cls")).where("cell is not null and cls is not null").distinct())
    near = globe.neighbours(own, "cell", level, "b").select(F.col("cell").alias("a"), "b", "cls")
    edges = written(near.join(own.select(F.col("cell").alias("b"), "cls"), ["b", "cls"]).select("a", "b"))
    labels = zones.spread_labels(edges)
    zoned = own.join(labels, own["cell"] == labels["root"], "left").select("cell", F.coalesce("zone", "cell").alias("zone"))
    return zoned.join(zoned.groupBy("zone").agg(F.count(F.lit(1)).alias("zone_size")), "zone").select("cell", "zone", "zone_size")


def cell_rings(cells: DataFrame, seeds: DataFrame, level: int, most: int) -> DataFrame:
    """(cell, ring): steps over the given cells from the nearest seed, up to ``most``; a round takes the last ring's neighbours."""
    grid = written(cells.select("cell").distinct())
    found = [written(grid.join(seeds.select("cell").distinct(), "cell", "left_semi").withColumn("ring", F.lit(0)))]
    for ring in range(1, most + 1):
        near = globe.neighbours(found[-1].select("cell"), "cell", level, "next").select(F.col("next").alias("cell")).distinct()
        before = found[-1] if len(found) == 1 else found[-1].unionByName(found[-2])
        found.append(written(grid.join(near, "cell", "left_semi").join(before, "cell", "left_anti").withColumn("ring", F.lit(ring))))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def metres_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * shapes.EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def buffer_share(points: DataFrame, metres: float, level: int, fine: int, group: str) -> DataFrame:
    """(group, cell, share_pct): the share of each cell's children at ``fine`` with the centre within ``metres`` of a point of
    the group (group, lat, lng). A child near many points counts once; cells without any are left out."""
    reach = math.degrees(metres / shapes.EARTH_M)
    near_pole = F.least(F.abs(F.col("lat")) + reach, F.lit(89.0))
    wide = reach / F.cos(F.radians(near_pole)) * 1.01
    once = points.select(group, "lat", "lng").distinct()
    boxes = once.select(F.col(group).alias("g"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), (F.col("lng") - wide).alias("x0"), (F.col("lat") - reach * 1.01).alias("y0"), (F.col("lng") + wide).alias("x1"), (F.col("lat") + reach * 1.01).alias("y1"))
    cells = globe.cells_in_box(boxes, fine, "child").where(metres_between(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")) <= metres)
    covered = cells.select("g", "child").distinct()
    counted = covered.groupBy("g", hexgrid.parent(F.col("child"), level).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("g").alias(group), "cell", F.least(F.lit(100.0), F.col("n") * 100.0 / hexgrid.child_count(level, fine)).alias("share_pct"))


def schematic_disk(centres: DataFrame, level: int, most: int) -> DataFrame:
    """(cell, member, place): around each centre as many cells as its need ``n`` asks for, by steps and then by number; needs are at
    most ``most``, which bounds the disk."""
    k = 0
    while 1 + 3 * k * (k + 1) < most:
        k += 1
    around = globe.disk(centres, "cell", level, k)
    near = around.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("steps", "member"))).alias("all"))
    listed = centres.select("cell", F.least(F.col("n"), F.lit(most)).alias("n")).join(near, "cell")
    return listed.select("cell", F.posexplode(F.slice("all", 1, F.greatest(F.col("n"), F.lit(0)).cast("int"))).alias("place", "e")).select("cell", "e.member", (F.col("place") + 1).alias("place"))
