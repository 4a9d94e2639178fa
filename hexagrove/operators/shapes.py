"""Shapes as columns: intersection joins over tiles, overlay areas, dissolving, buffers, simplification.

A shape is a struct (kind, paths): ``point``, ``line`` or ``polygon``, and arrays of (x, y). Polygon paths are closed rings:
outer rings anticlockwise, holes clockwise (``oriented`` turns a single polygon's rings so). Coordinates are planar;
``equal_area`` turns degrees into metres in which areas hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions import globe
from hexagrove.functions.globe import inside
from hexagrove.operators.lineage import written

EARTH_M = globe.EARTH_KM * 1000
PATHS = "array<array<struct<x:double,y:double>>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shape(kind: str | Column, paths: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), paths.cast(PATHS).alias("paths"))


def equal_area(lng: Column, lat: Column) -> Column:
    """Metres of the cylindrical equal-area projection."""
    return F.struct((F.radians(lng) * EARTH_M).alias("x"), (F.sin(F.radians(lat)) * EARTH_M).alias("y"))


def _steps(path: Column) -> Column:
    return F.when(F.size(path) > 1, F.sequence(F.lit(1), F.size(path) - 1)).otherwise(F.array().cast("array<int>"))


def ring_area(ring: Column) -> Column:
    """The signed area of a closed ring, positive anticlockwise; places relative to the first keep digits."""
    o = F.get(ring, F.lit(0))

    def add(acc: Column, k: Column) -> Column:
        a, b = F.get(ring, k - 1), F.get(ring, k)
        return acc + (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

    return F.aggregate(_steps(ring), F.lit(0.0), add) / 2


def area(paths: Column) -> Column:
    """The area of rings by their direction."""
    return F.aggregate(paths, F.lit(0.0), lambda acc, ring: acc + ring_area(ring))


def oriented(paths: Column) -> Column:
    """The first ring anticlockwise, the others clockwise."""
    return F.transform(paths, lambda ring, i: F.when((ring_area(ring) > 0) == (i == 0), ring).otherwise(F.reverse(ring)))


def box(paths: Column) -> Column:
    """(x0, y0, x1, y1) of all points; null without any."""
    flat = F.flatten(paths)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.when(F.size(flat) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _between(a: Column, b: Column, c: Column, d: Column, n: str) -> Column:
    return (F.greatest(a[n], b[n]) >= F.least(c[n], d[n])) & (F.greatest(c[n], d[n]) >= F.least(a[n], b[n]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d share a point, ends included."""
    return _between(a, b, c, d, "x") & _between(a, b, c, d, "y") & (_side(a, b, c) * _side(a, b, d) <= 0) & (_side(c, d, a) * _side(c, d, b) <= 0)


def _segments(paths: Column) -> Column:
    """(a, b) of all consecutive points; a single point is a segment of no length."""

    def of(path: Column) -> Column:
        pairs = F.transform(_steps(path), lambda k: F.struct(F.get(path, k - 1).alias("a"), F.get(path, k).alias("b")))
        return F.when(F.size(path) == 1, F.array(F.struct(path[0].alias("a"), path[0].alias("b")))).otherwise(pairs)

    return F.flatten(F.transform(paths, of))


def intersects(one: Column, two: Column) -> Column:
    """Whether two shapes share a point: edges meet, or one polygon holds the other's first point."""

    def meet(pair: Column) -> Column:
        return F.exists(pair["s"], lambda s: F.exists(pair["t"], lambda t: segments_meet(s["a"], s["b"], t["a"], t["b"])))

    def holds(outer: Column, other: Column) -> Column:
        p = F.get(F.get(other["paths"], F.lit(0)), F.lit(0))
        return (outer["kind"] == "polygon") & F.coalesce(inside(outer["paths"], p["x"], p["y"]), F.lit(False))

    pair = F.struct(_segments(one["paths"]).alias("s"), _segments(two["paths"]).alias("t"))
    return F.coalesce(_let(pair, meet), F.lit(False)) | holds(one, two) | holds(two, one)


def tile_join(left: DataFrame, right: DataFrame, left_shape: str, right_shape: str, tile: float, most: int = 2000) -> DataFrame:
    """Pairs of rows whose boxes overlap, each once; columns of ``right`` that clash are prefixed ``right_``.

    Shapes lie in all tiles that their boxes touch, and a pair is reported in the tile of the lower left corner of the
    boxes' common part. A tile with more than ``most`` rows is cut into smaller ones by its number of rows, but to no finer
    ones than its boxes are wide by their quadratic mean: a row thus lies in four of them on average at most. What is still
    crowded, as many rows at one place, is dealt by salt: its left rows to one part each, its right ones to all.
    """
    right = right.select(*(F.col(f"`{c}`").alias(f"right_{c}" if c in left.columns else c) for c in right.columns))
    right_shape = f"right_{right_shape}" if right_shape in left.columns else right_shape

    def boxed(df: DataFrame, at: str, side: str) -> DataFrame:
        own = [F.col(f"`{c}`").alias(f"{side}{n}") for n, c in enumerate(df.columns)]
        df = df.select(*own, box(F.col(at)["paths"]).alias("b")).where("b is not null")
        span = {n: F.floor(F.col("b")[n] / tile) for n in ("x0", "y0", "x1", "y1")}
        df = df.withColumn("tx", F.explode(F.sequence(span["x0"], span["x1"])))
        return df.withColumn("ty", F.explode(F.sequence(span["y0"], span["y1"])))

    l, r = boxed(left, left_shape, "l"), boxed(right, right_shape, "r")
    wide = F.least(F.greatest(*(F.col("b")[n + "1"] - F.col("b")[n + "0"] for n in "xy")) / tile, F.lit(1.0)).alias("wide")
    load = l.select("tx", "ty", wide).union(r.select("tx", "ty", wide)).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("wide") * F.col("wide"))).alias("wide"))
    # At most 2**16 cuts a side, so that the finer tiles' numbers stay exact.
    finest = F.when(F.col("wide") > 0, F.floor(-F.log2("wide"))).otherwise(16)
    cuts = load.where(F.col("n") > most).select("tx", "ty", F.pow(F.lit(2.0), F.least(F.ceil(F.log2(F.col("n") / most) / 2), finest, F.lit(16))).cast("long").alias("cut"))
    cuts = written(cuts)

    def cut_up(df: DataFrame) -> DataFrame:
        df = df.join(cuts, ["tx", "ty"], "left").withColumn("cut", F.coalesce("cut", F.lit(1).cast("long")))
        low = {n: F.greatest(F.floor(F.col("b")[n + "0"] / tile * F.col("cut")), F.col("t" + n) * F.col("cut")) for n in "xy"}
        high = {n: F.least(F.floor(F.col("b")[n + "1"] / tile * F.col("cut")), F.col("t" + n) * F.col("cut") + F.col("cut") - 1) for n in "xy"}
        return df.withColumn("sx", F.explode(F.sequence(low["x"], high["x"]))).withColumn("sy", F.explode(F.sequence(low["y"], high["y"])))

    l, r = cut_up(l), cut_up(r)
    keys = ["tx", "ty", "sx", "sy"]
    crowded = written(l.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1"))

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        df = df.join(crowded, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        return df.withColumn("salt", salt).drop("parts", "cut")

    l = salted(l, F.pmod(F.xxhash64(*(f"l{n}" for n in range(len(left.columns)))), F.col("parts")).cast("int")).withColumnRenamed("b", "lb")
    r = salted(r, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("b", "rb")
    pairs = l.join(r, [*keys, "salt"]).join(cuts, ["tx", "ty"], "left")
    cut = F.coalesce("cut", F.lit(1).cast("long"))
    overlap = F.lit(True)
    for n in "xy":
        corner = F.greatest(F.col("lb")[n + "0"], F.col("rb")[n + "0"])
        overlap = overlap & (corner <= F.least(F.col("lb")[n + "1"], F.col("rb")[n + "1"])) & (F.floor(corner / tile) == F.col("t" + n)) & (F.least(F.greatest(F.floor(corner / tile * cut), F.col("t" + n) * cut), (F.col("t" + n) + 1) * cut - 1) == F.col("s" + n))
    both = [F.col(f"{side}{n}").alias(c) for side, df in (("l", left), ("r", right)) for n, c in enumerate(df.columns)]
    return pairs.where(overlap).select(*both)


def numbered(df: DataFrame, at: str, name: str) -> DataFrame:
    """The distinct shapes of a column, numbered: columns ``name`` and ``name`` + "_shape"."""
    once = df.where(F.col(at).isNotNull()).select(F.col(at).alias(f"{name}_shape")).distinct()
    return written(once.withColumn(name, F.monotonically_increasing_id()))


def shape_pairs(left: DataFrame, right: DataFrame, left_shape: str, right_shape: str, tile: float, most: int, found: Callable[[DataFrame, Column, Column], DataFrame]) -> DataFrame:
    """The rows of ``tile_join`` that ``found`` keeps of its pairs of shapes, with the columns that it adds.

    Equal shapes are one in the join and in ``found``; their rows come back at the end, by number. Many rows at one place
    thus cost their own pairs only, and no pair moves with its shapes.
    """
    clash = set(left.columns)
    right = right.select(*(F.col(f"`{c}`").alias(f"right_{c}" if c in clash else c) for c in right.columns))
    right_shape = f"right_{right_shape}" if right_shape in clash else right_shape
    l, r = numbered(left, left_shape, "__l"), numbered(right, right_shape, "__r")
    pairs = found(tile_join(l, r, "__l_shape", "__r_shape", tile, most), F.col("__l_shape"), F.col("__r_shape")).drop("__l_shape", "__r_shape")
    of_left = left.join(l, F.col(left_shape) == F.col("__l_shape")).drop("__l_shape")
    of_right = right.join(r, F.col(right_shape) == F.col("__r_shape")).drop("__r_shape")
    added = [c for c in pairs.columns if c not in ("__l", "__r")]
    return of_left.join(pairs, "__l").join(of_right, "__r").select(*(F.col(f"`{c}`") for c in (*left.columns, *right.columns, *added)))


def meeting(pairs: DataFrame, one: Column, two: Column) -> DataFrame:
    return pairs.where(intersects(one, two))


def spatial_join(left: DataFrame, right: DataFrame, left_shape: str, right_shape: str, tile: float, most: int = 2000) -> DataFrame:
    """Pairs of rows whose shapes share a point; without order, each pair of rows once."""
    return shape_pairs(left, right, left_shape, right_shape, tile, most, meeting)


def spatial_semi(left: DataFrame, right: DataFrame, key: str, left_shape: str, right_shape: str, tile: float) -> DataFrame:
    """Rows of ``left`` (unique by ``key``) that share a point with any shape of ``right``."""
    l, r = numbered(left, left_shape, "__l"), numbered(right, right_shape, "__r")
    hit = meeting(tile_join(l, r, "__l_shape", "__r_shape", tile), F.col("__l_shape"), F.col("__r_shape")).select("__l").distinct()
    hit = l.join(hit, "__l", "left_semi").select("__l_shape")
    return left.join(hit, F.col(left_shape) == F.col("__l_shape"), "left_semi")


def clipped(ring: Column, convex: Column) -> Column:
    """A closed ring cut to an anticlockwise closed convex ring, by one edge after another; where parts fall asunder, they
    stay joined along the cuts, so that areas hold."""

    def cut(open_ring: Column, e: Column) -> Column:
        p, q = e["a"], e["b"]

        def height(r: Column) -> Column:
            return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

        def piece(r: Column, k: Column) -> Column:
            def kept(v: Column) -> Column:
                t = v["h"] / (v["h"] - v["g"])
                at = F.struct((r["x"] + t * (v["s"]["x"] - r["x"])).alias("x"), (r["y"] + t * (v["s"]["y"] - r["y"])).alias("y"))
                own = F.when(v["h"] >= 0, F.array(r)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
                return F.when((v["h"] > 0) != (v["g"] > 0), F.when((v["h"] != 0) & (v["g"] != 0), F.concat(own, F.array(at))).otherwise(own)).otherwise(own)

            s = F.get(open_ring, (k + 1) % F.size(open_ring))
            return _let(F.struct(s.alias("s"), height(r).alias("h"), height(s).alias("g")), kept)

        return F.flatten(F.transform(open_ring, piece))

    edges = F.transform(_steps(convex), lambda k: F.struct(F.get(convex, k - 1).alias("a"), F.get(convex, k).alias("b")))
    left = F.aggregate(edges, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), cut)
    return _let(left, lambda r: F.when(F.size(r) > 2, F.concat(r, F.array(r[0]))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))


def overlay(left: DataFrame, cells: DataFrame, left_shape: str, cell_shape: str, tile: float, out: str = "common") -> DataFrame:
    """Pairs of polygons and convex cells with the area that they have in common, above 0."""

    def shared(pairs: DataFrame, polygon: Column, cell: Column) -> DataFrame:
        def with_ring(acc: Column, ring: Column) -> Column:
            return acc + _let(clipped(ring, cell["paths"][0]), ring_area)

        # An array of one, so that an area is computed once for its test and its value.
        areas = F.array(F.aggregate(polygon["paths"], F.lit(0.0), with_ring))
        return pairs.select("*", F.explode(F.filter(areas, lambda a: a > 1e-12)).alias(out))

    return shape_pairs(left, cells, left_shape, cell_shape, tile, 2000, shared)


def cell_shapes(df: DataFrame, cell: str = "cell", out: str = "hexagon") -> DataFrame:
    """``df`` with the polygons of globe cells in equal-area metres."""
    df = globe.with_boundary(df, cell, out)
    return df.withColumn(out, shape("polygon", F.array(F.transform(out, lambda p: equal_area(p["lng"], p["lat"])))))


def area_share(polygons: DataFrame, cells: DataFrame, polygon: str, cell: str = "cell", tile: float = 20_000.0) -> DataFrame:
    """For each cell, the area of all polygons in it over its own: above 1 where they overlap, 0 without any. Polygons
    are in equal-area metres."""
    hexagons = cell_shapes(cells.select(cell).distinct(), cell)
    common = overlay(polygons.select(F.col(polygon).alias("polygon")), hexagons, "polygon", "hexagon", tile)
    sums = common.groupBy(cell).agg(F.sum("common").alias("covered"))
    own = hexagons.select(cell, area(F.col("hexagon")["paths"]).alias("cell_area"))
    return own.join(sums, cell, "left").select(cell, (F.coalesce("covered", F.lit(0.0)) / F.col("cell_area")).alias("share"))


def dissolve(polygons: DataFrame, group: str, polygon: str, digits: int = 6) -> DataFrame:
    """The outlines of each group's union of polygons that meet edge to edge (cells, or parts cut from one whole): rows
    (group, ring, path, area), holes with negative area.

    Points are equal when they agree to ``digits`` decimals. Every edge goes in its polygon's direction; one that
    another polygon goes the other way cancels. At each corner of those left an outline goes on by the sharpest left turn,
    so that parts that touch in a corner stay apart, and holes that do are one ring. Rings are found by pointer jumping: after k rounds each
    edge knows the least edge of the next 2**k on its ring, and how far it is. A group of any size is spread by edges.
    """

    def rounded(p: Column) -> Column:
        return F.struct((F.round(p["x"], digits) + 0.0).alias("x"), (F.round(p["y"], digits) + 0.0).alias("y"))

    edges = polygons.select(F.col(group).alias("g"), F.explode(_segments(F.col(polygon)["paths"])).alias("e")).select("g", rounded(F.col("e.a")).alias("a"), rounded(F.col("e.b")).alias("b")).where("a <> b")
    net = edges.groupBy("g", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("n"))
    left = net.where("n <> 0").select("g", F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("high")).alias("a"), F.when(F.col("n") > 0, F.col("high")).otherwise(F.col("low")).alias("b"))
    left = written(left.withColumn("id", F.monotonically_increasing_id()))
    turn = F.atan2(F.col("t.b.y") - F.col("t.a.y"), F.col("t.b.x") - F.col("t.a.x")) - F.atan2(F.col("s.b.y") - F.col("s.a.y"), F.col("s.b.x") - F.col("s.a.x"))
    # Left turns count most, straight back least: a turn of pi is a way back.
    turn = F.pmod(turn + math.pi + 1e-9, F.lit(2 * math.pi))
    follows = left.alias("s").join(left.alias("t"), (F.col("s.g") == F.col("t.g")) & (F.col("s.b") == F.col("t.a"))).groupBy(F.col("s.id").alias("id")).agg(F.max_by(F.col("t.id"), turn).alias("next"))
    rings = written(follows.select("id", "next", F.col("id").alias("least"), F.lit(0).cast("long").alias("steps")))
    reach = 1
    while True:
        ahead = rings.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("least").alias("other"), F.col("steps").alias("more"))
        nearer = F.col("other") < F.col("least")
        after = rings.join(ahead, "next").select("id", F.col("then").alias("next"), F.least("least", "other").alias("least"), F.when(nearer, F.col("more") + reach).otherwise(F.col("steps")).alias("steps"), nearer.alias("changed"))
        rings, reach = written(after), reach * 2
        if not rings.where("changed").limit(1).count():
            break
        rings = rings.drop("changed")
    # Steps to the least edge fall along the ring; the least edge itself comes first.
    placed = left.join(rings.select("id", "least", "steps"), "id")
    path = F.sort_array(F.collect_list(F.struct(F.when(F.col("steps") == 0, F.lit(-(2**62))).otherwise(-F.col("steps")).alias("k"), F.col("a"))))
    out = placed.groupBy("g", "least").agg(F.transform(path, lambda p: p["a"]).alias("path"))
    out = out.withColumn("path", F.concat("path", F.slice("path", 1, 1)))
    return out.select(F.col("g").alias(group), F.col("least").alias("ring"), "path", ring_area(F.col("path")).alias("area"))


def distance_to(paths: Column, x: Column, y: Column) -> Column:
    """The distance of a point from the nearest point of the paths; null without any."""

    def to(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.when(size > 0, size)))).otherwise(0.0)
        return F.hypot(x - s["a"]["x"] - t * dx, y - s["a"]["y"] - t * dy)

    return F.array_min(F.transform(_segments(paths), to))


def within(one: Column, x: Column, y: Column, distance: float) -> Column:
    """Whether a point lies in a shape or no further from it than ``distance``."""
    return F.coalesce(distance_to(one["paths"], x, y) <= distance, F.lit(False)) | ((one["kind"] == "polygon") & F.coalesce(inside(one["paths"], x, y), F.lit(False)))


def buffer_squares(shapes: DataFrame, group: str, at: str, distance: float, size: float) -> DataFrame:
    """The squares of a grid (group, bx, by), each once, whose centres lie within ``distance`` of any shape of the group."""
    b = box(F.col(at)["paths"])
    spans = {n: F.floor((b[n] + d) / size) for n, d in (("x0", -distance), ("y0", -distance), ("x1", distance), ("y1", distance))}
    near = shapes.where(b.isNotNull()).select(group, at).distinct().withColumn("bx", F.explode(F.sequence(spans["x0"], spans["x1"]))).withColumn("by", F.explode(F.sequence(spans["y0"], spans["y1"])))
    return near.where(within(F.col(at), (F.col("bx") + 0.5) * size, (F.col("by") + 0.5) * size, distance)).select(group, "bx", "by").distinct()


def squares_as_shapes(df: DataFrame, size: float, out: str = "square") -> DataFrame:
    def corner(dx: int, dy: int) -> Column:
        return F.struct(((F.col("bx") + dx) * size).alias("x"), ((F.col("by") + dy) * size).alias("y"))

    return df.withColumn(out, shape("polygon", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))))


def buffered(shapes: DataFrame, group: str, at: str, distance: float, size: float) -> DataFrame:
    """The outlines of each group's buffer, on a grid of squares of ``size``: rows (group, ring, path, area)."""
    return dissolve(squares_as_shapes(buffer_squares(shapes, group, at, distance, size), size), group, "square")


def _kept(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a path stay: those furthest from the chords between kept ones, beyond the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        size = float(chord @ chord)
        t = np.clip(rest @ chord / size, 0, 1) if size else np.zeros(len(rest))
        off = np.hypot(*(rest - t[:, None] * chord).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(df: DataFrame, path: str, tolerance: float) -> DataFrame:
    """``df`` with fewer points in ``path``: none that was left out lies further than ``tolerance`` from the new path.
    The ends stay; a null or short path stays as it is."""
    place = df.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(path)
            out = []
            for row in column:
                points = row.as_py()
                if points and len(points) > 2:
                    stay = _kept(np.array([(p["x"], p["y"]) for p in points]), tolerance)
                    points = [p for p, s in zip(points, stay) if s]
                out.append(points)
            yield batch.set_column(place, batch.schema.field(path), pa.array(out, column.type))

    return df.mapInArrow(run, df.schema)
