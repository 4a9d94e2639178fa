"""Shapes, surfaces, classes and factor models against plain Python on small inputs."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexagrove.functions import globe
from hexagrove.operators import classes, factors, rasters, shapes

KIND = "struct<kind:string,paths:array<array<struct<x:double,y:double>>>>"


def polygon(*points):
    return ("polygon", [[*points, points[0]]])


def square(x, y, s):
    return polygon((x, y), (x + s, y), (x + s, y + s), (x, y + s))


def floats(shape):
    """Spark takes no whole numbers for doubles."""
    return shape and (shape[0], [[(float(x), float(y)) for x, y in path] for path in shape[1]])


def meet_plainly(a, b):
    """For upright squares (x, y, s)."""
    return a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2]


def test_join_with_a_third_of_all_rows_in_one_tile(spark):
    rng = random.Random(1)
    left, right = ([(i, (50.2, 50.2, 0.1) if i % 3 == 0 else (rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice((0.5, 3, 30)))) for i in range(n)] for n in (150, 120))
    a, b = (spark.createDataFrame([(i, floats(square(*s))) for i, s in rows], f"id int, shape {KIND}").repartition(3) for rows in (left, right))
    found = shapes.spatial_join(a, b, "shape", "shape", 7.0, most=20).select("id", "right_id").collect()
    want = {(i, j) for i, s in left for j, t in right if meet_plainly(s, t)}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_shapes_that_meet(spark):
    big, ring = square(0, 0, 10), ("polygon", [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 8), (8, 8), (8, 2), (2, 2)]])
    cases = [
        (big, ("point", [[(5, 5)]]), True), (ring, ("point", [[(5, 5)]]), False), (ring, ("point", [[(1, 5)]]), True), (big, ("point", [[(10, 5)]]), True),
        (ring, square(4, 4, 1), False), (big, square(4, 4, 1), True), (("line", [[(-1, 5), (11, 5)]]), ring, True), (("line", [[(3, 5), (7, 5)]]), ring, False),
        (("line", [[(0, 0), (4, 4)]]), ("line", [[(0, 4), (4, 0)]]), True), (("line", [[(0, 0), (1, 1)]]), ("line", [[(2, 2), (3, 3)]]), False),
        (("line", []), big, False), (None, big, False),
    ]
    df = spark.createDataFrame([(floats(a), floats(b), want) for a, b, want in cases], f"a {KIND}, b {KIND}, want boolean")
    assert [r for r in df.withColumn("got", F.coalesce(shapes.intersects(F.col("a"), F.col("b")), F.lit(False))).collect() if r["got"] != r["want"]] == []


def clip_plainly(ring, cell):
    out = ring[:-1]
    for p, q in zip(cell, cell[1:]):
        new = []
        for r, s in zip(out, out[1:] + out[:1]):
            h, g = ((q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0]) for v in (r, s))
            if h >= 0:
                new.append(r)
            if h * g < 0:
                t = h / (h - g)
                new.append((r[0] + t * (s[0] - r[0]), r[1] + t * (s[1] - r[1])))
        out = new
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2


def test_overlay_with_hexagons_and_a_hole(spark):
    rng = random.Random(4)
    cells = []
    for n in range(40):
        x, y, s = rng.uniform(-2, 12), rng.uniform(-2, 12), rng.uniform(0.5, 3)
        cells.append((n, polygon(*((x + s * math.cos(k * math.pi / 3), y + s * math.sin(k * math.pi / 3)) for k in range(6)))))
    star = polygon((0, 0), (5, 2), (10, 0), (8, 5), (10, 10), (5, 8), (0, 10), (2, 5))
    hole = [(4, 4), (4, 6), (6, 6), (6, 4), (4, 4)]
    whole = ("polygon", [star[1][0], hole])
    df = spark.createDataFrame([(1, floats(whole))], f"id int, shape {KIND}")
    grid = spark.createDataFrame(cells, f"cell int, hexagon {KIND}")
    found = {r["cell"]: r["common"] for r in shapes.overlay(df, grid, "shape", "hexagon", 3.0).collect()}
    for n, (_, paths) in cells:
        want = clip_plainly(star[1][0], paths[0]) - clip_plainly(hole[::-1], paths[0])
        assert found.get(n, 0.0) == pytest.approx(want, abs=1e-9)


def test_area_shares_exceed_one_where_polygons_overlap(spark):
    box = spark.createDataFrame([(14.0, 54.9, 15.0, 55.4)], "x0 double, y0 double, x1 double, y1 double")
    cells = globe.cells_in_box(box, 5).select("cell")
    ring = F.array(*(shapes.equal_area(F.lit(x), F.lit(y)) for x, y in ((13.0, 54.0), (16.0, 54.0), (16.0, 56.0), (13.0, 56.0), (13.0, 54.0))))
    two = spark.range(2).select(shapes.shape("polygon", F.array(ring)).alias("p"))
    got = shapes.area_share(two, cells, "p").collect()
    assert len(got) > 5 and all(r["share"] == pytest.approx(2.0, rel=1e-9) for r in got)
    none = shapes.area_share(two.where("false"), cells, "p").collect()
    assert {r["share"] for r in none} == {0.0}


def regions(cells):
    """Parts of cells that share sides, and holes: parts of the rest that meet at corners too and don't reach the rim."""
    def parts(of, steps):
        left, n = set(of), []
        while left:
            stack, part = [left.pop()], set()
            while stack:
                x, y = stack.pop()
                part.add((x, y))
                for a, b in steps:
                    if (x + a, y + b) in left:
                        left.discard((x + a, y + b))
                        stack.append((x + a, y + b))
            n.append(part)
        return n

    four = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    rest = {(x, y) for x in range(-1, 16) for y in range(-1, 16)} - cells
    return len(parts(cells, four)), sum((-1, -1) not in p for p in parts(rest, eight))


@pytest.mark.parametrize("seed", [1, 2])
def test_dissolve_counts_parts_and_holes(spark, seed):
    rng = random.Random(seed)
    groups = {g: {(rng.randrange(15), rng.randrange(15)) for _ in range(n)} for g, n in (("a", 20), ("b", 150), ("c", 400))}
    groups["d"] = {(x, y) for x in range(15) for y in range(15)} - {(5, 5), (6, 6), (9, 2)}
    rows = [(g, x, y) for g, cells in groups.items() for x, y in cells]
    df = shapes.squares_as_shapes(spark.createDataFrame(rows, "g string, bx long, by long").repartition(3), 2.0)
    found = shapes.dissolve(df, "g", "square").collect()
    for g, cells in groups.items():
        own = [r for r in found if r["g"] == g]
        assert sum(r["area"] for r in own) == pytest.approx(4 * len(cells))
        assert (sum(r["area"] > 0 for r in own), sum(r["area"] < 0 for r in own)) == regions(cells)
        for r in own:
            path = [(p["x"], p["y"]) for p in r["path"]]
            assert path[0] == path[-1] and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 2 for a, b in zip(path, path[1:]))


def test_dissolved_cells_of_the_globe(spark):
    start = spark.createDataFrame([(int("85283473fffffff", 16),)], "cell long")
    cells = globe.disk(start, "cell", 5, 2).select(F.lit(1).alias("g"), F.col("member").alias("cell"), "steps")
    whole = shapes.dissolve(shapes.cell_shapes(cells), "g", "hexagon", digits=3).collect()
    ring = shapes.dissolve(shapes.cell_shapes(cells.where("steps = 2")), "g", "hexagon", digits=3).collect()
    assert len(whole) == 1 and len(whole[0]["path"]) == 31
    assert sorted(len(r["path"]) for r in ring) == [19, 31] and sum(r["area"] < 0 for r in ring) == 1


def test_buffer_near_the_sampled_distance(spark):
    line = ("line", [[(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)]])
    df = spark.createDataFrame([(1, line), (2, ("point", [[(0.0, 0.0)]])), (2, None)], f"g int, shape {KIND}")
    found = {r["g"]: r["a"] for r in shapes.buffered(df, "g", "shape", 2.0, 0.05).groupBy("g").agg(F.sum("area").alias("a")).collect()}
    assert found[2] == pytest.approx(math.pi * 4, rel=0.01)
    # Two strips and three quarters of a disc at the bend, where the strips share a square.
    assert found[1] == pytest.approx(4 * 15 + 4 * math.pi - (4 - math.pi), rel=0.01)


def test_simplified_paths_stay_near(spark):
    rng = random.Random(6)
    rows = []
    for i in range(20):
        at, path = (0.0, 0.0), []
        for _ in range(300):
            at = (at[0] + rng.uniform(-0.2, 1), at[1] + rng.uniform(-1, 1))
            path.append(at)
        rows.append((i, path))
    rows += [(50, None), (51, []), (52, [(1.0, 1.0)]), (53, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "id int, path array<struct<x:double,y:double>>")
    for r in shapes.simplified(df, "path", 0.8).collect():
        before, after = dict(rows)[r["id"]], r["path"] and [tuple(p) for p in r["path"]]
        if r["id"] >= 50:
            assert (after or None) == (before or None)
            continue
        assert len(after) < len(before) and after[0] == before[0] and after[-1] == before[-1] and set(after) <= set(before)
        for p in before:
            near = min(segment_distance(p, a, b) for a, b in zip(after, after[1:]))
            assert near <= 0.8 + 1e-9


def segment_distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


@pytest.mark.parametrize("size", [7, 64])
def test_tiles_leave_no_borders(spark, size):
    rng = np.random.default_rng(3)
    grid = rng.uniform(0, 100, (40, 33))
    grid[rng.random(grid.shape) < 0.2] = np.nan
    rows = [(i - 5, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(grid)]
    df = spark.createDataFrame(rows, "row long, col long, z double").repartition(4)
    out = {(r["row"] + 5, r["col"]): r for r in rasters.terrain(df, "z", 10.0, reach=4, size=size).collect()}
    assert len(out) == grid.size
    for i, j in itertools.product(range(40), range(33)):
        part = grid[max(0, i - 4) : i + 5, max(0, j - 4) : j + 5]
        assert out[i, j]["local_mean"] == pytest.approx(np.nanmean(part))
        near = grid[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
        assert (out[i, j]["slope"] is None) == (near.shape != (3, 3) or bool(np.isnan(near).any()))
    fills = {(r["row"] + 5, r["col"]): r["z"] for r in rasters.filled(df.withColumn("z", F.floor(F.col("z") / 30).cast("double")), "z", passes=2, reach=1, size=size).collect()}
    plain = np.floor(grid / 30)
    for _ in range(2):
        new = plain.copy()
        for i, j in zip(*np.nonzero(np.isnan(plain))):
            part = plain[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            values, n = np.unique(part[~np.isnan(part)], return_counts=True)
            if len(values):
                new[i, j] = values[n.argmax()]
        plain = new
    assert all((v is None and np.isnan(plain[k])) or v == plain[k] for k, v in fills.items())


def test_natural_breaks_equal_exhaustive_search(spark):
    rng = random.Random(2)
    values = [round(rng.choice((1, 5, 9)) + rng.gauss(0, 1), 1) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    slots = classes.histogram(df, "v")
    distinct = sorted(set(values))

    def cost(breaks):
        groups = [[v for v in values if a < v <= b] for a, b in zip([-math.inf, *breaks], [*breaks, math.inf])]
        return sum(len(g) * np.var(g) for g in groups)

    for k in (1, 2, 3, 4):
        found = classes.natural_breaks(slots, k)
        best = min(cost(b) for b in itertools.combinations(distinct[:-1], k - 1))
        assert found[0] == distinct[0] and found[-1] == distinct[-1] and cost(found[1:-1]) == pytest.approx(best)
    assert classes.natural_breaks([], 3) == [] and classes.natural_breaks(slots[:2], 5) == [distinct[0], distinct[0], distinct[1]]
    few = classes.histogram(df, "v", most=10)
    assert len(few) <= 10 and sum(n for _, n, _ in few) == 60


def test_quantile_breaks(spark):
    rng = np.random.default_rng(9)
    values = np.round(rng.exponential(5, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    found = classes.quantile_breaks(df, "v", 5)
    assert found == pytest.approx(np.unique(np.quantile(values, np.linspace(0, 1, 6))))
    bins = {r["bin"]: r["n"] for r in classes.binned(df, "v", found).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert bins == {None: 1, **{i + 1: int(((values <= b) & ((values > a) if i else True)).sum()) for i, (a, b) in enumerate(zip(found, found[1:]))}}


def planted(n=4000):
    rng = np.random.default_rng(5)
    phi = np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]])
    factor = rng.standard_normal((n, 3)) @ np.linalg.cholesky(phi).T
    loading = np.kron(np.eye(3), np.array([[0.8], [0.7], [0.9], [0.6]]))
    return factor @ loading.T + rng.standard_normal((n, 12)) * np.sqrt(1 - (loading**2).sum(axis=1)), loading, phi


def test_oblique_structure_is_found():
    x, loading, phi = planted()
    turned, between = factors.oblimin(factors.principal_axes(np.corrcoef(x.T), 3))
    order = [int(np.abs(turned[4 * k : 4 * k + 4]).sum(axis=0).argmax()) for k in range(3)]
    assert sorted(order) == [0, 1, 2]
    sign = np.sign(turned[[0, 4, 8], order])
    assert np.abs(turned[:, order] * sign - loading).max() < 0.07
    assert np.abs(between[np.ix_(order, order)] * np.outer(sign, sign) - phi).max() < 0.07


def test_fit_improves_up_to_the_planted_count(spark):
    x, _, _ = planted()
    df = spark.createDataFrame([(row.tolist(),) for row in x[:2000]], "v array<double>")
    found = {}
    for r in factors.factor_sweep(df, "v", range(1, 6)).collect():
        found.setdefault(r["metric"], {})[r["n_factors"]] = r["value"]
    assert found["TLI"][1] < found["TLI"][2] < found["TLI"][3] and found["TLI"][3] > 0.99
    assert found["RMSEA"][3] < 0.02 < found["RMSEA"][2] and min(found["BIC"], key=found["BIC"].get) == 3
    assert found["rms"][3] < 0.02 and found["fit_off"][3] > 0.99


def test_scores_have_the_factors_correlation(spark):
    x, _, _ = planted(500)
    matrix = np.corrcoef(x.T)
    turned, phi = factors.oblimin(factors.principal_axes(matrix, 3))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(-1, None)], "id int, v array<double>")
    out = factors.scores(df, "id", "v", factors.score_weights(matrix, turned, phi)).toPandas()
    assert len(out) == 500 and np.abs(np.corrcoef(out[["F1", "F2", "F3"]].T) - phi).max() < 1e-9
    assert np.abs(out[["F1", "F2", "F3"]].std() - 1).max() < 1e-9


def test_equal_shapes_are_tested_once(spark):
    """Thirty copies of a plot and twenty of a road are one pair of shapes, and all 600 pairs of rows come back."""
    ring = "array(struct(0D AS x, 0D AS y), struct(4D AS x, 0D AS y), struct(4D AS x, 4D AS y), struct(0D AS x, 0D AS y))"
    left = spark.range(30).selectExpr("id AS k", f"struct('polygon' AS kind, array({ring}) AS paths) AS at")
    right = spark.range(20).selectExpr("id AS k", "struct('line' AS kind, array(array(struct(1D AS x, 0.5D AS y), struct(3D AS x, 0.5D AS y))) AS paths) AS at")
    seen = []

    def found(pairs, one, two):
        seen.append(pairs.count())
        return shapes.meeting(pairs, one, two)

    rows = shapes.shape_pairs(left, right, "at", "at", 1.0, 5, found).select("k", "right_k").collect()
    assert seen == [1] and {tuple(r) for r in rows} == {(a, b) for a in range(30) for b in range(20)} and len(rows) == 600
