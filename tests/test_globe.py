"""Cells on the globe against published cells, and by what must hold everywhere, pentagons included."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from hexagrove.functions import globe, hexgrid

# Published examples of the index (fixed values): points with their cells, centres, a ring, covers of a city.
POINTS = [(37.3615593, -122.0553238, 5, "85283473fffffff"), (37.775938728915946, -122.41795063018799, 9, "8928308280fffff"), (40.689167, -74.044444, 10, "8a2a1072b59ffff"), (37.769377, -122.388903, 9, "89283082e73ffff")]
CENTRES = {"85283473fffffff": (37.34579337536848, -121.97637597255124), "8928308280fffff": (37.77670234943567, -122.41845932318311)}
RING = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.8622232890249), (37.42834118609435, -121.92354999630156), (37.42012867767778, -122.03773496427027), (37.33755608435298, -122.090428929044), (37.26319797461824, -122.02910130919)]
CITY = [(37.813318999983238, -122.4089866999972145), (37.7866302000007224, -122.3805436999997056), (37.7198061999978478, -122.3544736999993603), (37.7076131999975672, -122.5123436999983966), (37.7835871999971715, -122.5247187000021967), (37.8151571999998453, -122.4798767000009008)]
HOLE = [(37.7869802, -122.4471197), (37.7664102, -122.4590777), (37.7710682, -122.4137097)]
RINGS = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [(x, y) for y, x in [*points, points[0]]]


def world(spark, n=4000):
    return spark.range(n).select(F.degrees(F.asin(F.rand(1) * 2 - 1)).alias("lat"), (F.rand(2) * 360 - 180).alias("lng"))


def test_base_cells_and_pentagons():
    homes, _, pentagons = globe.base_cells()
    assert len(homes) == 122 and sorted(pentagons) == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    assert all(g == globe.HOME_FACES[b] for b, (g, _, _) in enumerate(homes))
    assert math.isclose(globe.average_area_km2(9), 0.105332513, rel_tol=1e-6)


@pytest.mark.parametrize("lat,lng,level,cell", POINTS)
def test_published_cells(spark, lat, lng, level, cell):
    df = spark.createDataFrame([(lat, lng)], "lat double, lng double")
    assert globe.with_cell(df, F.col("lat"), F.col("lng"), level).select(hexgrid.text_id(F.col("cell"))).first()[0] == cell


def test_published_centres_and_ring(spark):
    df = spark.createDataFrame([(c, int(c, 16)) for c in CENTRES], "name string, cell long")
    for r in globe.with_boundary(globe.with_centre(df, "cell"), "cell").collect():
        assert (r["lat"], r["lng"]) == pytest.approx(CENTRES[r["name"]], abs=1e-9)
        assert r["ring"][0] == r["ring"][-1] and len(r["ring"]) == 7
        if r["name"] == "85283473fffffff":
            assert [(p["lat"], p["lng"]) for p in r["ring"][:-1]] == [pytest.approx(p, abs=1e-9) for p in RING]


def test_no_cell_for_no_point(spark):
    df = spark.createDataFrame([(None, 1.0), (91.0, 0.0), (float("nan"), 0.0), (0.0, None)], "lat double, lng double")
    assert [r["cell"] for r in globe.with_cell(df, F.col("lat"), F.col("lng"), 3).collect()] == [None] * 4
    nulls = spark.createDataFrame([(None,)], "cell long")
    assert globe.with_boundary(globe.with_centre(nulls, "cell"), "cell").first()[:] == (None, None, None, None)
    assert globe.neighbours(nulls, "cell", 3).count() == 0


@pytest.mark.parametrize("level", [0, 3, 8])
def test_round_trip(spark, level):
    cells = globe.with_cell(world(spark), F.col("lat"), F.col("lng"), level).select("cell").distinct()
    back = globe.with_cell(globe.with_centre(cells, "cell"), F.col("lat"), F.col("lng"), level, "back")
    assert back.where("cell <> back").count() == 0


@pytest.mark.parametrize("level,total", [(0, 122), (1, 842)])
def test_neighbours_of_all_cells(spark, level, total):
    cells = globe.with_children(globe.with_cell(world(spark), F.col("lat"), F.col("lng"), 0).select("cell").distinct(), "cell", level, 0)
    pairs = {(r["cell"], r["neighbour"]) for r in globe.neighbours(cells, "cell", level).collect()}
    of = {}
    for a, b in pairs:
        of.setdefault(a, set()).add(b)
    assert len(of) == total and all((b, a) in pairs for a, b in pairs)
    assert sorted(map(len, of.values()))[:13] == [5] * 12 + [6]


def test_rings_meet_their_neighbours(spark, level=1):
    """Every corner of a ring is a corner of exactly three cells, but for corners where an edge of the icosahedron crosses, of two."""
    bases = spark.range(122).select(((F.col("id") * (1 << 45)) + ((1 << 59) | hexgrid.unused_bits(0))).alias("cell"))
    cells = globe.with_children(bases, "cell", level, 0)
    rings = globe.with_boundary(cells, "cell").select("cell", F.explode(F.slice("ring", 1, F.size("ring") - 1)).alias("p"))
    a, o = F.radians("p.lat"), F.radians("p.lng")
    places = rings.select("cell", *(F.round(v, 6).alias(n) for n, v in (("x", F.cos(a) * F.cos(o)), ("y", F.cos(a) * F.sin(o)), ("z", F.sin(a)))))
    counts = {r["n"]: r["count"] for r in places.groupBy(*(F.col(n) + 0.0 for n in "xyz")).agg(F.count("*").alias("n")).groupBy("n").count().collect()}
    assert counts == {3: 1680, 2: 180}


def test_disk_and_distance_agree(spark):
    start = spark.createDataFrame([(int("8928308280fffff", 16),)], "cell long")
    found = globe.with_distance(globe.disk(start, "cell", 9, 4), "cell", "member")
    assert {r["steps"]: r["n"] for r in found.groupBy("steps").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 6, 2: 12, 3: 18, 4: 24}
    assert found.where("distance is null or distance <> steps").count() == 0


def test_disks_are_walked_near_pentagons_only(spark, monkeypatch, level=3):
    """All disks of a level, those across base cells and around pentagons too, equal those walked by neighbours; few are walked."""
    bases = spark.range(122).select(((F.col("id") * (1 << 45)) + ((1 << 59) | hexgrid.unused_bits(0))).alias("cell"))
    cells = globe.with_children(bases, "cell", level, 0).persist()
    steps = globe.neighbours(globe.spread(cells), "cell", level, "member").select("cell", "member", F.lit(1).alias("steps"))
    want = steps.union(cells.select("cell", F.col("cell").alias("member"), F.lit(0)))
    walked, step = [], globe.neighbours
    monkeypatch.setattr(globe, "neighbours", lambda df, *rest: (walked.append(df), step(df, *rest))[1])
    found = globe.disk(cells, "cell", level, 1)
    assert found.exceptAll(want).isEmpty() and found.count() == want.count() == 41162 * 7 - 12
    assert walked[0].count() == 12 * (1 + 5 * 15)
    cells.unpersist()


def test_disk_of_cells_of_another_level_and_null(spark):
    cell, other = int("8928308280fffff", 16), int("85283473fffffff", 16)
    df = spark.createDataFrame([(cell,), (cell,), (None,), (other,)], "cell long")
    found = globe.disk(df, "cell", 9, 2)
    assert found.where(F.col("cell") == cell).count() == 19 and found.where((F.col("cell") == other) & (F.col("steps") == 0)).count() == 1


def test_published_covers(spark):
    rows = [(1, [ring(CITY)]), (2, [ring(CITY), ring(HOLE)]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}")
    found = globe.polygon_cells(df, "id", "rings", 9).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in found} == {1: 1253, 2: 1214}


def test_children_of_a_pentagon(spark):
    pentagon = spark.createDataFrame([((1 << 59) | (4 << 45) | hexgrid.unused_bits(0),)], "cell long")
    assert globe.with_children(pentagon, "cell", 2, 0).distinct().count() == hexgrid.child_count(0, 2, pentagon=True)
