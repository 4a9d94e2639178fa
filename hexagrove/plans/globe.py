"""Cells on the globe (H6 to H11, H12) over the customers as places.

The oracles say the same in SQL: chains of common table expressions over the tables of ``functions.globe``, one step for
each level, where the queries fold.
"""

from __future__ import annotations

import cmath
import math

from pyspark.sql import functions as F

from hexagrove.functions import globe, hexgrid
from hexagrove.operators import globe_frames as frames
from hexagrove.plans.registry import query, read

LEVEL = 7
COS, SIN = math.cos(globe.TURN), math.sin(globe.TURN)


def listed(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


def cells_sql(source: str, level: int, tag: str, out: str = "cell") -> str:
    """CTEs ``tag`` with the cells of rows of ``source`` with lat and lng."""
    base, row, rows = globe.digit_turns()
    table, turned = list(range(7)), list(range(7))
    for _ in range(5):
        table = [globe.TURNED[d] for d in table]
        turned += table
    dots = ", ".join(f"px * {c[0]!r} + py * {c[1]!r} + pz * {c[2]!r}" for c, _, _ in globe.frames())

    def dot(axis: int) -> str:
        return "(" + " + ".join(f"{p} * {listed([f[axis][n] for f in globe.frames()])}[face + 1]" for n, p in enumerate(("px", "py", "pz"))) + ")"

    scale = globe.ROOT7**level / globe.UNIT
    c, s = (COS, -SIN) if level % 2 else (1.0, 0.0)
    steps = [
        f"{tag}a AS (SELECT *, cos(radians(lat)) * cos(radians(lng)) AS px, cos(radians(lat)) * sin(radians(lng)) AS py, sin(radians(lat)) AS pz FROM {source})",
        f"{tag}b AS (SELECT *, [{dots}] AS dots FROM {tag}a)",
        f"{tag}c AS (SELECT * EXCLUDE (dots), list_position(dots, list_max(dots)) - 1 AS face FROM {tag}b)",
        f"{tag}d AS (SELECT *, {dot(1)} / {dot(0)} * {scale!r} AS x, {dot(2)} / {dot(0)} * {scale!r} AS y FROM {tag}c)",
        f"{tag}e AS (SELECT * EXCLUDE (x, y), x * {c!r} - y * {s!r} AS x, x * {s!r} + y * {c!r} AS y FROM {tag}d)",
        f"{tag}f AS (SELECT * EXCLUDE (x, y), x - y / {globe.ROOT3!r} AS q, y * {2 / globe.ROOT3!r} AS r FROM {tag}e)",
        f"{tag}g AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM {tag}f)",
        f"{tag}h AS (SELECT *, CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS fq, CASE WHEN abs(rr - r) >= abs(rq - q) AND abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS fr FROM {tag}g)",
        f"{tag}{level} AS (SELECT * EXCLUDE (px, py, pz, q, r, rq, rr, rs, fq, fr), (fq + fr)::BIGINT AS i, fr::BIGINT AS j, 0::BIGINT AS digits FROM {tag}h)",
    ]
    for r in range(level, 0, -1):
        up = ("3 * i - j", "i + 2 * j") if r % 2 else ("2 * i + j", "3 * j - i")
        down = ("2 * ni + nj", "3 * nj - ni") if r % 2 else ("3 * ni - nj", "ni + 2 * nj")
        steps.append(f"{tag}u{r} AS (SELECT *, floor(({up[0]} + 3) / 7.0)::BIGINT AS ni, floor(({up[1]} + 3) / 7.0)::BIGINT AS nj FROM {tag}{r})")
        steps.append(f"{tag}v{r} AS (SELECT *, i - ({down[0]}) AS di, j - ({down[1]}) AS dj FROM {tag}u{r})")
        steps.append(f"{tag}{r - 1} AS (SELECT * EXCLUDE (i, j, ni, nj, di, dj, digits), ni AS i, nj AS j, digits | ((di * 4 + dj * 2 - 7 * least(di, dj, 0)) << {3 * (15 - r)}) AS digits FROM {tag}v{r})")
    lead = "coalesce(" + ", ".join(f"nullif((digits >> {3 * (15 - r)}) & 7, 0)" for r in range(1, level + 1)) + ", 0)"
    steps.append(f"{tag}w AS (SELECT *, face * 27 + (i - least(i, j, 0)) * 9 + (j - least(i, j, 0)) * 3 - least(i, j, 0) AS spot, {lead} AS lead FROM {tag}0)")
    steps.append(f"{tag}x AS (SELECT *, {listed(rows)}[{listed(row)}[spot + 1] * 7 + lead + 1] AS turns FROM {tag}w)")
    packed = " | ".join(f"({listed(turned)}[turns * 7 + ((digits >> {3 * (15 - r)}) & 7) + 1]::BIGINT << {3 * (15 - r)})" for r in range(1, level + 1))
    steps.append(f"{tag} AS (SELECT * EXCLUDE (face, i, j, digits, spot, lead, turns), {(1 << 59) | (level << 52) | hexgrid.unused_bits(level)}::BIGINT | ({listed(base)}[spot + 1]::BIGINT << 45) | {packed} AS {out} FROM {tag}x)")
    return ",\n".join(steps)


def lattice_sql(source: str, level: int, tag: str, cell: str = "cell") -> str:
    """CTEs ``tag`` with base, lead, i and j of the cells of rows of ``source``."""
    homes, _, _ = globe.base_cells()
    lead = "coalesce(" + ", ".join(f"nullif(({cell} >> {3 * (15 - r)}) & 7, 0)" for r in range(1, level + 1)) + ", 0)"
    steps = [
        f"{tag}z AS (SELECT *, (({cell} >> 45) & 127)::INT AS base, {lead} AS lead FROM {source})",
        f"{tag}0 AS (SELECT *, {listed([h[1] for h in homes])}[base + 1]::BIGINT AS i, {listed([h[2] for h in homes])}[base + 1]::BIGINT AS j FROM {tag}z)",
    ]
    for r in range(1, level + 1):
        digit = f"(({cell} >> {3 * (15 - r)}) & 7)"
        di, dj = f"({digit} >> 2) - ({digit} & 1)", f"(({digit} >> 1) & 1) - ({digit} & 1)"
        down = ("2 * i + j", "3 * j - i") if r % 2 else ("3 * i - j", "i + 2 * j")
        steps.append(f"{tag}{r} AS (SELECT * EXCLUDE (i, j), {down[0]} + {di} AS i, {down[1]} + {dj} AS j FROM {tag}{r - 1})")
    steps.append(f"{tag} AS (SELECT * FROM {tag}{level})")
    return ",\n".join(steps)


def places_sql(source: str, level: int, tag: str) -> str:
    """CTEs ``tag`` with lat and lng of lattice places (i, j) of rows of ``source`` with base and lead."""
    table = globe.moves()
    turns = [cmath.exp(1j * globe.SIXTH * s) for _, s, _ in table]
    pentagons = "base IN (" + ", ".join(map(str, sorted(globe.base_cells()[2]))) + ")"
    size = globe.ROOT7**level
    c, s = (COS / size, SIN / size) if level % 2 else (1 / size, 0.0)

    def along(n: int) -> str:
        return f"x * {math.cos(globe.SIXTH * n)!r} + y * {math.sin(globe.SIXTH * n)!r} > 1 + 1e-12"

    turn = "CASE WHEN sixth = -2 AND abs(x - 2) + abs(y) > 1e-12 THEN CASE WHEN lead = 5 THEN -1 ELSE 1 END ELSE 0 END"
    at = "(base * 5 + region + 1)"

    def pick(values) -> str:
        return f"{listed(values)}[{at}]"

    frame = ["(" + f"{listed([f[0][n] for f in globe.frames()])}[face + 1] + {globe.UNIT!r} * (fx * {listed([f[1][n] for f in globe.frames()])}[face + 1] + fy * {listed([f[2][n] for f in globe.frames()])}[face + 1]))" for n in range(3)]
    return ",\n".join((
        f"{tag}a AS (SELECT *, (i - j / 2.0) * {c!r} - j * {globe.ROOT3 / 2 * s!r} AS x, (i - j / 2.0) * {s!r} + j * {globe.ROOT3 / 2 * c!r} AS y FROM {source})",
        f"{tag}b AS (SELECT *, round(atan2(y, x - 2) / {globe.SIXTH!r}) AS sixth FROM {tag}a)",
        f"{tag}c AS (SELECT * EXCLUDE (sixth), CASE WHEN {pentagons} THEN {turn} ELSE 0 END * {globe.SIXTH!r} AS out_of_cut FROM {tag}b)",
        f"{tag}d AS (SELECT * EXCLUDE (x, y, out_of_cut), CASE WHEN out_of_cut = 0 THEN x ELSE (x - 2) * cos(out_of_cut) - y * sin(out_of_cut) + 2 END AS x, CASE WHEN out_of_cut = 0 THEN y ELSE (x - 2) * sin(out_of_cut) + y * cos(out_of_cut) END AS y FROM {tag}c)",
        f"{tag}e AS (SELECT *, CASE WHEN {pentagons} THEN CASE WHEN round(atan2(y, x - 2) / {globe.SIXTH!r}) <= -2 THEN 0 ELSE 3 - round(atan2(y, x - 2) / {globe.SIXTH!r}) END WHEN {along(1)} THEN 1 WHEN {along(3)} THEN 2 WHEN {along(5)} THEN 3 ELSE 0 END::INT AS region FROM {tag}d)",
        f"{tag}f AS (SELECT * EXCLUDE (x, y, region), {pick([m[0] for m in table])} AS face, x * {pick([t.real for t in turns])} - y * {pick([t.imag for t in turns])} + {pick([m[2].real for m in table])} AS fx, x * {pick([t.imag for t in turns])} + y * {pick([t.real for t in turns])} + {pick([m[2].imag for m in table])} AS fy FROM {tag}e)",
        f"{tag}g AS (SELECT *, {frame[0]} AS p0, {frame[1]} AS p1, {frame[2]} AS p2 FROM {tag}f)",
        f"{tag} AS (SELECT * EXCLUDE (p0, p1, p2), degrees(atan2(p2, sqrt(p0 * p0 + p1 * p1))) AS lat, degrees(atan2(p1, p0)) AS lng FROM {tag}g)",
    ))


def places(spark, d):
    """Customers as places all over the globe: c_custkey, lat, lng."""
    return read(spark, d, "customer").select("c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(17800)) / 100.0 - 89).alias("lat"), (F.pmod(F.col("c_custkey") * 104729, F.lit(36000)) / 100.0 - 180).alias("lng"))


PLACES = "places AS (SELECT c_custkey, (c_custkey * 7919 % 17800) / 100.0::DOUBLE - 89 AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lng FROM customer)"


def located(spark, d, level=LEVEL):
    return globe.with_cell(places(spark, d), F.col("lat"), F.col("lng"), level)


@query("H10_point_to_cell", f"WITH {PLACES},\n{cells_sql('places', LEVEL, 'c')}\nSELECT c_custkey, lower(hex(cell)) AS cell FROM c")
def h10(spark, d):
    return located(spark, d).select("c_custkey", hexgrid.text_id(F.col("cell")).alias("cell"))


CENTRES = f"{PLACES},\n{cells_sql('places', LEVEL, 'c')},\nown AS (SELECT DISTINCT cell FROM c),\n{lattice_sql('own', LEVEL, 'l')}"


@query("H9_cell_centre", f"WITH {CENTRES},\n{places_sql('l', LEVEL, 'p')}\nSELECT cell, round(lat, 8) AS lat, round(lng, 8) AS lng FROM p")
def h9(spark, d):
    return globe.with_centre(located(spark, d).select("cell").distinct(), "cell").select("cell", F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"))


STEPS = "(VALUES (1, 0), (1, 1), (0, 1), (-1, 0), (0, -1), (-1, -1)) s(si, sj)"


def neighbours_sql(source: str, tag: str) -> str:
    """CTEs ``tag`` (cell, neighbour) of rows of ``source`` with cell."""
    pentagons = ", ".join(map(str, sorted(globe.base_cells()[2])))
    return ",\n".join((
        lattice_sql(source, LEVEL, tag + "l"),
        f"{tag}o AS (SELECT cell, base, lead, i + si AS i, j + sj AS j FROM {tag}l, {STEPS} WHERE NOT (lead = 0 AND base IN ({pentagons}) AND si + sj = -2))",
        places_sql(f"{tag}o", LEVEL, tag + "p"),
        f"{tag}q AS (SELECT cell, lat, lng FROM {tag}p)",
        cells_sql(f"{tag}q", LEVEL, tag, "neighbour"),
    ))


@query("H6_disk", f"WITH {PLACES},\n{cells_sql('places', LEVEL, 'c')},\nown AS (SELECT DISTINCT cell FROM c),\n{neighbours_sql('own', 'n')},\nonce AS (SELECT DISTINCT cell AS origin, neighbour AS cell FROM n),\n{neighbours_sql('once', 'm')},\nall_steps AS (SELECT cell, cell AS member, 0 AS steps FROM own UNION ALL SELECT origin, cell, 1 FROM once UNION ALL SELECT once.origin, m.neighbour, 2 FROM once JOIN (SELECT DISTINCT cell, neighbour FROM m) m USING (cell))\nSELECT cell, member, min(steps) AS steps FROM all_steps GROUP BY cell, member")
def h6(spark, d):
    once = globe.spread(places(spark, d).select("lat", "lng").distinct())
    return globe.disk(globe.with_cell(once, F.col("lat"), F.col("lng"), LEVEL), "cell", LEVEL, 2)


@query("H7_grid_distance", f"WITH {PLACES},\n{cells_sql('places', LEVEL, 'c')},\nown AS (SELECT DISTINCT cell FROM c),\n{neighbours_sql('own', 'n')},\nonce AS (SELECT DISTINCT cell AS origin, neighbour AS cell FROM n),\n{neighbours_sql('once', 'm')},\nreached AS (SELECT DISTINCT once.origin, m.neighbour FROM once JOIN (SELECT DISTINCT cell, neighbour FROM m) m USING (cell)),\nfar AS (SELECT origin, neighbour FROM reached WHERE origin <> neighbour AND NOT EXISTS (SELECT 1 FROM once WHERE once.origin = reached.origin AND once.cell = reached.neighbour))\nSELECT cell, count(*) AS n, sum(d)::BIGINT AS total FROM (SELECT origin AS cell, cell AS other, 1 AS d FROM once UNION ALL SELECT origin, neighbour, 2 FROM far) GROUP BY cell")
def h7(spark, d):
    """Of each customer's cell, the members of its disk of two steps and the sum of their distances."""
    pairs = globe.disk(located(spark, d), "cell", LEVEL, 2).where("steps > 0").select("cell", "member")
    return globe.with_distance(pairs, "cell", "member").groupBy("cell").agg(F.count("distance").alias("n"), F.sum("distance").alias("total"))


@query("H8_cell_boundary")
def h8(spark, d):
    """Boundary rings of the customers' cells as text; compared in the tests with published rings and with neighbours' rings."""
    rings = globe.with_boundary(located(spark, d).select("cell").distinct(), "cell")
    text = F.array_join(F.transform("ring", lambda p: F.concat_ws(" ", F.format_number(p["lng"], 6), F.format_number(p["lat"], 6))), ",")
    return rings.select("cell", (F.size("ring") - 1).alias("corners"), text.alias("ring"))


def boxes(spark, d):
    """Suppliers as four-cornered plots with a square hole: s_suppkey, rings."""
    x, y = F.pmod(F.col("s_suppkey") * 104729, F.lit(33000)) / 100.0 - 170, F.pmod(F.col("s_suppkey") * 7919, F.lit(14000)) / 100.0 - 70
    size = 0.3 + F.pmod(F.col("s_suppkey"), F.lit(7)) / 10.0

    def corner(dx: float, dy: float):
        return F.struct((x + size * dx).alias("x"), (y + size * dy).alias("y"))

    outer = F.array(corner(0, 0), corner(2, 0.5), corner(2.5, 2), corner(0.5, 1.5), corner(0, 0))
    hole = F.array(corner(0.9, 0.7), corner(1.3, 0.7), corner(1.3, 1.1), corner(0.9, 1.1), corner(0.9, 0.7))
    return read(spark, d, "supplier").select("s_suppkey", F.array(outer, hole).alias("rings"))


#: The oracle's candidates: the cells of points on a grid far finer than a cell's inner radius.
_CORNERS = "[[[0, 0], [2, 0.5], [2.5, 2], [0.5, 1.5], [0, 0]], [[0.9, 0.7], [1.3, 0.7], [1.3, 1.1], [0.9, 1.1], [0.9, 0.7]]]"


@query("H11_polygon_cells", f"""WITH plots AS (
  SELECT s_suppkey, (s_suppkey * 104729 % 33000) / 100.0::DOUBLE - 170 AS x, (s_suppkey * 7919 % 14000) / 100.0::DOUBLE - 70 AS y, 0.3 + (s_suppkey % 7) / 10.0::DOUBLE AS size FROM supplier
), edges AS (
  SELECT s_suppkey, x + size * ring[k][1] AS x1, y + size * ring[k][2] AS y1, x + size * ring[k + 1][1] AS x2, y + size * ring[k + 1][2] AS y2
  FROM plots, (SELECT unnest({_CORNERS}::DOUBLE[][][]) AS ring) rings, range(1, 5) steps(k)
), samples AS (
  SELECT s_suppkey, x + size * u / 20 AS lng, y + size * v / 20 AS lat FROM plots, range(-2, 53) us(u), range(-2, 43) vs(v)
),
{cells_sql("samples", 5, "c")},
found AS (SELECT DISTINCT s_suppkey, cell FROM c),
{lattice_sql("found", 5, "l")},
{places_sql("l", 5, "p")}
SELECT s_suppkey, lower(hex(cell)) AS cell FROM p JOIN edges USING (s_suppkey)
GROUP BY s_suppkey, cell HAVING count(*) FILTER (((y1 > lat) <> (y2 > lat)) AND lng < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""")
def h11(spark, d):
    return globe.polygon_cells(boxes(spark, d), "s_suppkey", "rings", 5).select("s_suppkey", hexgrid.text_id(F.col("cell")).alias("cell"))


@query("H12_average_area", "SELECT level, round(4 * pi() * 6371.007180918475 ** 2 / (2 + 120 * 7::BIGINT ** level), 6) AS km2, (SELECT count(*) FROM customer) AS n FROM range(0, 16) levels(level)")
def h12(spark, d):
    """The average area of a cell at each resolution, beside the number of customers."""
    n = read(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    areas = F.array(*(F.struct(F.lit(r).cast("long").alias("level"), F.lit(round(globe.average_area_km2(r), 6)).alias("km2")) for r in range(16)))
    return n.select("n", F.inline(areas).alias("level", "km2"))


def near_places(spark, d):
    """Customers as places in a box around 55 north, 15 east, with balance and segment."""
    return read(spark, d, "customer").select("c_custkey", (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / 1000.0 + 54.5).alias("lat"), (F.pmod(F.col("c_custkey") * 104729, F.lit(1000)) / 1000.0 + 14.5).alias("lng"), F.col("c_acctbal").cast("double").alias("v"), F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 2).alias("cls"))


NEAR = f"near AS (SELECT c_custkey, (c_custkey * 7919 % 1000) / 1000.0::DOUBLE + 54.5 AS lat, (c_custkey * 104729 % 1000) / 1000.0::DOUBLE + 14.5 AS lng, c_acctbal::DOUBLE AS v, CASE WHEN c_nationkey > 2 THEN c_mktsegment END AS segment, c_custkey % 2 AS cls FROM customer),\n{cells_sql('near', 6, 'c')}"


@query("G1_points_per_cell", f"WITH {NEAR}\nSELECT cell, count(*) AS n, round(sum(v), 4) AS total, round(max(v), 4) AS top, round(max(v) - min(v), 4) AS spread FROM c GROUP BY cell")
def g1_cells(spark, d):
    points = near_places(spark, d)
    grid = globe.with_cell(points, F.col("lat"), F.col("lng"), 6).select("cell").distinct()
    out = frames.points_per_cell(points, grid, 6, "v")
    return out.select("cell", "n", *(F.round(c, 4).alias(c) for c in ("total", "top", "spread")))


@query("G20_class_shares", f"WITH {NEAR}, n AS (SELECT cell, segment AS class, count(*) AS n FROM c WHERE segment IS NOT NULL GROUP BY ALL) SELECT cell, class, n, round(n / sum(n) OVER (PARTITION BY cell), 8) AS share, row_number() OVER (PARTITION BY cell ORDER BY n DESC, class) = 1 AS dominant FROM n")
def g20(spark, d):
    return frames.class_shares(near_places(spark, d), 6, "segment").withColumn("share", F.round("share", 8))


@query("F5_map_frame", f"WITH {NEAR}, own AS (SELECT DISTINCT cell FROM c),\n{lattice_sql('own', 6, 'l')},\n{places_sql('l', 6, 'p')}\nSELECT cell, round(lat, 8) AS lat, round(lng, 8) AS lng, true AS near_average FROM p")
def f5(spark, d):
    """Cells with centre and area; numbers that are no cells are left out. Areas lie within a fifth of the average there."""
    cells = globe.with_cell(near_places(spark, d).select("lat", "lng").distinct(), F.col("lat"), F.col("lng"), 6).select("cell").distinct()
    wrong = cells.select(F.col("cell").bitwiseOR(hexgrid.long(7 << 42)).alias("cell")).union(read(spark, d, "customer").select(F.col("c_custkey").cast("long")))
    out = frames.map_frame(cells.union(wrong))
    return out.select("cell", F.round("lat", 8).alias("lat"), F.round("lng", 8).alias("lng"), (F.abs(F.col("area_km2") / globe.average_area_km2(6) - 1) < 0.2).alias("near_average"))


def edges_sql(source: str, tag: str, level: int) -> str:
    """CTEs ``tag`` (a, b): neighbours among the cells of ``source``, by the lattice of steps to each side."""
    pentagons = ", ".join(map(str, sorted(globe.base_cells()[2])))
    return ",\n".join((
        lattice_sql(source, level, tag + "l"),
        f"{tag}o AS (SELECT cell AS a, base, lead, i + si AS i, j + sj AS j FROM {tag}l, {STEPS} WHERE NOT (lead = 0 AND base IN ({pentagons}) AND si + sj = -2))",
        places_sql(f"{tag}o", level, tag + "p"),
        f"{tag}q AS (SELECT a, lat, lng FROM {tag}p)",
        cells_sql(f"{tag}q", level, tag + "n", "b"),
        f"{tag} AS MATERIALIZED (SELECT DISTINCT a, b FROM {tag}n JOIN {source} s ON s.cell = b)",
    ))


@query("D9_cell_zones", f"WITH RECURSIVE {NEAR}, own AS MATERIALIZED (SELECT cell, min(cls) AS cls FROM c GROUP BY cell),\n{edges_sql('own', 'ed', 6)},\nsame AS MATERIALIZED (SELECT a, b FROM ed JOIN own x ON x.cell = a JOIN own y ON y.cell = b WHERE x.cls = y.cls), reach AS (SELECT cell, cell AS zone FROM own UNION SELECT b, zone FROM reach JOIN same ON a = reach.cell WHERE zone < b), zone AS (SELECT cell, min(zone) AS zone FROM reach GROUP BY cell)\nSELECT cell, zone, count(*) OVER (PARTITION BY zone) AS zone_size FROM zone")
def d9_cells(spark, d):
    cells = globe.with_cell(near_places(spark, d), F.col("lat"), F.col("lng"), 6).groupBy("cell").agg(F.min("cls").alias("cls"))
    return frames.cell_zones(cells, 6)


@query("D13_cell_rings", f"WITH RECURSIVE {NEAR}, own AS MATERIALIZED (SELECT cell, min(c_custkey) AS k FROM c GROUP BY cell),\n{edges_sql('own', 'ed', 6)},\nwalk AS (SELECT cell, 0 AS ring FROM own WHERE k % 10 = 0 UNION SELECT b, ring + 1 FROM walk JOIN ed ON a = walk.cell WHERE ring < 3)\nSELECT cell, min(ring) AS ring FROM walk GROUP BY cell")
def d13_cells(spark, d):
    cells = globe.with_cell(near_places(spark, d), F.col("lat"), F.col("lng"), 6).groupBy("cell").agg(F.min("c_custkey").alias("k"))
    return frames.cell_rings(cells, cells.where("k % 10 = 0"), 6, 3)


@query("F13_buffer_share", f"""WITH pts AS (SELECT s_nationkey % 3 AS g, (s_suppkey * 7919 % 100) / 100.0::DOUBLE + 54.5 AS plat, (s_suppkey * 104729 % 100) / 100.0::DOUBLE + 14.5 AS plng FROM supplier),
samples AS (SELECT 53.9 + u * 0.01 AS lat, 13.9 + v * 0.016 AS lng FROM range(0, 210) us(u), range(0, 140) vs(v)),
{cells_sql("samples", 7, "c")},
own AS (SELECT DISTINCT cell FROM c),
{lattice_sql("own", 7, "l")},
{places_sql("l", 7, "p")},
hit AS (SELECT DISTINCT g, cell FROM p, pts WHERE 2 * 6371007.180918475 * asin(sqrt(sin(radians(lat - plat) / 2) ** 2 + cos(radians(lat)) * cos(radians(plat)) * sin(radians(lng - plng) / 2) ** 2)) <= 8000)
SELECT g, {"((cell & " + str(~hexgrid.RESOLUTION_MASK) + "::BIGINT) | " + str((5 << 52) | hexgrid.unused_bits(5)) + "::BIGINT)"} AS cell, round(count(*) * 100.0 / 49, 8) AS share_pct FROM hit GROUP BY 1, 2""")
def f13(spark, d):
    """Shares of cells within 8 km of three groups of suppliers."""
    points = read(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("g"), (F.pmod(F.col("s_suppkey") * 7919, F.lit(100)) / 100.0 + 54.5).alias("lat"), (F.pmod(F.col("s_suppkey") * 104729, F.lit(100)) / 100.0 + 14.5).alias("lng"))
    return frames.buffer_share(points, 8000.0, 5, 7, "g").withColumn("share_pct", F.round("share_pct", 8))


@query("D19_schematic_disk", f"WITH {PLACES},\n{cells_sql('places', LEVEL, 'c')},\nneeds AS (SELECT cell, max(c_custkey % 8) AS n FROM c GROUP BY cell) SELECT cell, n AS cells, n > 0 AS has_centre, greatest(n - 1, 0) AS beside FROM needs WHERE n > 0")
def d19(spark, d):
    """Cells drawn for a need outside: the centre first, then its neighbours."""
    needs = located(spark, d).groupBy("cell").agg(F.max(F.col("c_custkey") % 8).alias("n"))
    out = globe.with_distance(frames.schematic_disk(needs, LEVEL, 7), "cell", "member")
    return out.groupBy("cell").agg(F.count(F.lit(1)).alias("cells"), F.bool_or((F.col("place") == 1) & (F.col("member") == F.col("cell"))).alias("has_centre"), F.count_if(F.col("distance") == 1).alias("beside"))
