"""Cells of the hexagonal index on the globe: point to cell, centre, boundary, neighbours, distance.

The sphere is projected onto the twenty faces of an icosahedron (gnomonic), and each face carries a lattice whose
unit shrinks by the root of seven at each resolution, turned at odd ones. A cell is a lattice point; its digits are
the steps from parent to child. Everything here is a column expression. A point is folded up its levels by integer
arithmetic.

Instead of overage rules, the triangles next to a face are unfolded into its plane: a point beyond an edge is
moved rigidly into the neighbour's plane. Around the twelve pentagons five faces meet instead of six sectors; there the
plane of the home face is cut along the missing sector. The tables of both kinds of moves, and of the base cell and
the turn of digits for each lattice point of each face, are computed below from three lists of fixed values.
"""

from __future__ import annotations

import cmath
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.functions.hexgrid import long, resolution, unused_bits

# Fixed values of the index: latitude and longitude of each face's centre, the azimuth of its first axis (radians),
# and for each base cell the face in whose axes its digits are read.
FACE_CENTRES = (
    (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159),
    (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746),
    (0.491715428198773866, 0.401988202911306943), (0.172745327415618701, 1.678146885280433686),
    (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401),
    (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035),
    (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203),
    (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622),
    (-0.427370518328979641, 1.252716453253507838), (-0.600191595538186799, 2.690988744120037492),
    (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139),
    (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
)
FACE_AXES = (
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400,
    2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535,
    2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
)
HOME_FACES = (
    1, 2, 1, 2, 0, 1, 1, 2, 0, 2, 1, 1, 3, 3, 11, 4, 0, 6, 0, 2, 7, 2, 0, 6, 10, 6, 3, 11, 4, 3,
    0, 4, 5, 0, 7, 11, 7, 10, 12, 6, 7, 4, 3, 3, 4, 6, 11, 8, 5, 14, 5, 12, 10, 4, 12, 7, 11, 10, 13, 10,
    11, 9, 8, 6, 8, 9, 14, 5, 16, 8, 5, 12, 7, 12, 10, 9, 13, 16, 15, 15, 16, 14, 13, 5, 8, 14, 9, 14, 17, 12,
    16, 17, 15, 16, 9, 15, 13, 8, 13, 17, 19, 14, 19, 17, 13, 17, 16, 9, 15, 15, 18, 18, 19, 17, 19, 18, 18, 19, 19, 18,
    19, 18,
)
#: A lattice unit of resolution 0 in the tangent plane; the turn of the lattice at odd resolutions.
UNIT = 0.38196601125010500003
TURN = math.asin(math.sqrt(3 / 28))
ROOT3, ROOT7 = math.sqrt(3), math.sqrt(7)
SIXTH = math.pi / 3
#: The digit that a turn of sixty degrees makes of each digit; a digit's bits are its steps along the three axes.
TURNED = (0, 5, 3, 1, 6, 4, 2)
K, JK, IK = 1, 3, 5
#: Average area and edge of a cell by resolution follow from the number of cells, 2 + 120 * 7**r.
EARTH_KM = 6371.007180918475


def average_area_km2(level: int) -> float:
    return 4 * math.pi * EARTH_KM**2 / (2 + 120 * 7**level)


def _vector(lat: float, lng: float) -> tuple[float, float, float]:
    return math.cos(lat) * math.cos(lng), math.cos(lat) * math.sin(lng), math.sin(lat)


@cache
def frames() -> list[tuple[tuple[float, ...], ...]]:
    """Of each face: the centre and two tangent vectors, along its first axis and a right angle to the left."""
    out = []
    for (lat, lng), azimuth in zip(FACE_CENTRES, FACE_AXES):
        north = (-math.sin(lat) * math.cos(lng), -math.sin(lat) * math.sin(lng), math.cos(lat))
        east = (-math.sin(lng), math.cos(lng), 0.0)
        along = tuple(n * math.cos(a) + e * math.sin(a) for n, e in zip(north, east) for a in (azimuth,))
        left = tuple(n * math.cos(a) + e * math.sin(a) for n, e in zip(north, east) for a in (azimuth - math.pi / 2,))
        out.append((_vector(lat, lng), along, left))
    return out


def _turn(sixths: float) -> complex:
    return cmath.exp(1j * SIXTH * sixths)


def _on_sphere(face: int, z: complex) -> tuple[float, ...]:
    c, u, w = frames()[face]
    p = [c[n] + UNIT * (z.real * u[n] + z.imag * w[n]) for n in range(3)]
    size = math.sqrt(sum(x * x for x in p))
    return tuple(x / size for x in p)


def _near(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return sum((x - y) ** 2 for x, y in zip(a, b)) < 1e-12


#: Corners of each triangle in its plane, and the directions of its edges' outward normals, in sixths of a turn.
CORNERS = (2 * _turn(0), 2 * _turn(2), 2 * _turn(4))
NORMALS = (1, 3, 5)


@cache
def motions() -> dict[tuple[int, int], tuple[int, int, complex]]:
    """(face, edge) to (neighbour, turn in sixths, shift): z becomes turn * z + shift."""
    out = {}
    for f in range(20):
        for e in range(3):
            ends = [CORNERS[e], CORNERS[(e + 1) % 3]]
            at = [_on_sphere(f, z) for z in ends]
            for g in range(20):
                there = [next((z for z in CORNERS if _near(_on_sphere(g, z), p)), None) for p in at]
                if g != f and None not in there:
                    turn = (there[1] - there[0]) / (ends[1] - ends[0])
                    sixths = round(cmath.phase(turn) / SIXTH) % 6
                    out[f, e] = (g, sixths, there[0] - _turn(sixths) * ends[0])
    return out


def _beyond(z: complex) -> int | None:
    return next((e for e, n in enumerate(NORMALS) if (z * _turn(-n)).real > 1 + 1e-9), None)


def _lattice(i: float, j: float) -> complex:
    return complex(i - j / 2, j * ROOT3 / 2)


@cache
def base_cells() -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int], set[int]]:
    """Each base cell's home face and lattice place there; the base cell at (face, i, j); the pentagons.

    Base cells are numbered from north to south.
    """
    places: dict[tuple[int, int, int], tuple[float, ...]] = {}
    for face in range(20):
        for i in range(3):
            for j in range(3):
                for k in range(3):
                    if min(i, j, k) == 0:
                        z, f = _lattice(i - k, j - k), face
                        if (e := _beyond(z)) is not None:
                            f, sixths, shift = motions()[face, e]
                            z = _turn(sixths) * z + shift
                        places[face, i - k, j - k] = _on_sphere(f, z)
    centres: list[tuple[float, ...]] = []
    for p in places.values():
        if not any(_near(p, c) for c in centres):
            centres.append(p)
    centres.sort(key=lambda c: -c[2])
    number = {at: next(n for n, c in enumerate(centres) if _near(p, c)) for at, p in places.items()}
    homes = [(f, *next((i, j) for (g, i, j), n in number.items() if n == b and g == f and _beyond(_lattice(i, j)) is None)) for b, f in enumerate(HOME_FACES)]
    corners = [_on_sphere(f, z) for f in range(20) for z in CORNERS]
    return homes, number, {b for b, c in enumerate(centres) if any(_near(c, p) for p in corners)}


#: Around a pentagon at the first corner of its home face, the sectors of its digits from the home face clockwise.
SECTORS = (3, 2, 1, 0, -1)


@cache
def around(base: int) -> list[tuple[int, int]]:
    """The faces around a pentagon from the home face clockwise, and in each the corner where it lies."""
    face = HOME_FACES[base]
    out, corner = [], 0
    for _ in range(5):
        out.append((face, corner))
        # Clockwise from a corner's inner side comes the edge to the next corner.
        g, sixths, shift = motions()[face, corner]
        at = _turn(sixths) * CORNERS[corner] + shift
        face, corner = g, min(range(3), key=lambda c: abs(CORNERS[c] - at))
    return out


@cache
def moves() -> list[tuple[int, int, complex]]:
    """For base cell b and region r, at 5 * b + r: the face, turn in sixths and shift that take a point from the
    home plane to its face. Regions of a hexagon: inside, or beyond an edge; of a pentagon: the sectors."""
    homes, _, pentagons = base_cells()
    out = []
    for b, (face, _, _) in enumerate(homes):
        if b in pentagons:
            for (g, corner), sector in zip(around(b), SECTORS):
                sixths = (2 * corner + 3 - sector) % 6
                out.append((g, sixths, CORNERS[corner] - _turn(sixths) * CORNERS[0]))
        else:
            out += [(face, 0, 0j), *(motions()[face, e] for e in range(3)), (face, 0, 0j)]
    return out


def _pentagon_turns(lead: int, steps: int, clockwise: bool) -> int:
    """Turns of all digits of a pentagon's child, which never leave the deleted digit in front."""
    total = 0
    if lead == K:
        total, lead = (-1, JK) if clockwise else (1, IK)
    for _ in range(steps):
        total, lead = total + 1, TURNED[lead]
        if lead == K:
            total, lead = total + 1, TURNED[lead]
    return total % 6


@cache
def digit_turns() -> tuple[list[int], list[int], list[int]]:
    """At face * 27 + i * 9 + j * 3 + k: the base cell, and its row of turns; at row * 7 + leading digit: the turns."""
    homes, number, pentagons = base_cells()
    rows = [n for n in range(6) for _ in range(7)]
    rows += [_pentagon_turns(lead, n, clockwise) if lead else 0 for clockwise in (False, True) for n in range(5) for lead in range(7)]
    base, row = [0] * 540, [0] * 540
    # Sectors counted from the home face anticlockwise, and the place of a corner's own sector among the digits.
    own = {0: 0, 1: 1, 2: 3}
    for (face, i, j), b in number.items():
        m = min(i, j, 0)
        at = face * 27 + (i - m) * 9 + (j - m) * 3 - m
        base[at] = b
        if b in pentagons:
            n, corner = next((n, c) for n, (g, c) in enumerate(around(b)) if g == face)
            row[at] = 6 + 5 * (corner == 1) + (-n - own[corner]) % 5
        elif homes[b][0] != face:
            row[at] = next(s for (f, _), (g, s, _) in motions().items() if f == face and g == homes[b][0])
    return base, row, rows


def _pick(values: list, at: Column) -> Column:
    """The value at a place of a table, which the plan holds as one literal."""
    whole = all(isinstance(v, int) for v in values)
    return F.get(F.lit(np.array(values, np.int32 if whole else np.float64)), at)


def _names(df: DataFrame, *names: str) -> list[str]:
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _digit(cell: Column, level: int) -> Column:
    return F.shiftrightunsigned(cell, 3 * (15 - level)).bitwiseAND(long(7)).cast("int")


def with_cell(df: DataFrame, lat: Column, lng: Column, level: int, out: str = "cell") -> DataFrame:
    """``df`` with the cell of ``level`` at a latitude and longitude in degrees; null for no such point."""
    px, py, pz, face, x, y, i, j, a, b, digits, at = _names(df, *"px py pz face x y i j a b digits at".split())
    ok = lat.between(-90.0, 90.0) & (F.abs(lng) <= 1e6)
    north, east = F.radians(F.when(ok, lat.cast("double"))), F.radians(F.when(ok, lng.cast("double")))
    df = df.withColumns({px: F.cos(north) * F.cos(east), py: F.cos(north) * F.sin(east), pz: F.sin(north)})
    p = (F.col(px), F.col(py), F.col(pz))
    nearest = F.greatest(*(F.struct((p[0] * c[0] + p[1] * c[1] + p[2] * c[2]).alias("dot"), F.lit(-f).alias("f")) for f, (c, _, _) in enumerate(frames())))
    df = df.withColumn(face, F.when(F.col(px).isNotNull(), -nearest["f"]))

    def dot(axis: int) -> Column:
        return sum(p[n] * _pick([frame[axis][n] for frame in frames()], F.col(face)) for n in range(3))

    scale = ROOT7**level / UNIT
    turn = -TURN if level % 2 else 0.0
    df = df.withColumns({x: dot(1) / dot(0) * scale, y: dot(2) / dot(0) * scale})
    # The nearest lattice point, by rounding three coordinates that sum to 0 and mending the worst.
    tx, ty = (F.col(x) * math.cos(turn) - F.col(y) * math.sin(turn)), (F.col(x) * math.sin(turn) + F.col(y) * math.cos(turn))
    df = df.withColumns({x: tx - ty / ROOT3, y: ty * (2 / ROOT3)})
    q, r = F.col(x), F.col(y)
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    eq, er, es = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    # Steps along the lattice's axes; inline keeps these branches out of the projections that follow.
    df = df.drop(i, j).select("*", F.inline(F.array(F.struct(F.when((eq > er) & (eq > es), -rr - rs).otherwise(rq), F.when((er >= eq) & (er > es), -rq - rs).otherwise(rr)))).alias(i, j))
    start = F.struct((F.col(i) + F.col(j)).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.lit(0).cast("long").alias("digits"))
    levels = F.sequence(F.lit(level), F.lit(1)) if level else F.array().cast("array<int>")

    def up(at: Column, r: Column) -> Column:
        odd, fi, fj = r % 2 == 1, at["i"], at["j"]
        to = F.struct(F.floor((F.when(odd, 3 * fi - fj).otherwise(2 * fi + fj) + 3) / 7.0).alias("i"), F.floor((F.when(odd, fi + 2 * fj).otherwise(3 * fj - fi) + 3) / 7.0).alias("j"))

        def step(to: Column) -> Column:
            ni, nj = to["i"], to["j"]
            left = F.struct((fi - F.when(odd, 2 * ni + nj).otherwise(3 * ni - nj)).alias("i"), (fj - F.when(odd, 3 * nj - ni).otherwise(ni + 2 * nj)).alias("j"))

            def packed(left: Column) -> Column:
                digit = left["i"] * 4 + left["j"] * 2 - F.least(left["i"], left["j"], F.lit(0).cast("long")) * 7
                return F.struct(ni.alias("i"), nj.alias("j"), at["digits"].bitwiseOR(F.call_function("shiftleft", digit, (15 - r) * 3)).alias("digits"))

            return _let(left, packed)

        return _let(to, step)

    df = df.select("*", F.inline(F.array(F.aggregate(levels, start, up))).alias(a, b, digits))
    low = F.least(F.col(a), F.col(b), F.lit(0).cast("long"))
    df = df.withColumn(at, (F.col(face) * 27 + (F.col(a) - low) * 9 + (F.col(b) - low) * 3 - low).cast("int"))
    base, row, rows = digit_turns()
    table = list(range(7))
    turned = list(table)
    for _ in range(5):
        table = [TURNED[d] for d in table]
        turned += table
    steps = F.reverse(levels)

    def digit(r: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.col(digits), (15 - r) * 3).bitwiseAND(long(7)).cast("int")

    def finished(turns: Column) -> Column:
        whole = F.shiftleft(_pick(base, F.col(at)).cast("long"), 45).bitwiseOR(long((1 << 59) | (level << 52) | unused_bits(level)))
        return F.aggregate(steps, whole, lambda cell, r: cell.bitwiseOR(F.call_function("shiftleft", _pick(turned, turns * 7 + digit(r)).cast("long"), (15 - r) * 3)))

    lead = F.coalesce(F.get(F.filter(F.transform(steps, digit), lambda d: d != 0), F.lit(0)), F.lit(0))
    cell = _let(_pick(rows, (_pick(row, F.col(at)) * 7 + lead).cast("int")), finished)
    return df.withColumn(out, cell).drop(px, py, pz, face, x, y, i, j, a, b, digits, at)


def with_lattice(df: DataFrame, cell: Column) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a cell's resolution, base cell, first digit other than 0, and lattice place (i, j) at its
    resolution in the plane of its home face; and the names of these columns."""
    names = dict(zip(("res", "base", "lead", "i", "j"), _names(df, "res", "base", "lead", "i", "j")))
    homes, _, _ = base_cells()
    base = F.shiftrightunsigned(cell, 45).bitwiseAND(long(127)).cast("int")
    df = df.withColumns({names["res"]: resolution(cell), names["base"]: base})
    res, at = F.col(names["res"]), F.col(names["base"])
    levels = F.when(res > 0, F.sequence(F.lit(1), res)).otherwise(F.array().cast("array<int>"))

    def digit(r: Column) -> Column:
        # Shifts by a column: the level's three bits, moved to the lowest place.
        return F.call_function("shiftrightunsigned", cell, (15 - r) * 3).bitwiseAND(long(7)).cast("int")

    def down(place: Column, r: Column) -> Column:
        def stepped(d: Column) -> Column:
            i, j, k = place["i"], place["j"], d.bitwiseAND(F.lit(1))
            di, dj = F.shiftright(d, 2) - k, F.shiftright(d, 1).bitwiseAND(F.lit(1)) - k
            odd = r % 2 == 1
            return F.struct((F.when(odd, 2 * i + j).otherwise(3 * i - j) + di).alias("i"), (F.when(odd, 3 * j - i).otherwise(i + 2 * j) + dj).alias("j"))

        return _let(digit(r), stepped)

    start = F.struct(_pick([h[1] for h in homes], at).cast("long").alias("i"), _pick([h[2] for h in homes], at).cast("long").alias("j"))
    place = F.aggregate(levels, start, down)
    lead = F.coalesce(F.get(F.filter(F.transform(levels, digit), lambda d: d != 0), F.lit(0)), F.lit(0))
    return df.select("*", lead.alias(names["lead"]), F.inline(F.array(place)).alias(names["i"], names["j"])), names


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _scaled(i: Column, j: Column, res: Column) -> Column:
    """The lattice place (i, j) of a resolution in units of resolution 0, as a struct (x, y)."""
    turns = [(math.cos(TURN) / ROOT7**r, math.sin(TURN) / ROOT7**r) if r % 2 else (1 / ROOT7**r, 0.0) for r in range(16)]
    c, s = _pick([t[0] for t in turns], res), _pick([t[1] for t in turns], res)
    x, y = i - j / 2, j * (ROOT3 / 2)
    return F.struct((x * c - y * s).alias("x"), (x * s + y * c).alias("y"))


def _is_pentagon(base: Column) -> Column:
    return base.isin(*sorted(base_cells()[2]))


def _regioned(z: Column, base: Column, lead: Column) -> Column:
    """(x, y, region) of a home plane's point; at a pentagon, a point in the cut is turned out of it, to the side
    away from the cell that it was reached from."""
    x, y = z["x"], z["y"]

    def along(sixths: int, x=x, y=y) -> Column:
        return x * math.cos(SIXTH * sixths) + y * math.sin(SIXTH * sixths)

    edge = F.when(along(1) > 1 + 1e-12, 1).when(along(3) > 1 + 1e-12, 2).when(along(5) > 1 + 1e-12, 3).otherwise(0)
    hexagon = F.struct(x.alias("x"), y.alias("y"), edge.alias("region"))

    def sixth_of(x: Column, y: Column) -> Column:
        return F.rint(F.atan2(y, x) / SIXTH)

    def turned_out(v: Column) -> Column:
        in_cut = (sixth_of(v["x"], v["y"]) == -2) & (F.abs(v["x"]) + F.abs(v["y"]) > 1e-12)
        side = F.when(in_cut, F.when(lead == IK, -1).otherwise(1)).otherwise(0)
        c, s = F.cos(side * SIXTH), F.sin(side * SIXTH)
        return F.struct((v["x"] * c - v["y"] * s).alias("x"), (v["x"] * s + v["y"] * c).alias("y"))

    def sectored(v: Column) -> Column:
        # The sectors' directions, from the home face clockwise: 3, 2, 1, 0, -1 sixths.
        s = sixth_of(v["x"], v["y"])
        region = F.when(s <= -2, 0).otherwise(3 - s).cast("int")
        return F.struct((v["x"] + 2).alias("x"), v["y"].alias("y"), region.alias("region"))

    pentagon = _let(F.struct((x - 2).alias("x"), y.alias("y")), lambda v: _let(turned_out(v), sectored))
    return F.when(_is_pentagon(base), pentagon).otherwise(hexagon)


def _faced(at: Column, base: Column) -> Column:
    """(face, x, y) in the plane of its own face of a home plane's point with its region."""
    key = base * 5 + at["region"]
    table = moves()
    turns = [_turn(s) for _, s, _ in table]
    c, s = _pick([t.real for t in turns], key), _pick([t.imag for t in turns], key)
    x = at["x"] * c - at["y"] * s + _pick([m[2].real for m in table], key)
    y = at["x"] * s + at["y"] * c + _pick([m[2].imag for m in table], key)
    return F.struct(_pick([m[0] for m in table], key).alias("face"), x.alias("x"), y.alias("y"))


def _geographic(at: Column) -> Column:
    """(lng, lat) in degrees of (face, x, y)."""
    p = [_pick([f[0][n] for f in frames()], at["face"]) + UNIT * (at["x"] * _pick([f[1][n] for f in frames()], at["face"]) + at["y"] * _pick([f[2][n] for f in frames()], at["face"])) for n in range(3)]
    return _let(F.struct(*(v.alias(n) for v, n in zip(p, "xyz"))), lambda v: F.struct(F.degrees(F.atan2(v["y"], v["x"])).alias("lng"), F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat")))


def _point(i: Column, j: Column, base: Column, lead: Column, res: Column) -> Column:
    return _let(_scaled(i, j, res), lambda z: _let(_regioned(z, base, lead), lambda at: _let(_faced(at, base), _geographic)))


def with_centre(df: DataFrame, cell: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """``df`` with the latitude and longitude of the cells' centres in degrees."""
    df, n = with_lattice(df, F.col(cell))
    point = _point(*(F.col(n[c]) for c in ("i", "j", "base", "lead", "res")))
    # inline makes columns of the point without computing it for each.
    return df.select("*", F.inline(F.array(F.when(F.col(cell).isNotNull(), point))).alias(lng, lat)).drop(*n.values())


def with_boundary(df: DataFrame, cell: str, out: str = "ring") -> DataFrame:
    """``df`` with the closed boundary ring of each cell, an array of (lng, lat), anticlockwise.

    Five corners at pentagons. At odd resolutions an edge of a cell that crosses an edge of the icosahedron has a
    corner there too.
    """
    df, n = with_lattice(df, F.col(cell))
    i, j, base, lead, res = (F.col(n[c]) for c in ("i", "j", "base", "lead", "res"))
    # Corners in lattice steps: a third of the sum of two neighbouring directions.
    steps = [(2 / 3, 1 / 3), (1 / 3, 2 / 3), (-1 / 3, 1 / 3), (-2 / 3, -1 / 3), (-1 / 3, -2 / 3), (1 / 3, -1 / 3)]
    is_centre = _is_pentagon(base) & (lead == 0)
    all_steps = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.lit(d).alias("d")) for d, (a, b) in enumerate(steps)))
    corners = F.transform(all_steps, lambda s: F.struct((i + s["i"]).alias("i"), (j + s["j"]).alias("j"), s["d"].alias("d")))
    # At a pentagon's centre, the two corners of the cut are one.
    corners = F.when(is_centre, F.filter(corners, lambda s: s["d"] != 4)).otherwise(corners)
    placed = F.transform(corners, lambda s: _let(_scaled(s["i"], s["j"], res), lambda z: F.struct(z.alias("z"), _regioned(z, base, lead).alias("at"))))

    def crossing(a: Column, b: Column) -> Column:
        """Where the straight line from corner to corner leaves its region."""
        p = F.when(_is_pentagon(base), 2.0).otherwise(0.0)
        level = F.when(_is_pentagon(base), 0.0).otherwise(1.0)
        region = F.when(a["at"]["region"] == 0, b["at"]["region"]).otherwise(a["at"]["region"])
        hex_normal = _pick([0.0, 1.0, 3.0, 5.0, 0.0], region)
        # Between two sectors runs a ray from the pentagon; its normal points at the one further clockwise.
        hi = F.greatest(a["at"]["region"], b["at"]["region"])
        wraps = F.abs(a["at"]["region"] - b["at"]["region"]) == 4
        pent_normal = F.when(wraps, F.when(lead == IK, 3.0).otherwise(5.0)).otherwise(2.0 - hi.cast("double"))
        angle = F.when(_is_pentagon(base), pent_normal).otherwise(hex_normal) * SIXTH

        # Across the cut the corners' places in the plane are in line; elsewhere those turned out of it.
        ends = [_let(F.when(wraps, v["z"]).otherwise(F.struct(v["at"]["x"].alias("x"), v["at"]["y"].alias("y"))), lambda z: z) for v in (a, b)]

        def at(line: Column) -> Column:
            def height(z: Column) -> Column:
                return (z["x"] - p) * F.cos(line["n"]) + z["y"] * F.sin(line["n"]) - level

            def met(t: Column) -> Column:
                z = F.struct((line["a"]["x"] + t * (line["b"]["x"] - line["a"]["x"])).alias("x"), (line["a"]["y"] + t * (line["b"]["y"] - line["a"]["y"])).alias("y"))
                place = _let(z, lambda z: _let(_regioned(z, base, lead), lambda r: _geographic(_faced(r, base))))
                # A corner on the edge itself is no crossing.
                return F.when(t.between(1e-9, 1 - 1e-9), F.array(place)).otherwise(F.array().cast("array<struct<lng:double,lat:double>>"))

            return _let(height(line["a"]) / (height(line["a"]) - height(line["b"])), met)

        return _let(F.struct(angle.alias("n"), ends[0].alias("a"), ends[1].alias("b")), at)

    def pieces(ring: Column) -> Column:
        def piece(a: Column, k: Column) -> Column:
            b = F.get(ring, (k + 1) % F.size(ring))
            crosses = (res % 2 == 1) & (a["at"]["region"] != b["at"]["region"])
            own = F.array(_geographic(_faced(a["at"], base)))
            return F.when(crosses, F.concat(own, crossing(a, b))).otherwise(own)

        return F.flatten(F.transform(ring, piece))

    ring = _let(placed, pieces)
    closed = _let(ring, lambda r: F.concat(r, F.array(r[0])))
    return df.withColumn(out, F.when(F.col(cell).isNotNull(), closed)).drop(*n.values())


def neighbours(df: DataFrame, cell: str, level: int, out: str = "neighbour") -> DataFrame:
    """Six rows for each row with the neighbours of its cell of ``level``, five at a pentagon."""
    df, n = with_lattice(df, F.col(cell))
    i, j, base, lead, res = (F.col(n[c]) for c in ("i", "j", "base", "lead", "res"))
    steps = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in ((1, 0), (1, 1), (0, 1), (-1, 0), (0, -1), (-1, -1))))
    is_centre = _is_pentagon(base) & (lead == 0)
    wanted = F.filter(steps, lambda s: ~is_centre | (s["i"] + s["j"] != -2))
    lng, lat = _names(df, "lng", "lat")
    points = F.transform(wanted, lambda s: _point(i + s["i"], j + s["j"], base, lead, res))
    df = df.where(F.col(cell).isNotNull()).select("*", F.inline(points).alias(lng, lat)).drop(*n.values())
    return with_cell(df, F.col(lat), F.col(lng), level, out).drop(lat, lng)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to tasks, by number: a row here is few bytes and much work, and tables of few bytes are one task else."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def _walked(origins: DataFrame, level: int, k: int) -> DataFrame:
    """(origin, at, d) by ``k`` rounds of neighbours."""
    found = origins.select("origin", F.col("origin").alias("at"), F.lit(0).alias("d"))
    edge = found
    for step in range(1, k + 1):
        edge = neighbours(spread(edge), "at", level, "next").select("origin", F.col("next").alias("at"), F.lit(step).alias("d")).distinct()
        found = found.unionByName(edge)
    return found.groupBy("origin", "at").agg(F.min("d").alias("d"))


#: Closer to its centre than this, in units of resolution 0, all cells are of the base cell.
CORE = 0.37


def _flat_places(cells: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Of cells of ``level``: base cell, first digit other than 0, lattice place (i, j), and steps from the base cell's centre."""
    base = (cells >> 45) & 127
    homes = np.array([h[1:] for h in base_cells()[0]], np.int64)
    (i, j), (ci, cj) = homes[base].T, homes[base].T
    lead = np.zeros_like(cells)
    for r in range(1, level + 1):
        d = (cells >> (3 * (15 - r))) & 7
        lead = np.where(lead == 0, d, lead)
        di, dj = (d >> 2) - (d & 1), ((d >> 1) & 1) - (d & 1)
        i, j = (2 * i + j + di, 3 * j - i + dj) if r % 2 else (3 * i - j + di, i + 2 * j + dj)
        ci, cj = (2 * ci + cj, 3 * cj - ci) if r % 2 else (3 * ci - cj, ci + 2 * cj)
    i0, j0 = i - ci, j - cj
    return base, lead, i, j, np.maximum(np.maximum(abs(i0), abs(j0)), abs(i0 - j0))


def _usual(cells: np.ndarray, level: int) -> np.ndarray:
    return ((cells >> 52 & 15) == level) & ((cells >> 45 & 127) < len(HOME_FACES))


def _folded(x: np.ndarray, y: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lattice places of ``level``: the place at level 0 that holds them, the digits down to them, and the first other than 0."""
    digits, lead = np.zeros_like(x), np.zeros_like(x)
    for r in range(level, 0, -1):
        nx, ny = ((3 * x - y + 3) // 7, (x + 2 * y + 3) // 7) if r % 2 else ((2 * x + y + 3) // 7, (3 * y - x + 3) // 7)
        dx, dy = (x - 2 * nx - ny, y - 3 * ny + nx) if r % 2 else (x - 3 * nx + ny, y - nx - 2 * ny)
        d = 4 * dx + 2 * dy - 7 * np.minimum(np.minimum(dx, dy), 0)
        digits |= d << (3 * (15 - r))
        lead = np.where(d > 0, d, lead)
        x, y = nx, ny
    return x, y, digits, lead


def _flat_disk(origins: DataFrame, level: int, k: int, near: int, beyond: bool) -> DataFrame:
    """Members of the disks of cells (origin) of ``level`` further than ``near`` steps from pentagons' centres: (origin, at, d)
    of those in the cell's own base cell (at a pentagon, sector), or, ``beyond``, the places of the others."""
    steps = np.array([(a, b, max(abs(a), abs(b), abs(a - b))) for a in range(-k, k + 1) for b in range(-k, k + 1) if abs(a - b) <= k], np.int64)
    homes, fivefold = np.array([h[1:] for h in base_cells()[0]], np.int64), np.array(sorted(base_cells()[2]))
    whole = (1 << 59) | (level << 52) | unused_bits(level)

    def members(batches):
        for batch in batches:
            cells = batch.column(0).to_numpy()
            cells = cells[_usual(cells, level)]
            base, lead, i, j, far = _flat_places(cells, level)
            pentagon = np.isin(base, fivefold)
            own = ~pentagon | (far > near)
            cells, base, lead, pentagon = (v[own, None] for v in (cells, base, lead, pentagon))
            x, y = i[own, None] + steps[:, 0], j[own, None] + steps[:, 1]
            top_x, top_y, digits, first = _folded(x, y, level)
            inner = (top_x == homes[base, 0]) & (top_y == homes[base, 1]) & (~pentagon | ((first == lead) & (lead > K)))
            rows, places = np.nonzero(~inner if beyond else inner)
            found = {"origin": cells[rows, 0], "d": steps[places, 2].astype(np.int32)}
            if beyond:
                found |= {"base": base[rows, 0].astype(np.int32), "lead": lead[rows, 0].astype(np.int32), "x": x[rows, places], "y": y[rows, places]}
            else:
                found["at"] = whole | (base[rows, 0] << 45) | digits[rows, places]
            yield pa.RecordBatch.from_pydict(found)

    return origins.mapInArrow(members, "origin long, d int, " + ("base int, lead int, x long, y long" if beyond else "at long"))


def _near_pentagons(origins: DataFrame, level: int, near: int) -> DataFrame:
    """Cells (origin) within ``near`` steps of a pentagon's centre, and those of another level."""
    fivefold = np.array(sorted(base_cells()[2]))

    def within(batches):
        for batch in batches:
            cells = batch.column(0).to_numpy()
            usual = _usual(cells, level)
            base, _, _, _, far = _flat_places(cells[usual], level)
            kept = ~usual
            kept[usual] = np.isin(base, fivefold) & (far <= near)
            yield batch.filter(pa.array(kept))

    return origins.mapInArrow(within, "origin long")


def disk(df: DataFrame, cell: str, level: int, k: int, out: str = "member", depth: str = "steps") -> DataFrame:
    """For each distinct cell, the cells within ``k`` steps with the number of steps.

    Away from the pentagons a disk is one of the flat lattice around its cell's place, and each of its places is folded up
    to its digits by whole numbers, a batch of cells at a time. Only places that leave the base cell (at a pentagon, the
    sector) go over the sphere. Near a pentagon's centre, a fixed number of cells, and on coarse levels the disk is walked.
    """
    origins = df.where(F.col(cell).isNotNull()).select(F.col(cell).cast("long").alias("origin")).distinct()
    near = 3 * k + 2
    if near > CORE * ROOT7**level:
        found = _walked(origins, level, k)
    else:
        origins = spread(origins)
        beyond = _flat_disk(origins, level, k, near, True)
        point = _point(F.col("x"), F.col("y"), F.col("base"), F.col("lead"), F.lit(level))
        beyond = with_cell(beyond.select("origin", "d", F.inline(F.array(point)).alias("lng", "lat")), F.col("lat"), F.col("lng"), level, "at")
        flat = _flat_disk(origins, level, k, near, False).unionByName(beyond.select("origin", "d", "at"))
        found = flat.unionByName(_walked(_near_pentagons(origins, level, near), level, k))
    return found.select(F.col("origin").alias(cell), F.col("at").alias(out), F.col("d").alias(depth))


def with_distance(df: DataFrame, a: str, b: str, out: str = "distance") -> DataFrame:
    """``df`` with the grid distance of two cells of one resolution: steps in the plane of one face, or of two that
    share an edge; null for cells further apart or of different resolutions. Paths around a pentagon can be shorter."""
    df, n = with_lattice(df, F.col(a))
    df, m = with_lattice(df, F.col(b))
    at, to = _names(df, "at", "to")
    for name, x in ((at, n), (to, m)):
        i, j, base, lead, res = (F.col(x[c]) for c in ("i", "j", "base", "lead", "res"))
        placed = _let(_scaled(i, j, res), lambda z: _let(_regioned(z, base, lead), lambda r: _faced(r, base)))
        df = df.select("*", F.explode(F.array(placed)).alias(name))
    table = [motions()[f, e] for f in range(20) for e in range(3)]
    turns = [_turn(s) for _, s, _ in table]
    f, g = F.col(at), F.col(to)
    key = F.coalesce(*(F.when(_pick([t[0] for t in table], g["face"] * 3 + e) == f["face"], g["face"] * 3 + e) for e in range(3)))
    c, s = _pick([t.real for t in turns], key), _pick([t.imag for t in turns], key)
    moved = F.when(f["face"] == g["face"], F.struct(g["x"].alias("x"), g["y"].alias("y"))).when(
        key.isNotNull(), F.struct((g["x"] * c - g["y"] * s + _pick([t[2].real for t in table], key)).alias("x"), (g["x"] * s + g["y"] * c + _pick([t[2].imag for t in table], key)).alias("y"))
    )
    res = F.col(n["res"])
    turn, size = F.when(res % 2 == 1, -TURN).otherwise(0.0), F.pow(F.lit(ROOT7), res)

    def steps(v: Column) -> Column:
        x, y = v["x"] - f["x"], v["y"] - f["y"]
        tx, ty = (x * F.cos(turn) - y * F.sin(turn)) * size, (x * F.sin(turn) + y * F.cos(turn)) * size
        dj = F.rint(ty * (2 / ROOT3))
        di = F.rint(tx + ty / ROOT3)
        return F.greatest(F.abs(di), F.abs(dj), F.abs(di - dj)).cast("long")

    return df.withColumn(out, F.when(res == F.col(m["res"]), _let(moved, steps))).drop(at, to, *n.values(), *m.values())


def reach_degrees(level: int) -> float:
    """How far the centre of any cell inside a cell of ``level`` can lie from that cell's centre."""
    return math.degrees(UNIT / (ROOT7 - 1) / ROOT7**level) * 1.01


def with_children(df: DataFrame, cell: str, levels: int, level: int) -> DataFrame:
    """The cells ``levels`` finer than the cells of ``level``; pentagons have no child along the deleted axis."""
    for to in range(level + 1, level + levels + 1):
        shift = 3 * (15 - to)
        base = F.col(cell).bitwiseAND(long(~(15 << 52) & ~(7 << shift))).bitwiseOR(long(to << 52))
        digits = F.shiftrightunsigned(F.col(cell), shift + 3).bitwiseAND(long((1 << (3 * (to - 1))) - 1))
        cut = _is_pentagon(F.shiftrightunsigned(F.col(cell), 45).bitwiseAND(long(127)).cast("int")) & (digits == 0)
        made = [F.when(cut & F.lit(d == K), F.lit(None)).otherwise(base.bitwiseOR(long(d << shift))) for d in range(7)]
        df = df.withColumn(cell, F.explode(F.array_compact(F.array(*made))))
    return df


def cells_in_box(boxes: DataFrame, level: int, out: str = "cell") -> DataFrame:
    """Rows (x0, y0, x1, y1 in degrees, other columns) with each cell of ``level`` whose centre lies in the box, from coarse
    cells to fine ones, one level at a time; boxes don't cross the date line. The 122 coarsest cells are placed once, not for each box."""
    lat, lng = _names(boxes, "lat", "lng")
    first = boxes.sparkSession.range(122).select(F.col("id").bitwiseOR(long(1 << 14)).alias("id")).select((F.shiftleft("id", 45).bitwiseOR(long(unused_bits(0)))).alias(out))
    df = spread(boxes.drop(out)).crossJoin(F.broadcast(with_centre(first, out, lat, lng)))
    at = 0
    while True:
        reach = reach_degrees(at) if at < level else 0.0
        df = with_centre(df, out, lat, lng) if at else df
        near = F.greatest(F.abs(F.col("y0")), F.abs(F.col("y1"))) + reach
        wide = F.when(near >= 89.9, 360.0).otherwise(reach / F.cos(F.radians(F.least(near, F.lit(89.9)))))
        across = F.abs(F.pmod(F.col(lng) - (F.col("x0") + F.col("x1")) / 2 + 180, F.lit(360.0)) - 180) <= (F.col("x1") - F.col("x0")) / 2 + wide
        exact = F.col(lng).between(F.col("x0"), F.col("x1"))
        df = df.where(F.col(lat).between(F.col("y0") - reach, F.col("y1") + reach) & (across if at < level else exact))
        if at == level:
            return df.withColumnsRenamed({lat: "lat", lng: "lng"})
        # Cells of one large box go to many tasks before they are many.
        df = with_children(spread(df.drop(lat, lng)) if at == 2 else df.drop(lat, lng), out, 1, at)
        at += 1


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside closed rings of (x, y) by the even-odd rule, which leaves holes out."""

    def ring_has(ring: Column) -> Column:
        def crossed(acc: Column, k: Column) -> Column:
            a, b = F.get(ring, k - 1), F.get(ring, k)
            cut = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
            return acc != (((a["y"] > y) != (b["y"] > y)) & (x < F.when((a["y"] > y) != (b["y"] > y), cut).otherwise(x)))

        steps = F.when(F.size(ring) > 1, F.sequence(F.lit(1), F.size(ring) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(False), crossed)

    return F.aggregate(rings, F.lit(False), lambda acc, ring: acc != ring_has(ring))


def polygon_cells(polygons: DataFrame, key: str, rings: str, level: int, out: str = "cell") -> DataFrame:
    """Rows (key, cell) of the cells of ``level`` whose centre lies in the polygon: closed rings of (x, y) in degrees, x
    east, holes included as rings. Null or empty rings hold no cell. Polygons don't cross the date line.

    Only boxes travel while cells are refined; the rings join at the end, where a polygon's cells can be split.
    """
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    boxes = polygons.where(F.size(flat) > 0).select(F.col(key).alias("key"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    near = cells_in_box(boxes, level, "cell").select("key", "cell", "lat", "lng")
    shapes = polygons.select(F.col(key).alias("own"), F.col(rings).alias("rings"))
    found = near.join(shapes, F.col("key") == F.col("own")).where(inside(F.col("rings"), F.col("lng"), F.col("lat")))
    return found.select(F.col("key").alias(key), F.col("cell").alias(out))
