"""Spatial joins, overlays, dissolving and buffers (J11, J12, J15, A25, U7, G3, G11) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.functions import globe
from hexagrove.operators import features, shapes
from hexagrove.plans.registry import query, read


def point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def spread(key: str, factor: int, modulus: int, scale: float):
    return F.pmod(F.col(key) * factor, F.lit(modulus)) / scale


def plots(spark, d):
    """Suppliers as tilted four-cornered plots of several sizes on a plane of 100 by 100."""
    x, y, s = spread("s_suppkey", 7919, 1000, 10.0), spread("s_suppkey", 104729, 1000, 10.0), 1 + F.pmod(F.col("s_suppkey"), F.lit(5))
    ring = F.array(*(point(x + s * dx, y + s * dy) for dx, dy in ((0, 0), (2, 0.5), (2.5, 2), (0.5, 1.5), (0, 0))))
    return read(spark, d, "supplier").select("s_suppkey", shapes.shape("polygon", F.array(ring)).alias("plot"))


def roads(spark, d):
    """Parts as short straight lines; every third lies at the same place."""
    third = F.col("p_partkey") % 3 == 0
    x = F.when(third, 50.0).otherwise(spread("p_partkey", 611953, 1000, 10.0))
    y = F.when(third, 50.0).otherwise(spread("p_partkey", 15485863, 1000, 10.0))
    line = F.array(point(x, y), point(x + F.col("p_size") / 20.0, y + 0.7))
    return read(spark, d, "part").select("p_partkey", shapes.shape("line", F.array(line)).alias("road"))


def homes(spark, d):
    """Customers as points."""
    at = point(spread("c_custkey", 611953, 1000, 10.0), spread("c_custkey", 32452843, 1000, 10.0))
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", shapes.shape("point", F.array(F.array(at))).alias("home"))


PLOTS = """plots AS (
  SELECT s_suppkey, (s_suppkey * 7919 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 104729 % 1000) / 10.0::DOUBLE AS y, (1 + s_suppkey % 5)::DOUBLE AS s FROM supplier
), edges AS (
  SELECT s_suppkey, x + s * c[k][1] AS ax, y + s * c[k][2] AS ay, x + s * c[k + 1][1] AS bx, y + s * c[k + 1][2] AS "by"
  FROM plots, (SELECT [[0, 0], [2, 0.5], [2.5, 2], [0.5, 1.5], [0, 0]]::DOUBLE[][] AS c) corners, range(1, 5) steps(k)
)"""
INSIDE = "count(*) FILTER (((ay > y) <> (\"by\" > y)) AND x < (bx - ax) * (y - ay) / nullif(\"by\" - ay, 0) + ax) % 2 = 1"


def side(p: str, q: str, r: str) -> str:
    x, y = ({n: f'"{n}{axis}"' for n in "abcd"} for axis in "xy")
    return f"sign(({x[q]} - {x[p]}) * ({y[r]} - {y[p]}) - ({y[q]} - {y[p]}) * ({x[r]} - {x[p]}))"


@query("J11_spatial_join", f"""WITH {PLOTS}, roads AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 50.0 ELSE (p_partkey * 611953::BIGINT % 1000) / 10.0 END::DOUBLE AS cx, CASE WHEN p_partkey % 3 = 0 THEN 50.0 ELSE (p_partkey * 15485863::BIGINT % 1000) / 10.0 END::DOUBLE AS cy, p_size FROM part
), lines AS (SELECT p_partkey, cx, cy, cx + p_size / 20.0::DOUBLE AS dx, cy + 0.7 AS dy, cx AS x, cy AS y FROM roads),
tested AS (
  SELECT s_suppkey, p_partkey, {INSIDE} AS holds,
    bool_or(greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, "by") >= least(cy, dy) AND greatest(cy, dy) >= least(ay, "by")
      AND {side('a', 'b', 'c')} * {side('a', 'b', 'd')} <= 0 AND {side('c', 'd', 'a')} * {side('c', 'd', 'b')} <= 0) AS meets
  FROM edges, lines GROUP BY s_suppkey, p_partkey
)
SELECT s_suppkey, p_partkey FROM tested WHERE holds OR meets""")
def j11(spark, d):
    return shapes.spatial_join(plots(spark, d), roads(spark, d), "plot", "road", 5.0, most=50).select("s_suppkey", "p_partkey")


@query("J15_spatial_semi", f"""WITH {PLOTS}, homes AS (SELECT c_custkey, (c_custkey * 611953::BIGINT % 1000) / 10.0::DOUBLE AS x, (c_custkey * 32452843::BIGINT % 1000) / 10.0::DOUBLE AS y FROM customer)
SELECT DISTINCT c_custkey FROM (SELECT c_custkey, s_suppkey FROM homes, edges GROUP BY c_custkey, s_suppkey, x, y HAVING {INSIDE} OR bool_or((bx - ax) * (y - ay) = ("by" - ay) * (x - ax) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, "by") AND greatest(ay, "by")))""")
def j15(spark, d):
    return shapes.spatial_semi(homes(spark, d), plots(spark, d), "c_custkey", "home", "plot", 5.0).select("c_custkey")


def boxes(spark, d):
    """Suppliers as upright boxes on the plane."""
    x, y, s = spread("s_suppkey", 7919, 1000, 10.0), spread("s_suppkey", 104729, 1000, 10.0), 1 + F.pmod(F.col("s_suppkey"), F.lit(5)) * 1.5
    ring = F.array(*(point(x + s * dx, y + s * dy) for dx, dy in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))))
    return read(spark, d, "supplier").select("s_suppkey", shapes.shape("polygon", F.array(ring)).alias("plot"))


def squares(spark, d, size: float):
    """Squares of the grid that hold a customer, with the customer's nation."""
    at = homes(spark, d).select("c_nationkey", F.floor(F.col("home")["paths"][0][0]["x"] / size).alias("bx"), F.floor(F.col("home")["paths"][0][0]["y"] / size).alias("by"))
    return at.distinct()


def homes_sql(size: float) -> str:
    return f"squares AS (SELECT DISTINCT c_nationkey, floor((c_custkey * 611953::BIGINT % 1000) / 10.0::DOUBLE / {size})::BIGINT AS bx, floor((c_custkey * 32452843::BIGINT % 1000) / 10.0::DOUBLE / {size})::BIGINT AS \"by\" FROM customer)"


@query("J12_overlay", f"""WITH {homes_sql(2.5)}, grid AS (SELECT DISTINCT bx, "by" FROM squares),
plots AS (SELECT s_suppkey, (s_suppkey * 7919 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 104729 % 1000) / 10.0::DOUBLE AS y, 1 + s_suppkey % 5 * 1.5::DOUBLE AS s FROM supplier),
parts AS (SELECT s_suppkey, bx, "by", (least(x + 2 * s, (bx + 1) * 2.5) - greatest(x, bx * 2.5)) AS w, (least(y + s, ("by" + 1) * 2.5) - greatest(y, "by" * 2.5)) AS h FROM plots, grid)
SELECT s_suppkey, bx, "by", round(w * h, 6) AS common FROM parts WHERE w > 1e-9 AND h > 1e-9 AND w * h > 1e-12""")
def j12(spark, d):
    cells = shapes.squares_as_shapes(squares(spark, d, 2.5).select("bx", "by").distinct(), 2.5)
    return shapes.overlay(boxes(spark, d), cells, "plot", "square", 5.0).select("s_suppkey", "bx", "by", F.round("common", 6).alias("common"))


def geo_plots(spark, d):
    """The plots as polygons of degrees around 55 north, 15 east, in equal-area metres."""
    moved = F.transform(F.col("plot")["paths"], lambda ring: F.transform(ring, lambda p: shapes.equal_area(14 + p["x"] / 100, 54 + p["y"] / 100)))
    return plots(spark, d).select("s_suppkey", shapes.shape("polygon", moved).alias("plot"))


@query("G3_area_share", f"""WITH {PLOTS},
metres AS (SELECT s_suppkey, radians(14 + ax / 100) * 6371007.180918475 AS ax, sin(radians(54 + ay / 100)) * 6371007.180918475 AS ay, radians(14 + bx / 100) * 6371007.180918475 AS bx, sin(radians(54 + "by" / 100)) * 6371007.180918475 AS "by" FROM edges)
SELECT round(sum(ax * "by" - bx * ay) / 2 / 1e6, 3) AS km2, count(DISTINCT s_suppkey) AS n FROM metres""")
def g3(spark, d):
    """The shares of all cells around the plots, times the cells' areas: together the plots' own areas."""
    whole = spark.createDataFrame([(13.9, 53.9, 15.2, 55.3)], "x0 double, y0 double, x1 double, y1 double")
    cells = globe.cells_in_box(whole, 6).select("cell")
    shares = shapes.area_share(geo_plots(spark, d), cells, "plot")
    areas = shapes.cell_shapes(cells).select("cell", shapes.area(F.col("hexagon")["paths"]).alias("own"))
    n = read(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    return shares.join(areas, "cell").agg(F.round(F.sum(F.col("share") * F.col("own")) / 1e6, 3).alias("km2")).join(n)


def outline_sql(source: str, size: float) -> str:
    """Area and length of the outline of squares (g, bx, by): sides without the neighbour's square."""
    sides = " + ".join(f"(SELECT count(*) FROM {source} s WHERE s.g = t.g AND NOT EXISTS (SELECT 1 FROM {source} n WHERE n.g = s.g AND n.bx = s.bx + {a} AND n.\"by\" = s.\"by\" + {b}))" for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return f"SELECT g, round(count(*) * {size * size}, 6) AS area, round(({sides}) * {size}, 6) AS length FROM {source} t GROUP BY g"


def outlines(df, group):
    length = F.aggregate(F.sequence(F.lit(1), F.size("path") - 1), F.lit(0.0), lambda acc, k: acc + F.hypot(F.get("path", k)["x"] - F.get("path", k - 1)["x"], F.get("path", k)["y"] - F.get("path", k - 1)["y"]))
    return df.groupBy(F.col(group).alias("g")).agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum(length), 6).alias("length"))


@query("A25_dissolve", f'WITH {homes_sql(4.0)}, own AS (SELECT c_nationkey AS g, bx, "by" FROM squares) {outline_sql("own", 4.0)}')
def a25(spark, d):
    return outlines(shapes.dissolve(shapes.squares_as_shapes(squares(spark, d, 4.0), 4.0), "c_nationkey", "square"), "c_nationkey")


@query("U7_shape_difference", f"""WITH {homes_sql(5.0)}, two AS (
  SELECT 'difference' AS g, bx, "by" FROM (SELECT DISTINCT bx, "by" FROM squares WHERE c_nationkey % 2 = 0 EXCEPT SELECT bx, "by" FROM squares WHERE c_nationkey % 2 = 1)
  UNION ALL SELECT 'intersection', bx, "by" FROM (SELECT bx, "by" FROM squares WHERE c_nationkey % 2 = 0 INTERSECT SELECT bx, "by" FROM squares WHERE c_nationkey % 2 = 1)
  UNION ALL SELECT 'union', bx, "by" FROM (SELECT DISTINCT bx, "by" FROM squares)
) {outline_sql("two", 5.0)}""")
def u7(spark, d):
    """Union, intersection and difference of two nations' areas as cell sets, and their outlines."""
    own = squares(spark, d, 5.0)
    even, odd = (own.where(F.col("c_nationkey") % 2 == k).select("bx", "by").distinct() for k in (0, 1))
    sets = {"difference": even.join(odd, ["bx", "by"], "left_anti"), "intersection": even.join(odd, ["bx", "by"], "left_semi"), "union": even.union(odd).distinct()}
    parts = [df.withColumn("g", F.lit(g)) for g, df in sets.items()]
    return outlines(shapes.dissolve(shapes.squares_as_shapes(parts[0].union(parts[1]).union(parts[2]), 5.0), "g", "square"), "g")


@query("G11_buffer", f"""WITH {PLOTS}, near AS (
  SELECT s_suppkey % 5 AS g, s_suppkey, bx, "by" AS gy, ax, ay, ex, ey, (bx + 0.5) * 1.0 AS px, ("by" + 0.5) * 1.0 AS py
  FROM (SELECT s_suppkey, ax, ay, bx AS ex, "by" AS ey FROM edges) e, range(-4, 125) us(bx), range(-4, 125) vs("by")
), measured AS (
  SELECT *, greatest(0, least(1, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / ((ex - ax) ** 2 + (ey - ay) ** 2))) AS t FROM near
), reached AS (
  SELECT g, bx, gy AS "by" FROM measured GROUP BY g, s_suppkey, bx, gy, px, py
  HAVING min((px - ax - t * (ex - ax)) ** 2 + (py - ay - t * (ey - ay)) ** 2) <= 2.25 OR count(*) FILTER (((ay > py) <> (ey > py)) AND px < (ex - ax) * (py - ay) / nullif(ey - ay, 0) + ax) % 2 = 1
), own AS (SELECT DISTINCT g, bx, "by" FROM reached) {outline_sql("own", 1.0)}""")
def g11(spark, d):
    """The plots of each of five groups with all within 1.5 of them, and the outline's length."""
    grouped = plots(spark, d).withColumn("g", F.col("s_suppkey") % 5)
    return outlines(shapes.buffered(grouped, "g", "plot", 1.5, 1.0), "g")


@query("G15_simplify")
def g15(spark, d):
    """Outlines of the nations' areas, simplified; the tests measure that no point left out is further than the tolerance."""
    outline = shapes.dissolve(shapes.squares_as_shapes(squares(spark, d, 4.0), 4.0), "c_nationkey", "square")
    return shapes.simplified(outline, "path", 4.5).select("c_nationkey", F.size("path").alias("points"))


def feature_cells(spark, d):
    """Squares of 10 by 10 over the plane, named by their number."""
    key = (F.col("by") * 10 + F.col("bx")).alias("cell")
    grid = read(spark, d, "region").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bx")).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return shapes.squares_as_shapes(grid, 10.0).select(key, "square")


def off_grid(key: str, a: int, b: int):
    """A place that lies on no square's side."""
    return spread(key, a, 1000, 10.0) + 0.037, spread(key, b, 1000, 10.0) + 0.041


@query("G10_feature_matrix", """WITH cells AS (SELECT "by" * 10 + bx AS cell, bx * 10.0::DOUBLE AS x, "by" * 10.0::DOUBLE AS y FROM range(0, 10) us(bx), range(0, 10) vs("by")),
boxes AS (SELECT (s_suppkey * 7919 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 104729 % 1000) / 10.0::DOUBLE AS y, 1 + s_suppkey % 5 * 1.5::DOUBLE AS s FROM supplier),
shares AS (SELECT cell, sum(greatest(0, least(c.x + 10, b.x + 2 * s) - greatest(c.x, b.x)) * greatest(0, least(c.y + 10, b.y + s) - greatest(c.y, b.y))) / 100 AS share FROM cells c, boxes b GROUP BY cell),
mills AS (SELECT (s_suppkey * 611953::BIGINT % 1000) / 10.0::DOUBLE + 0.037 AS x, (s_suppkey * 7919 % 1000) / 10.0::DOUBLE + 0.041 AS y FROM supplier),
wind AS (SELECT cell, ln(1 + min(sqrt((c.x + 5 - m.x) ** 2 + (c.y + 5 - m.y) ** 2))) AS d FROM cells c, mills m GROUP BY cell),
people AS (SELECT floor(((c_custkey * 32452843::BIGINT % 1000) / 10.0::DOUBLE + 0.041) / 10)::BIGINT * 10 + floor(((c_custkey * 611953::BIGINT % 1000) / 10.0::DOUBLE + 0.037) / 10)::BIGINT AS cell, sum(c_nationkey) AS n FROM customer GROUP BY 1),
heights AS (SELECT floor(((p_partkey * 104729::BIGINT % 1000) / 10.0::DOUBLE + 0.041) / 10)::BIGINT * 10 + floor(((p_partkey * 7919::BIGINT % 1000) / 10.0::DOUBLE + 0.037) / 10)::BIGINT AS cell, max(p_size) - min(p_size) AS relief FROM part WHERE p_size > 30 GROUP BY 1)
SELECT cell, round(share, 8) AS protected_share, round(d, 8) AS dist_turbine_log, round(ln(1 + coalesce(n, 0)), 8) AS persons_log, coalesce(relief, 0)::DOUBLE AS relief FROM cells JOIN shares USING (cell) JOIN wind USING (cell) LEFT JOIN people USING (cell) LEFT JOIN heights USING (cell)""")
def g10(spark, d):
    """Protected boxes, turbines, people and points of height on a hundred squares."""
    cells = feature_cells(spark, d)
    x, y = off_grid("s_suppkey", 611953, 7919)
    mills = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("x"), y.alias("y"))
    x, y = off_grid("c_custkey", 611953, 32452843)
    people = read(spark, d, "customer").select(shapes.shape("point", F.array(F.array(point(x, y)))).alias("at"), "c_nationkey")
    x, y = off_grid("p_partkey", 7919, 104729)
    heights = read(spark, d, "part").where("p_size > 30").select(shapes.shape("point", F.array(F.array(point(x, y)))).alias("at"), F.col("p_size").alias("KOTE"))
    out = features.feature_matrix(cells, "cell", features.protected_share(cells, boxes(spark, d), "cell", "square", "plot", 10.0), features.turbines(cells, mills, "cell", "square", 10.0), features.people(cells, people, "cell", "square", "at", "c_nationkey", 10.0), features.elevation(cells, heights, "cell", "square", "at", 10.0))
    return out.select("cell", *(F.round(c, 8).alias(c) for c in ("protected_share", "dist_turbine_log", "persons_log")), "relief")
