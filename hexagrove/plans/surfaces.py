"""Surfaces, numeric classes and factor models (G17 to G19, M16, X6 to X8) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.operators import classes, factors, rasters
from hexagrove.plans.registry import query, read
from hexagrove.plans.shapes import outline_sql, outlines


def dem(spark, d):
    """Parts as a raster 50 cells wide: price as height."""
    key = F.col("p_partkey")
    return read(spark, d, "part").select(F.floor(key / 50).alias("row"), (key % 50).alias("col"), F.col("p_retailprice").cast("double").alias("height"))


DEM = "dem AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_retailprice::DOUBLE AS z FROM part)"


@query("G17_terrain", f"""WITH {DEM}, around AS (
  SELECT a.r, a.c, a.z, avg(b.z) AS local_mean, count(*) FILTER (abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1) AS near,
    sum(CASE WHEN abs(b.r - a.r) <= 1 AND abs(b.c - a.c) = 1 THEN (b.c - a.c) * (2 - abs(b.r - a.r)) * b.z ELSE 0 END) / (8 * 25.0) AS dx,
    sum(CASE WHEN abs(b.c - a.c) <= 1 AND abs(b.r - a.r) = 1 THEN (b.r - a.r) * (2 - abs(b.c - a.c)) * b.z ELSE 0 END) / (8 * 25.0) AS dy
  FROM dem a JOIN dem b ON b.r BETWEEN a.r - 10 AND a.r + 10 AND b.c BETWEEN a.c - 10 AND a.c + 10 GROUP BY a.r, a.c, a.z
)
SELECT r AS "row", c AS col, round(CASE WHEN near = 9 THEN degrees(atan(sqrt(dx * dx + dy * dy))) END, 6) AS slope, round(local_mean, 6) AS local_mean, round(greatest(local_mean - z, 0), 6) AS valley_depth FROM around""")
def g17(spark, d):
    """Tiles of 16 cells, so that borders of tiles run through the test table."""
    out = rasters.terrain(dem(spark, d), "height", 25.0, size=16)
    return out.select("row", "col", *(F.round(n, 6).alias(n) for n in ("slope", "local_mean", "valley_depth")))


@query("G17_surface", """WITH points AS (
  SELECT (s_suppkey * 7919 % 5000)::DOUBLE AS x, (s_suppkey * 104729 % 5000)::DOUBLE AS y, s_acctbal::DOUBLE AS z FROM supplier
), near AS (
  SELECT c, r, z, ((c + 0.5) * 50 - x) ** 2 + ((r + 0.5) * 50 - y) ** 2 AS d2 FROM points, range(-6, 106) cs(c), range(-6, 106) rs(r)
)
SELECT r AS "row", c AS col, round(coalesce(avg(z) FILTER (d2 = 0), sum(z / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0)), 6) AS height FROM near WHERE d2 <= 62500 GROUP BY r, c""")
def g17_surface(spark, d):
    points = read(spark, d, "supplier").select(F.pmod(F.col("s_suppkey") * 7919, F.lit(5000)).cast("double").alias("x"), F.pmod(F.col("s_suppkey") * 104729, F.lit(5000)).cast("double").alias("y"), F.col("s_acctbal").alias("z"))
    return rasters.interpolated(points, "x", "y", "z", 50.0, 250.0, "height").withColumn("height", F.round("height", 6))


def kinds(spark, d):
    """Parts as a raster of four classes; cells of some sizes are unknown."""
    key = F.col("p_partkey")
    return read(spark, d, "part").select(F.floor(key / 50).alias("row"), (key % 50).alias("col"), F.when(F.col("p_size") % 3 == 0, (F.col("p_size") % 4).cast("double")).alias("kind"))


def majority_sql(source: str, tag: str, reach: int, only_empty: bool) -> str:
    votes = f"SELECT a.r, a.c, b.k, count(*) AS n FROM {source} a JOIN {source} b ON b.r BETWEEN a.r - {reach} AND a.r + {reach} AND b.c BETWEEN a.c - {reach} AND a.c + {reach} WHERE b.k IS NOT NULL GROUP BY a.r, a.c, b.k"
    best = f"SELECT r, c, k FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY n DESC, k) = 1"
    value = "coalesce(s.k, m.k)" if only_empty else "m.k"
    return f"{tag} AS MATERIALIZED (SELECT s.r, s.c, {value} AS k FROM {source} s LEFT JOIN ({best}) m ON m.r = s.r AND m.c = s.c)"


CLEAN = ",\n".join(("k0 AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CASE WHEN p_size % 3 = 0 THEN (p_size % 4)::DOUBLE END AS k FROM part)", *(majority_sql(f"k{n}", f"k{n + 1}", 1, True) for n in range(3)), majority_sql("k3", "clean", 1, False)))


def clean(spark, d):
    return rasters.smoothed(rasters.filled(kinds(spark, d), "kind", passes=3, reach=1, size=16), "kind", size=16)


@query("G18_modal_fill", f'WITH {CLEAN} SELECT r AS "row", c AS col, k AS kind FROM clean')
def g18(spark, d):
    return clean(spark, d)


@query("G19_polygonise", f'WITH {CLEAN}, own AS (SELECT k AS g, c AS bx, r AS "by" FROM clean WHERE k IS NOT NULL) {outline_sql("own", 10.0)}')
def g19(spark, d):
    return outlines(rasters.polygonised(clean(spark, d), "kind", 10.0), "kind")


@query("M16_quantile_bins", """WITH v AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS x FROM lineitem),
q AS (SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS b, min(x) AS low, max(x) AS high FROM v)
SELECT CASE WHEN x <= b[1] THEN 1 WHEN x <= b[2] THEN 2 WHEN x <= b[3] THEN 3 ELSE 4 END::INT AS bin, count(*) AS n, round(min(x), 4) AS low, round(max(x), 4) AS high FROM v, q GROUP BY 1""")
def m16_quantiles(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"))
    out = classes.binned(li, "x", classes.quantile_breaks(li, "x", 4))
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 4).alias("low"), F.round(F.max("x"), 4).alias("high"))


@query("Y12_natural_breaks", """WITH v AS (SELECT l_quantity::DOUBLE AS x, count(*) AS n FROM lineitem GROUP BY 1), ends AS (SELECT x FROM v),
pairs AS (SELECT a.x AS a, b.x AS b FROM ends a JOIN ends b ON a.x < b.x AND b.x < (SELECT max(x) FROM v)),
classed AS (SELECT a, b, CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 ELSE 3 END AS class, sum(n) AS n, sum(n * x) AS s, sum(n * x * x) AS s2 FROM pairs, v GROUP BY ALL),
best AS (SELECT a, b FROM classed GROUP BY a, b ORDER BY round(sum(s2 - s * s / n), 4), b, a LIMIT 1)
SELECT CASE WHEN x <= a THEN 1 WHEN x <= b THEN 2 ELSE 3 END::INT AS bin, sum(n)::BIGINT AS n, min(x) AS low, max(x) AS high FROM v, best GROUP BY 1""")
def y12(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"))
    out = classes.binned(li, "x", classes.natural_breaks(classes.histogram(li, "x"), 3))
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("X6_factor_scores", """WITH v AS (SELECT range AS i FROM range(1, 6)), n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'F' || a.i AS one, 'F' || b.i AS two, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS correlation, n FROM v a, v b, n""")
def x6_scores(spark, d):
    """The correlations of the scores of all rows, which are those of the factors exactly."""
    emb = read(spark, d, "embeddings")
    matrix = factors.correlation(factors.vectors(emb, "embedding"))[1]
    out = factors.scores(emb, "vec_id", "embedding", factors.score_weights(matrix, factors.varimax(factors.principal_axes(matrix, 5))))
    pairs = [(a, b) for a in range(1, 6) for b in range(1, 6)]
    sums = out.agg(F.count(F.lit(1)).alias("n"), *((F.round(F.corr(f"F{a}", f"F{b}"), 6) + 0.0).alias(f"c{a}{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(f"F{a}").alias("one"), F.lit(f"F{b}").alias("two"), F.col(f"c{a}{b}").alias("correlation")) for a, b in pairs))
    return sums.select("n", F.inline(rows).alias("one", "two", "correlation"))


@query("X7_oblique_rotation")
def x7(spark, d):
    """Oblique loadings, factor correlations and congruence; the tests find a planted oblique structure."""
    return factors.oblique(read(spark, d, "embeddings"), "embedding", 5)


@query("X8_factor_count_sweep")
def x8(spark, d):
    """Fit indices of 2 to 7 factors; the tests compare them with a planted number of factors."""
    return factors.factor_sweep(read(spark, d, "embeddings"), "embedding", range(2, 8))
