"""Aggregates (A), hexagon functions (H) and contingency statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.functions import hexgrid
from hexagrove.functions.scalars import class_of
from hexagrove.operators import statistics as st
from hexagrove.plans.inputs import PART_CELLS, cell_sql, class_sql, parent_sql, part_cells
from hexagrove.plans.registry import query, read


@query("A1_class_summary", "SELECT l_returnflag AS class, count(*) AS n, round_even(avg(l_quantity), 2) AS mean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def a1(spark, d):
    return st.class_summary(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "class"), "class", "l_quantity")


@query("A2_count_mean", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1")
def a2(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 3).alias("mean"))


@query("A3_conditional_count", "SELECT p_brand, count(*) FILTER (p_size * 2 >= 65) AS n_high, count(*) AS n FROM part GROUP BY 1")
def a3(spark, d):
    high = class_of(F.col("p_size") * 2.0, st.BREAKS).isin("high", "very_high")
    return read(spark, d, "part").groupBy("p_brand").agg(F.count_if(high).alias("n_high"), F.count(F.lit(1)).alias("n"))


@query(
    "A4_cell_rollup",
    f"""WITH {PART_CELLS}, up AS (SELECT {parent_sql("cell", 7)} AS cell, score, p_type FROM cells),
    modes AS (SELECT cell, p_type, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, p_type) AS k FROM up GROUP BY 1, 2),
    agg AS (SELECT cell, count(*) AS source_child_count, round_even(avg(score), 1) AS score, round_even(avg(CASE WHEN score >= 65 THEN 1.0 ELSE 0 END), 3) AS high_potential_share FROM up GROUP BY 1)
    SELECT agg.cell, source_child_count, score, high_potential_share, p_type, {class_sql("score")} AS class, 7 AS h3_resolution, 9 AS source_resolution FROM agg JOIN modes ON agg.cell = modes.cell AND k = 1""",
)
def a4(spark, d):
    return st.rollup(part_cells(spark, d), 7, types=("p_type",))


@query("A6_smallest_mode", "SELECT p_brand, p_type AS mode FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def a6(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.mode("p_type", True).alias("mode"))


@query(
    "A7_area_rollup",
    f"SELECT {parent_sql(cell_sql('l_partkey'), 7)} AS cell, round(sum(l_quantity), 4) AS area, round(least(100.0, greatest(0.0, sum(l_quantity) / 5160 * 100)), 4) AS share_pct FROM lineitem GROUP BY 1",
)
def a7(spark, d):
    up = read(spark, d, "lineitem").groupBy(hexgrid.parent(hexgrid.synthetic_cell(F.col("l_partkey")), 7).alias("cell")).agg(F.sum("l_quantity").alias("a"))
    return up.select("cell", F.round("a", 4).alias("area"), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("a") / 5160 * 100)), 4).alias("share_pct"))


@query("A9_label_list", "SELECT n_regionkey, array_to_string(list_slice(list_sort(list_distinct(list(n_name))), 1, 3), ', ') AS labels FROM nation GROUP BY 1")
def a9(spark, d):
    return st.labels_of(read(spark, d, "nation"), "n_regionkey", "n_name")


@query("A11_min_median_max", "SELECT l_returnflag, min(l_extendedprice) AS low, median(l_extendedprice) AS mid, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def a11(spark, d):
    return st.group_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"low": (0.0, 7), "mid": (0.5, 7), "high": (1.0, 7)})


@query("A12_share_of_total", "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1")
def a12(spark, d):
    counts = read(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    return st.with_share(counts, "n").withColumn("share", F.round("share", 6))


@query("A13_many_means", "SELECT l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def a13(spark, d):
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_quantity"), 4).alias("l_quantity"), *(F.round(F.avg(c), 6).alias(c) for c in ("l_discount", "l_tax")))


@query(
    "A14_area_weighted_mean",
    "SELECT l_returnflag AS k, round(sum(v * l_quantity) / sum(l_quantity) FILTER (v IS NOT NULL), 6) AS mean, round(coalesce(sum(l_quantity) FILTER (v IS NOT NULL), 0) / sum(l_quantity) * 100, 4) AS coverage_pct FROM (SELECT *, CASE WHEN l_tax > 0.02 THEN l_discount END AS v FROM lineitem) GROUP BY 1",
)
def a14(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("v"), "l_quantity")
    return st.area_weighted_mean(li, "k", "v", "l_quantity").select("k", F.round("mean", 6).alias("mean"), F.round("coverage_pct", 4).alias("coverage_pct"))


@query("A15_potential_by_type", "SELECT p_type, round(sum(p_retailprice), 2) AS area, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER () * 100, 4) AS pct FROM part GROUP BY 1")
def a15(spark, d):
    by = read(spark, d, "part").groupBy("p_type").agg(F.sum("p_retailprice").alias("area"))
    return st.with_share(by, "area", out="pct").select("p_type", F.round("area", 2).alias("area"), F.round(F.col("pct") * 100, 4).alias("pct"))


@query("A17_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def a17(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query(
    "A18_adjusted_rand",
    """WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2),
    s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM c),
    a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY quality)),
    b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY toxic))
    SELECT round((s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 9) AS ari, t::BIGINT AS n FROM s, a, b""",
)
def a18(spark, d):
    return st.adjusted_rand(read(spark, d, "labels"), "quality", "toxic").select(F.round("ari", 9).alias("ari"), "n")


@query("A19_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.9) AS q90, quantile_cont(l_extendedprice, 0.95) AS q95, quantile_cont(l_extendedprice, 0.995) AS q995 FROM lineitem GROUP BY 1")
def a19(spark, d):
    return st.group_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q90": (0.9, 7), "q95": (0.95, 7), "q995": (0.995, 7)})


@query(
    "A19_quantile_type8",
    """WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)),
    h AS (SELECT *, (n + 1/3) * 0.99 + 1/3 AS p FROM r)
    SELECT p_brand, round(max(v) FILTER (i = greatest(1, least(n, floor(p)))) + (max(v) FILTER (i = greatest(1, least(n, floor(p) + 1))) - max(v) FILTER (i = greatest(1, least(n, floor(p))))) * max(p - floor(p)), 6) AS quantile FROM h GROUP BY 1""",
)
def a19b(spark, d):
    return st.quantile_type8(read(spark, d, "part"), "p_retailprice", 0.99, ["p_brand"]).withColumn("quantile", F.round("quantile", 6))


@query("A20_hits_or_zero", "SELECT c_custkey, coalesce(sum(o_totalprice), 0) > 0 AS any_hit, count(o_orderkey) AS n, coalesce(max(o_totalprice), 0) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a20(spark, d):
    hits = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.sum("o_totalprice").alias("s"))
    out = read(spark, d, "customer").select("c_custkey").join(hits, "c_custkey", "left")
    return out.select("c_custkey", (F.coalesce("s", F.lit(0.0)) > 0).alias("any_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("A21_string_agg", "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def a21(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("names"))


@query("A22_distinct_any", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, bool_or(o_orderstatus = 'P') AS any_pending FROM orders GROUP BY 1")
def a22(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"))


@query(
    "A23_category_profile",
    """WITH g AS (SELECT lang, source, sum(n_chars) AS w FROM documents GROUP BY 1, 2), r AS (SELECT *, w / sum(w) OVER (PARTITION BY lang) AS share, row_number() OVER (PARTITION BY lang ORDER BY w DESC, source) AS rank FROM g)
    SELECT lang, source, w::BIGINT AS w, round(share, 6) AS share, share >= 0.05 AS significant, rank::INTEGER AS rank FROM r WHERE rank <= 8""",
)
def a23(spark, d):
    by = read(spark, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("w"))
    top = st.top_per_group(st.with_share(by, "w", ["lang"]), ["lang"], 8, F.desc("w"), F.col("source"))
    return top.select("lang", "source", "w", F.round("share", 6).alias("share"), (F.col("share") >= 0.05).alias("significant"), "rank")


@query("A24_class_area", "SELECT p_size AS class, count(*) * 0.25::DOUBLE AS area FROM part GROUP BY 1")
def a24(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_size").alias("class")).agg((F.count(F.lit(1)) * 0.25).alias("area"))


@query(
    "A26_long_metrics",
    "UNPIVOT (SELECT l_returnflag AS scenario, count(*)::DOUBLE AS n, round(avg(l_quantity), 4) AS mean_quantity, max(l_extendedprice) AS top FROM lineitem GROUP BY 1) ON n, mean_quantity, top INTO NAME metric VALUE value",
)
def a26(spark, d):
    wide = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scenario")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.max("l_extendedprice").alias("top"))
    return wide.unpivot(["scenario"], ["n", "mean_quantity", "top"], "metric", "value")


@query("A27_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS c_qp, round(corr(l_quantity, l_discount), 8) AS c_qd, round(corr(l_extendedprice, l_tax), 8) AS c_pt FROM lineitem")
def a27(spark, d):
    pairs = (("c_qp", "l_quantity", "l_extendedprice"), ("c_qd", "l_quantity", "l_discount"), ("c_pt", "l_extendedprice", "l_tax"))
    return read(spark, d, "lineitem").agg(*(F.round(F.corr(a, b), 8).alias(n) for n, a, b in pairs))


@query(
    "A28_dominant_class",
    """WITH g AS (SELECT l_suppkey, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, class) AS k FROM g)
    SELECT l_suppkey, class, n, round(share, 6) AS share FROM r WHERE k = 1""",
)
def a28(spark, d):
    by = read(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("l_suppkey").agg(F.sum("n").alias("t"), F.max_by(F.struct("class", "n"), F.struct("n", (-F.ascii("class")).alias("o"))).alias("m"))
    return top.select("l_suppkey", "m.class", "m.n", F.round(F.col("m.n") / F.col("t"), 6).alias("share"))


@query("H1_parent", f"SELECT p_partkey, {parent_sql(cell_sql('p_partkey'), 8)} AS r8, {parent_sql(cell_sql('p_partkey'), 6)} AS r6, lower(to_hex({cell_sql('p_partkey')})) AS hex_id FROM part")
def h1(spark, d):
    cell = hexgrid.synthetic_cell(F.col("p_partkey"))
    return read(spark, d, "part").select("p_partkey", hexgrid.parent(cell, 8).alias("r8"), hexgrid.parent(cell, 6).alias("r6"), hexgrid.text_id(cell).alias("hex_id"))


@query("H2_resolution", f"SELECT ({parent_sql(cell_sql('s_suppkey'), 7)} >> 52 & 15)::INTEGER AS resolution, count(*) AS n FROM supplier GROUP BY 1")
def h2(spark, d):
    cell = hexgrid.parent(hexgrid.synthetic_cell(F.col("s_suppkey")), 7)
    return read(spark, d, "supplier").groupBy(hexgrid.resolution(cell).alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "H3_children_even_split",
    f"""WITH p AS (SELECT s_suppkey, {cell_sql("s_suppkey")} AS cell, s_acctbal FROM supplier)
    SELECT s_suppkey, ((cell & ({~(hexgrid.RESOLUTION_MASK | (7 << 15))})::BIGINT) | (10::BIGINT << 52) | (d::BIGINT << 15)) AS child, round(s_acctbal / 7, 8) AS population FROM p, range(7) t(d)""",
)
def h3(spark, d):
    sup = read(spark, d, "supplier").select("s_suppkey", hexgrid.synthetic_cell(F.col("s_suppkey")).alias("cell"), "s_acctbal")
    return hexgrid.children(sup, "cell", 10, 9).select("s_suppkey", "child", F.round(F.col("s_acctbal") / hexgrid.child_count(9, 10), 8).alias("population"))


@query("H5_center_child", f"SELECT s_suppkey, (({cell_sql('s_suppkey')} & ({~(hexgrid.RESOLUTION_MASK | (63 << 12))})::BIGINT) | (11::BIGINT << 52)) AS center FROM supplier")
def h5(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", hexgrid.center_child(hexgrid.synthetic_cell(F.col("s_suppkey")), 11).alias("center"))
