"""Projections and filters (P), joins (J), set operations and reshaping (U), scans (S) and sinks (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.functions import scalars as sc
from hexagrove.operators import frames as fr
from hexagrove.operators.statistics import BREAKS
from hexagrove.plans.inputs import DISTANCES, PART_CELLS, class_sql, distances, parent_sql, part_cells
from hexagrove.plans.registry import query, read


@query("S9_pruned_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'R'")
def s9(spark, d):
    return read(spark, d, "lineitem").where("l_quantity < 3 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("S10_resolved_columns", "SELECT n_nationkey AS id, n_name AS label FROM nation")
def s10(spark, d):
    nation = read(spark, d, "nation")
    found = fr.resolve_columns(nation.columns, {"id": ["nation_id", "N_NATIONKEY"], "label": ["n_label", "n_name"]})
    return fr.project(nation, {old: new for new, old in found.items()})


@query("P1_config_projection", "SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier")
def p1(spark, d):
    return fr.project(read(spark, d, "supplier"), {"s_suppkey": "id", "s_acctbal": "balance"})


@query("P2_columns_by_pattern", "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem")
def p2(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey"), read(spark, d, "lineitem").colRegex("`l_line.*`"))


@query("P3_reindex", "SELECT r_name, NULL::VARCHAR AS missing, r_regionkey FROM region")
def p3(spark, d):
    return fr.reindex(read(spark, d, "region"), ["r_name", "missing", "r_regionkey"])


@query("P4_in_filter", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def p4(spark, d):
    return fr.in_filter(fr.in_filter(read(spark, d, "customer"), "c_mktsegment", [" Building", "MACHINERY"]), "absent", ["x"]).select("c_custkey")


@query("P5_clusters", "SELECT vec_id FROM embeddings WHERE label IN (1, 3)")
def p5(spark, d):
    return read(spark, d, "embeddings").where(F.col("label").isin(1, 3)).select("vec_id")


@query("P6_semi_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def p6(spark, d):
    shown = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(shown, "o_custkey", "left_semi").select("o_orderkey")


@query("P7_active_rows", "SELECT l_linestatus, count(*) FILTER (coalesce(l_discount, 0) + coalesce(l_tax, 0) > 0) AS active, count(*) FILTER (coalesce(l_discount, 0) + coalesce(l_tax, 0) <= 0) AS excluded FROM lineitem GROUP BY 1")
def p7(spark, d):
    on, off = fr.active_rows(read(spark, d, "lineitem"), ["l_discount", "l_tax"])
    both = fr.stack(on.select("l_linestatus", F.lit(1).alias("a"), F.lit(0).alias("x")), off.select("l_linestatus", F.lit(0).alias("a"), F.lit(1).alias("x")))
    return both.groupBy("l_linestatus").agg(F.sum("a").alias("active"), F.sum("x").alias("excluded"))


@query("P9_flag_filter", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def p9(spark, d):
    return read(spark, d, "labels").where(sc.truthy(F.col("quality")) & ~sc.truthy(F.col("toxic"))).select("doc_id")


@query("P10_complete_cases", "SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS v FROM part) WHERE v IS NOT NULL")
def p10(spark, d):
    return read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("v")).dropna(subset=["v"])


@query("P11_varying_columns", "SELECT p_partkey, p_size FROM part")
def p11(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_size", F.lit(1.0).alias("flat"), F.lit(None).cast("double").alias("void"))
    return part.select("p_partkey", *fr.varying_columns(part, ["p_size", "flat", "void"]))


@query("P12_finite", "SELECT s_suppkey, CASE WHEN s_nationkey <> 0 THEN s_acctbal END AS ratio FROM supplier")
def p12(spark, d):
    wild = F.when(F.col("s_nationkey") == 0, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    return read(spark, d, "supplier").select("s_suppkey", sc.finite(wild).alias("ratio"))


@query("P13_case_chain", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 200000 THEN 'large' ELSE 'other' END AS kind FROM orders")
def p13(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_totalprice") > 200000, "large").otherwise("other")
    return read(spark, d, "orders").select("o_orderkey", kind.alias("kind"))


@query("P14_class_breaks", f"WITH {PART_CELLS} SELECT p_partkey, {class_sql('(score - 1)')} AS class FROM cells")
def p14(spark, d):
    return part_cells(spark, d).select("p_partkey", sc.class_of(F.col("score") - 1, BREAKS).alias("class"))


@query("P15_upper_bounds", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'a' WHEN l_quantity <= 25 THEN 'b' ELSE 'c' END AS class FROM lineitem")
def p15(spark, d):
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", sc.bounded_class(F.col("l_quantity"), [(10, "a"), (25, "b")], "c").alias("class"))


@query("P16_numeric_split", "SELECT vec_id, CASE WHEN label = 3 AND embedding[1] >= 0.05 THEN '3a' WHEN label = 3 THEN '3b' ELSE label::VARCHAR END AS type FROM embeddings")
def p16(spark, d):
    e = F.col("embedding")[0]
    kind = F.when((F.col("label") == 3) & (e >= F.lit(0.05).cast("double")), "3a").when(F.col("label") == 3, "3b").otherwise(F.col("label").cast("string"))
    return read(spark, d, "embeddings").select("vec_id", kind.alias("type"))


@query("P17_attribute_split", "SELECT p_partkey FROM part WHERE lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) = 'small_ring'")
def p17(spark, d):
    return read(spark, d, "part").where(sc.slug(F.col("p_name")) == sc.slug(F.lit("Small  ring"))).select("p_partkey")


@query("P18_first_by_key", "SELECT p_brand, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def p18(spark, d):
    return fr.first_by_key(read(spark, d, "part"), ["p_brand"], F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_type")


@query("P19_area_threshold", "SELECT l_suppkey, round(sum(l_quantity), 4) AS area FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 1000")
def p19(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("a")).where("a > 1000").select("l_suppkey", F.round("a", 4).alias("area"))


@query("P20_channel_ranges", "SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.2 AND embedding[2] > 0 AND embedding[3] < 0.1")
def p20(spark, d):
    r, g, b = (F.col("embedding")[i].cast("double") for i in range(3))
    return read(spark, d, "embeddings").where(r.between(-0.1, 0.2) & (g > 0) & (b < 0.1)).select("vec_id")


@query("P22_whitelist", "SELECT l_orderkey, list_sort(list_intersect(list_distinct(list(l_returnflag)), ['A', 'R'])) AS layers FROM lineitem GROUP BY 1")
def p22(spark, d):
    by = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return by.select("l_orderkey", F.array_sort(F.array_intersect("f", F.array(F.lit("A"), F.lit("R")))).alias("layers"))


@query("P23_band_one_hot", "SELECT p_partkey, (p_size > 10 AND p_size <= 20)::INT::DOUBLE AS low, (p_size > 20 AND p_size <= 40)::INT::DOUBLE AS mid FROM part")
def p23(spark, d):
    c = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", *(((c > a) & (c <= b)).cast("double").alias(n) for a, b, n in ((10, 20, "low"), (20, 40, "mid"))))


@query("J1_left", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query(
    "J2_merge_layers",
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*)::DOUBLE AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 5000)
    SELECT coalesce(a.k, b.k, c.k) AS k, a.v AS top, b.v AS pending, c.v AS balance FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""",
)
def j2(spark, d):
    orders = read(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    top = orders.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("o_totalprice").alias("value"))
    pending = orders.where("o_orderstatus = 'P'").groupBy("k").agg(F.count(F.lit(1)).alias("value"))
    balance = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return fr.merge_layers([("top", top), ("pending", pending), ("balance", balance)], "k")


@query("J4_inner", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j4(spark, d):
    return read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("J5_missing_count", "SELECT count(*) AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j5(spark, d):
    have = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(have, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("J6_outside", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def j6(spark, d):
    inside = read(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return fr.outside(read(spark, d, "part").select("p_partkey"), inside, "p_partkey")


@query(
    "J7_cross_resolution",
    f"""WITH {PART_CELLS}, {DISTANCES}, up AS (SELECT {parent_sql("cell", 7)} AS cell, min(distance_m) AS distance_m, bool_or(intersects) AS intersects FROM distances WHERE group_id = 'A' GROUP BY 1)
    SELECT p_partkey, distance_m, intersects FROM cells LEFT JOIN up ON {parent_sql("cells.cell", 7)} = up.cell""",
)
def j7(spark, d):
    up = fr.lifted_distances(distances(spark, d).where("group_id = 'A'"), 7)
    return fr.parent_distances(part_cells(spark, d), up, 9, 7).select("p_partkey", "distance_m", "intersects")


@query("J9_long_not_wide", f"WITH {DISTANCES} SELECT cell, min(distance_m) AS distance_m, bool_or(intersects) AS intersects FROM distances GROUP BY 1")
def j9(spark, d):
    return distances(spark, d).groupBy("cell").agg(F.min("distance_m").alias("distance_m"), F.bool_or("intersects").alias("intersects"))


@query("J10_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS label FROM orders")
def j10(spark, d):
    names = F.create_map(*map(F.lit, ("F", "finished", "O", "open")))
    return read(spark, d, "orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderstatus")).alias("label"))


@query(
    "J16_grid_pivot",
    "SELECT f.l_returnflag, max(n) FILTER (s.l_linestatus = 'F') AS F, max(n) FILTER (s.l_linestatus = 'O') AS O FROM (SELECT DISTINCT l_returnflag FROM lineitem) f, (SELECT DISTINCT l_linestatus FROM lineitem) s LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.l_returnflag = f.l_returnflag AND c.l_linestatus = s.l_linestatus GROUP BY 1",
)
def j16(spark, d):
    # The grid of two short config lists; a missing pair is a null in the pivot.
    return read(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))


@query("J17_self_equi", "SELECT a.quality AS x, b.toxic AS y, count(*) AS n FROM labels a JOIN labels b ON a.doc_id = b.doc_id GROUP BY 1, 2")
def j17(spark, d):
    a, b = read(spark, d, "labels").select("doc_id", F.col("quality").alias("x")), read(spark, d, "labels").select("doc_id", F.col("toxic").alias("y"))
    return a.join(b, "doc_id").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("J18_view", "SELECT p_partkey, n_lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def j18(spark, d):
    read(spark, d, "part").createOrReplaceTempView("grid_cells")
    read(spark, d, "lineitem").createOrReplaceTempView("cell_features")
    return spark.sql("SELECT p_partkey, n_lines FROM grid_cells LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM cell_features GROUP BY l_partkey) ON l_partkey = p_partkey")


@query("U1_stack", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def u1(spark, d):
    a = fr.project(read(spark, d, "customer"), {"c_custkey": "id", "c_acctbal": "balance"})
    return fr.stack(a, fr.project(read(spark, d, "supplier"), {"s_suppkey": "id", "s_acctbal": "balance", "s_name": "s_name"}))


@query("U2_union_max", "SELECT id, max(v) AS v FROM (SELECT l_partkey AS id, l_discount AS v FROM lineitem UNION ALL SELECT l_partkey, l_tax FROM lineitem) GROUP BY 1")
def u2(spark, d):
    li = read(spark, d, "lineitem")
    return fr.union_max([fr.project(li, {"l_partkey": "id", c: "v"}) for c in ("l_discount", "l_tax")], "id", "v")


@query("U3_set_operations", "SELECT count(*) FILTER (a AND b) AS both_sets, count(*) FILTER (a AND NOT b) AS only_first FROM (SELECT k, bool_or(f = 1) AS a, bool_or(f = 2) AS b FROM (SELECT l_partkey AS k, 1 AS f FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT l_partkey, 2 FROM lineitem WHERE l_tax > 0.06) GROUP BY 1)")
def u3(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_discount") > 0.08).alias("a"), (F.col("l_tax") > 0.06).alias("b"))
    by = li.groupBy("k").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return by.agg(F.count_if(F.col("a") & F.col("b")).alias("both_sets"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"))


@query("U4_pivot", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def u4(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))


@query("U5_unpivot", "UNPIVOT (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME layer VALUE value")
def u5(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return fr.unpivot(part, ["p_partkey"], ["p_size", "p_retailprice"], "layer", "value")


@query("U6_split_wide", "SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS A, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS N, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS R, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def u6(spark, d):
    return fr.split_wide(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])


@query("K7_upsert", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT s_suppkey, 0.0 FROM supplier WHERE s_nationkey = 3")
def k7(spark, d):
    log = read(spark, d, "supplier")
    new = log.where("s_nationkey = 3").select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    return fr.upsert(log.select("s_suppkey", "s_acctbal"), new, "s_suppkey")
