"""Windows (W), sorts (O) and scaling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hexagrove.operators import allocation
from hexagrove.operators import statistics as st
from hexagrove.plans.registry import query, read


@query("W1_z_score_population", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / nullif(stddev_pop(c_acctbal) OVER (), 0), 6) AS z FROM customer")
def w1(spark, d):
    return st.z_score(read(spark, d, "customer"), "c_acctbal", "z", sample=False).select("c_custkey", F.round("z", 6).alias("z"))


@query("W2_safe_z", "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z, 0.0::DOUBLE AS flat FROM part")
def w2(spark, d):
    out = st.z_score(read(spark, d, "part").withColumn("one", F.lit(1.0)), "p_retailprice", "z")
    return st.z_score(out, "one", "flat").select("p_partkey", F.round("z", 6).alias("z"), "flat")


@query("W3_min_max", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 100, 6) AS scaled FROM customer")
def w3(spark, d):
    return st.min_max(read(spark, d, "customer"), "c_acctbal", "scaled").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("W4_percent_rank", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 - 1) / (count(*) OVER () - 1) * 100, 6) AS pct FROM part")
def w4(spark, d):
    return st.percent_rank_average(read(spark, d, "part"), "p_size", "pct").select("p_partkey", F.round("pct", 6).alias("pct"))


@query("W5_quartile_of_allowed", "SELECT c_custkey, c_mktsegment, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)::INTEGER AS quartile FROM customer WHERE c_acctbal >= 0")
def w5(spark, d):
    allowed = read(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    return st.ntile_of(allowed, ["c_mktsegment"], [F.col("c_acctbal"), F.col("c_custkey")], 4, "quartile").select("c_custkey", "c_mktsegment", "quartile")


@query("W6_row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def w6(spark, d):
    ranked = allocation.running_totals(read(spark, d, "orders").withColumn("one", F.lit(1.0)), [F.col("o_orderdate"), F.col("o_orderkey")], "one")
    return ranked.select("o_orderkey", F.col("__rank").alias("id"))


@query("W7_top_n", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3")
def w7(spark, d):
    return st.top_per_group(read(spark, d, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("W8_cumulative_share", "SELECT p_size, n, round(sum(n) OVER (ORDER BY n DESC, p_size) / sum(n) OVER (), 8) AS cumulative FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def w8(spark, d):
    # Fifty sizes at most: the window runs over the aggregate.
    by = read(spark, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy(F.desc("n"), "p_size"))
    return st.with_totals(by, F.sum("n").alias("t")).withColumn("cumulative", F.round(run / F.col("t"), 8)).drop("t")


@query("W9_first_to_reach", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, min(k) AS k FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS k, sum(o_totalprice) OVER w AS cs, o_totalprice AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE cs >= 500000 AND cs - v < 500000 GROUP BY 1")
def w9(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    run = read(spark, d, "orders").withColumn("k", F.row_number().over(w)).withColumn("cs", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("cs") >= 500000) & (F.col("cs") - F.col("o_totalprice") < 500000)).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("k").cast("long").alias("k"))


@query(
    "W10_running_allocation",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS area, row_number() OVER w AS selected_rank, coalesce(sum(l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice))
    SELECT l_orderkey, l_linenumber, area, selected_rank, least(area, greatest(0, 100000 - before)) AS allocated_area FROM r WHERE least(area, greatest(0, 100000 - before)) > 0""",
)
def w10(spark, d):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "area", "l_extendedprice")]
    out = allocation.allocate(read(spark, d, "lineitem").withColumnRenamed("l_quantity", "area"), 100000.0, "area", order)
    return out.select("l_orderkey", "l_linenumber", "area", "selected_rank", "allocated_area")


@query("W12_share_within", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 8) AS share FROM lineitem GROUP BY 1, 2")
def w12(spark, d):
    by = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return st.with_share(by, "n", ["l_returnflag"]).select("l_returnflag", "l_linestatus", "n", F.round("share", 8).alias("share"))


@query("W13_recent_median", "SELECT user_id, event_type, median(value) AS estimate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 12 GROUP BY 1, 2")
def w13(spark, d):
    last = st.top_per_group(read(spark, d, "events"), ["user_id", "event_type"], 12, F.desc("ts"), F.desc("event_id"))
    return last.groupBy("user_id", "event_type").agg(F.median("value").alias("estimate"), F.count(F.lit(1)).alias("n"))


@query("W14_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations")
def w14(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("role") == "user", F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.last(header, ignorenulls=True).over(w).alias("header"))


@query("O1_six_key_sort", "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem ORDER BY l_returnflag, l_quantity DESC, l_discount DESC, l_tax, l_orderkey, l_linenumber")
def o1(spark, d):
    return read(spark, d, "lineitem").orderBy("l_returnflag", F.desc("l_quantity"), F.desc("l_discount"), "l_tax", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("O2_top_n_flag", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 100)::INTEGER AS selected FROM orders")
def o2(spark, d):
    orders = read(spark, d, "orders")
    # The hundred best are a bounded table.
    best = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", F.lit(1).alias("selected"))
    return orders.select("o_orderkey").join(F.broadcast(best), "o_orderkey", "left").fillna(0, ["selected"])


@query("O4_argmax", "SELECT p_type AS best, n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_type LIMIT 1")
def o4(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_type").alias("best")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "best").limit(1)


@query("O5_argmax_column", "SELECT vec_id, list_position(a, list_max(a)) AS strongest FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS a FROM embeddings)")
def o5(spark, d):
    a = F.transform("embedding", F.abs)
    return read(spark, d, "embeddings").select("vec_id", F.array_position(a, F.array_max(a)).alias("strongest"))
