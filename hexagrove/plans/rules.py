"""Rule models and text helpers (D23 in full, X15, T9, T11, T14, M7, M15, M17, F8, O6) over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hexagrove.functions import scalars
from hexagrove.operators import audit, stage_one
from hexagrove.operators import statistics as st
from hexagrove.plans.registry import query, read

DISTANCES = {"settlement": 17, "road_large": 7, "road_medium": 3, "culture": 29, "protected": 31, "bird": 37, "electrical": 53}
FLAGS = {"culture": 11, "protected": 13, "military": 43, "approach": 47, "strand": 41, "coastal": 9}


def cells(spark, d):
    """Parts as cells with distances, flags, landscape class, plateau and slope; every 50th has no settlement at all."""
    key = F.col("p_partkey")
    df = read(spark, d, "part").select(key, *((F.pmod(key * m * 101, F.lit(7919)) * 1.0).alias(f"dist_{n}") for n, m in DISTANCES.items()), *((key % m == 0).alias(f"in_{n}") for n, m in FLAGS.items()), (F.col("p_size") % 6 + 1).alias("class_km"), (F.col("p_retailprice") / 10).cast("double").alias("plateau"), (F.col("p_size") * 0.7).alias("slope"))
    return df.withColumn("dist_settlement", F.when(key % 50 == 0, float("inf")).otherwise(F.col("dist_settlement")))


def _case(name: str, flag: str) -> str:
    return f"CASE WHEN {flag} THEN '{stage_one.REASONS[name]}' END"


def _scenario_sql(name: str) -> str:
    x = stage_one.SCENARIOS[name]
    rules = {
        "settlement": f"settlement <= {x['settlement']}", "transport": f"(road_large <= {x['road_large']} OR road_medium <= {x['road_medium']})", "culture": "p_partkey % 11 = 0", "protected": "p_partkey % 13 = 0",
        "military": "p_partkey % 43 = 0", "approach": "p_partkey % 47 = 0", "strand": "p_partkey % 41 = 0", "coastal": "p_partkey % 9 = 0" if x["coastal"] else "false", "bird": f"bird <= {x['bird']}" if x["bird"] else "false", "electrical": f"electrical > {x['electrical']}",
    }
    count = " + ".join(f"({r})::INT" for r in rules.values())
    clearance = "calm + 0.15 * least(1.0, bird / 2000)" if x["bird"] else "calm / 0.85"
    return f"SELECT p_partkey, '{name}' AS scenario, {count} AS n, concat_ws('; ', {', '.join(_case(k, r) for k, r in rules.items())}) AS why, 100 * (0.35 * grid + 0.45 * ({clearance}) + 0.20 * landscape) AS s FROM scored"


@query("D23_stage_one", f"""WITH raw AS (SELECT p_partkey, {", ".join(f"(p_partkey * {m * 101} % 7919)::DOUBLE AS {n}" for n, m in DISTANCES.items())}, p_size % 6 + 1 AS class_km, (p_retailprice / 10)::DOUBLE AS plateau, p_size * 0.7::DOUBLE AS slope FROM part),
caps AS (SELECT quantile_cont(plateau, 0.95) AS pc, quantile_cont(slope, 0.95) AS sc FROM raw),
base AS (SELECT * REPLACE (CASE WHEN p_partkey % 50 = 0 THEN 1e308 ELSE settlement END AS settlement) FROM raw),
scored AS (SELECT *, greatest(0.0, least(1.0, (7000 - electrical) / 7000)) AS grid,
  0.30 * greatest(0.0, least(1.0, (settlement - 250) / 3750)) + 0.15 * greatest(0.0, least(1.0, (least(road_large, road_medium) - 25) / 1475)) + 0.20 * least(1.0, culture / 1500) + 0.20 * least(1.0, protected / 1500) AS calm,
  0.60 * CASE class_km WHEN 1 THEN 0.10 WHEN 2 THEN 1.0 WHEN 3 THEN 0.35 WHEN 4 THEN 0.5 WHEN 5 THEN 0.25 ELSE 0.5 END + 0.25 * least(plateau / pc, 1) + 0.15 * (1 - least(slope / sc, 1)) AS landscape FROM base, caps),
long AS ({" UNION ALL ".join(_scenario_sql(s) for s in stage_one.SCENARIOS)}),
placed AS (SELECT p_partkey, scenario, ntile(4) OVER (PARTITION BY scenario ORDER BY s, p_partkey) AS q FROM long WHERE n = 0)
SELECT p_partkey, scenario, n AS blocking_rule_count, n = 0 AS allowed, round(CASE WHEN n = 0 THEN s ELSE 0 END, 6) AS score, coalesce(['Lag', 'Medel', 'Hog', 'Mycket hog'][q], 'Exkluderad') AS class, CASE WHEN why = '' THEN 'Ingen blockerande regel utloste' ELSE why END AS reason
FROM long LEFT JOIN placed USING (p_partkey, scenario)""")
def d23_stage_one(spark, d):
    return stage_one.acceptance(cells(spark, d), "p_partkey").withColumn("score", F.round("score", 6))


@query("F8_rule_groups", "SELECT l_returnflag AS group_id, count(DISTINCT l_linenumber) AS n, array_to_string(list_sort(list(DISTINCT l_linenumber::VARCHAR)), ', ') AS labels FROM lineitem GROUP BY 1")
def f8(spark, d):
    """Rules by group: how many, and their labels."""
    rules = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("group_id"), F.col("l_linenumber").cast("string").alias("label")).distinct()
    return rules.groupBy("group_id").agg(F.count("label").alias("n"), F.array_join(F.sort_array(F.collect_list("label")), ", ").alias("labels"))


@query("X15_split_audit", """WITH v AS (SELECT p_type AS segment_type, p_size > 25 AS use_flag, p_size::DOUBLE AS power_kw, (p_size % 5)::BIGINT AS ferry_zone, p_retailprice::DOUBLE AS m FROM part),
b AS (SELECT quantile_cont(power_kw, [1/3.0, 2/3.0]) AS q, min(power_kw) AS lo, max(power_kw) AS hi FROM v),
c AS (SELECT 'segment_type' AS field, 'categorical' AS field_type, segment_type AS category, m FROM v UNION ALL SELECT 'use_flag', 'logical', upper(use_flag::VARCHAR), m FROM v UNION ALL SELECT 'ferry_zone', 'numeric_group', ferry_zone::VARCHAR, m FROM v
  UNION ALL SELECT 'power_kw', 'numeric_binned', CASE WHEN power_kw <= q[1] THEN '1' WHEN power_kw <= q[2] THEN '2' ELSE '3' END, m FROM v, b),
s AS (SELECT field, field_type, category, sum(m) AS m FROM c GROUP BY ALL), r AS (SELECT *, m / sum(m) OVER (PARTITION BY field) AS share, row_number() OVER (PARTITION BY field ORDER BY m DESC) AS i FROM s),
a AS (SELECT field, field_type, count(*) AS n_categories, max(share) AS top, coalesce(max(share) FILTER (i = 2), 0) AS second, count(*) FILTER (share >= 0.05) AS significant FROM r GROUP BY ALL)
SELECT field, field_type, n_categories, round_even(top, 4) AS dominant_share, round_even(second, 4) AS second_share, significant AS significant_categories,
  CASE WHEN n_categories BETWEEN 2 AND 4 THEN 2 WHEN n_categories BETWEEN 5 AND 6 THEN 1 ELSE 0 END + CASE WHEN significant >= 2 THEN 2 ELSE 0 END + CASE WHEN top <= 0.85 THEN 1 ELSE 0 END + CASE WHEN field_type <> 'numeric_group' THEN 1 ELSE 0 END AS score FROM a""")
def x15(spark, d):
    """Fields of parts under names that mean something; ``status`` and ``part_id`` are bookkeeping and left out."""
    part = read(spark, d, "part").select(F.col("p_type").alias("segment_type"), (F.col("p_size") > 25).alias("use_flag"), F.col("p_size").cast("double").alias("power_kw"), (F.col("p_size") % 5).cast("long").alias("ferry_zone"), F.col("p_brand").alias("status"), F.col("p_partkey").alias("part_id"), F.col("p_retailprice").alias("m"))
    return audit.split_candidates(part, "m").drop("top_values", "suggested_split")


@query("T9_reference_key", "SELECT c_custkey, lower(trim(regexp_replace(replace(replace(replace(c_name, '#', ' o '), 'o ', 'a '), '0', 'ae'), '\\s+', ' ', 'g'))) AS key FROM customer")
def t9(spark, d):
    """Names with marks of three alphabets put in, which the key folds away."""
    name = F.replace(F.replace(F.replace(F.col("c_name"), F.lit("#"), F.lit("  o ")), F.lit("o "), F.lit("\u00c5  ")), F.lit("0"), F.lit("\u00c6"))
    return read(spark, d, "customer").select("c_custkey", scalars.reference_key(name).alias("key"))


@query("T11_datasource", "SELECT s_suppkey, '/data/' || s_name || '.gpkg' AS path, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'layer' || s_nationkey END AS layer FROM supplier")
def t11(spark, d):
    text = F.concat(F.lit("/data/"), F.col("s_name"), F.lit(".gpkg"), F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("|layername=layer"), F.col("s_nationkey"))).otherwise(F.concat(F.lit("|subset=a|layername=layer"), F.col("s_nationkey"), F.lit("|layername=second"))))
    return read(spark, d, "supplier").select("s_suppkey", scalars.datasource(text).alias("d")).select("s_suppkey", "d.path", "d.layer")


@query("T14_weight_spec", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN s_nationkey + 1.5 END::DOUBLE AS a, CASE WHEN s_suppkey % 4 < 2 THEN 2.0 END::DOUBLE AS b, CASE WHEN s_suppkey % 4 = 2 THEN 'b' WHEN s_suppkey % 4 = 3 THEN 'b=-1' END AS error FROM supplier")
def t14(spark, d):
    text = F.concat(F.lit("a = "), (F.col("s_nationkey") + 1.5).cast("string"), F.when(F.col("s_suppkey") % 4 < 2, "; b=2,").when(F.col("s_suppkey") % 4 == 2, ";b").otherwise(",b=-1;c"))
    return read(spark, d, "supplier").select("s_suppkey", scalars.weight_spec(text).alias("w")).select("s_suppkey", F.try_element_at("w.weights", F.lit("a")).alias("a"), F.try_element_at("w.weights", F.lit("b")).alias("b"), "w.error")


@query("M7_quality_bounds", "SELECT l_orderkey, l_linenumber, l_quantity < 5 OR l_quantity > 45 AS outlier, CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 'Outlier for ' || l_returnflag ELSE '' END AS warning FROM lineitem")
def m7(spark, d):
    warning = scalars.quality_warning(F.col("l_quantity").cast("double"), F.col("l_returnflag"), F.lit("km2_per_twh"), F.lit("table"), F.col("l_quantity").cast("string"), F.lit(5.0), F.lit(45.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (warning != "").alias("outlier"), F.regexp_replace(warning, ":.*", "").alias("warning"))


@query("M15_composite_score", "WITH n AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS a, (c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ())::DOUBLE AS b FROM customer) SELECT c_custkey, round((a * 3 + b * 1) / 4, 8) AS score FROM n")
def m15(spark, d):
    """Columns scaled to 0..1 (flat ones 0), averaged by weights; negative weights count as none."""
    weights = {"a": 3.0, "b": 1.0, "c": -2.0}
    df = read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.lit(1.0).alias("c"))
    for c in weights:
        df = st.min_max(df, c, c, top=1.0, flat=0.0)
    total = sum(max(0.0, w) for w in weights.values()) or 1.0
    return df.select("c_custkey", F.round(reduce(lambda x, y: x + y, (F.col(c) * max(0.0, w) / total for c, w in weights.items())), 8).alias("score"))


PALETTE = {"forest": (0.1, 0.5, 0.2), "water": (0.2, 0.3, 0.9), "field": (0.9, 0.8, 0.3), "rock": (0.5, 0.5, 0.5)}


@query("M17_nearest_colour", f"""WITH p AS (SELECT p_partkey, (p_partkey * 7 % 101) / 100.0::DOUBLE AS r, (p_partkey * 13 % 101) / 100.0::DOUBLE AS g, (p_partkey * 29 % 101) / 100.0::DOUBLE AS b FROM part),
k(i, name, x, y, z) AS (VALUES {", ".join(f"({i}, '{n}', {x}, {y}, {z})" for i, (n, (x, y, z)) in enumerate(PALETTE.items()))}),
m AS (SELECT p_partkey, name, i, sqrt((r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2) AS d FROM p, k)
SELECT p_partkey, CASE WHEN d <= 0.16 THEN name END AS name, round(d, 8) AS distance FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) = 1""")
def m17(spark, d):
    rgb = [F.pmod(F.col("p_partkey") * m, F.lit(101)) / 100.0 for m in (7, 13, 29)]
    found = read(spark, d, "part").select("p_partkey", scalars.nearest_colour(*rgb, PALETTE).alias("c"))
    return found.select("p_partkey", "c.name", F.round("c.distance", 8).alias("distance"))
