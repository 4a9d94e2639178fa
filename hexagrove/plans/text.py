"""Text (T) and scalar mathematics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.functions import scalars as sc
from hexagrove.plans.registry import query, read


@query("T1_slug", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM customer")
def t1(spark, d):
    return read(spark, d, "customer").select("c_custkey", sc.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query("T2_code_point_hash", "SELECT p_partkey, lower(lpad(to_hex(list_sum(list_transform(range(1, length(p_name) + 1), lambda i: i * ascii(p_name[i]))) % 16777216), 6, '0')) AS code FROM part")
def t2(spark, d):
    return read(spark, d, "part").select("p_partkey", sc.code_point_hash(F.col("p_name")).alias("code"))


@query("T3_short_name", "SELECT n_name, 'x_' || lower(n_name) || CASE WHEN n_regionkey = 0 THEN '_cnt' ELSE '_len' END AS short FROM nation")
def t3(spark, d):
    metric = F.concat(F.lit("x_"), F.lower("n_name"), F.when(F.col("n_regionkey") == 0, "_count").otherwise("_length_m"))
    return read(spark, d, "nation").select("n_name", F.regexp_replace(F.regexp_replace(metric, "_count$", "_cnt"), "_length_m$", "_len").alias("short"))


def cleaned_sql(text: str) -> str:
    """The cleaning rule in SQL, from the fixed values."""
    trimmed = f"regexp_replace(coalesce({text}, ''), '^{sc.BLANK}+|{sc.BLANK}+$', '', 'g')"
    out = trimmed
    for old, new in sc.PLAIN:
        out = f"replace({out}, '{old}', '{new}')"
    return f"CASE WHEN lower({trimmed}) = 'nan' THEN '' ELSE {out} END"


@query("T4_clean_text", f"SELECT doc_id, {cleaned_sql('text')} AS t FROM documents")
def t4(spark, d):
    return read(spark, d, "documents").select("doc_id", sc.clean_text(F.col("text")).alias("t"))


@query("T5_numbers", rf"SELECT doc_id, list_transform(regexp_extract_all(replace({cleaned_sql('text')}, ',', '.'), '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS numbers FROM documents")
def t5(spark, d):
    return read(spark, d, "documents").select("doc_id", sc.numbers(F.col("text")).alias("numbers"))


@query("T7_road_class", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'lille|small|minor|local|residential') THEN 'small' WHEN regexp_matches(p_name, 'mellem|mellan|medium|secondary') THEN 'medium' WHEN regexp_matches(p_name, 'stor|motor|major|primary') THEN 'large' ELSE 'other' END AS road FROM (SELECT p_partkey, lower(p_name) || CASE p_partkey % 5 WHEN 0 THEN ' primary road' WHEN 1 THEN ' secondary' WHEN 2 THEN ' local' WHEN 3 THEN ' motorway' ELSE '' END AS p_name FROM part)")
def t7(spark, d):
    added = F.when(F.col("p_partkey") % 5 == 0, " primary road").when(F.col("p_partkey") % 5 == 1, " secondary").when(F.col("p_partkey") % 5 == 2, " local").when(F.col("p_partkey") % 5 == 3, " motorway").otherwise("")
    return read(spark, d, "part").select("p_partkey", sc.road_class(F.concat("p_name", added)).alias("road"))


@query("T8_series_parse", "SELECT n_name, 'mean' AS stat, lower(n_name) AS series, n_regionkey * 50 AS k FROM nation")
def t8(spark, d):
    name = F.concat(F.lit("mean_"), F.lower("n_name"), F.lit("_k"), (F.col("n_regionkey") * 50).cast("string"))
    parts = [F.regexp_extract(name, r"^(mean|std)_(.*)_k([0-9]+)$", i) for i in (1, 2, 3)]
    return read(spark, d, "nation").select("n_name", parts[0].alias("stat"), parts[1].alias("series"), parts[2].cast("int").alias("k"))


@query("T10_label_fallback", "SELECT vec_id, CASE label WHEN 0 THEN 'coast' WHEN 1 THEN 'forest' ELSE 'Cluster ' || label END AS label_text FROM embeddings")
def t10(spark, d):
    names = F.create_map(F.lit(0), F.lit("coast"), F.lit(1), F.lit("forest"))
    return read(spark, d, "embeddings").select("vec_id", F.coalesce(F.try_element_at(names, F.col("label")), F.concat(F.lit("Cluster "), F.col("label").cast("string"))).alias("label_text"))


@query("T12_joined_reasons", "SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_quantity > 40 THEN 'size' END, CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.05 THEN 'tax' END) AS reasons FROM lineitem")
def t12(spark, d):
    flags = [F.when(F.col(c) > v, F.lit(n)) for c, v, n in (("l_quantity", 40, "size"), ("l_discount", 0.05, "discount"), ("l_tax", 0.05, "tax"))]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("; ", *flags).alias("reasons"))


@query("T13_popup", "SELECT p_partkey, '<b>' || p_name || '</b> ' || p_size || ' (' || p_type || ')' AS popup FROM part")
def t13(spark, d):
    return read(spark, d, "part").select("p_partkey", F.format_string("<b>%s</b> %d (%s)", "p_name", "p_size", "p_type").alias("popup"))


@query("T15_fingerprint", "SELECT item_id, sha1(text)[1:16] AS fingerprint FROM benchmark")
def t15(spark, d):
    return read(spark, d, "benchmark").select("item_id", sc.fingerprint(F.col("text")).alias("fingerprint"))


@query("T16_lpad", "SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 4, '0') AS code FROM nation")
def t16(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"))


@query("M1_clip", "SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN greatest(0, least(5000, c_acctbal)) END AS clipped FROM customer")
def m1(spark, d):
    return read(spark, d, "customer").select("c_custkey", sc.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"))


@query("M2_rescale", "SELECT p_partkey, round((p_retailprice - 900) / 1000, 8) AS up, round(1 - (p_retailprice - 900) / 1000, 8) AS down FROM (SELECT p_partkey, greatest(900, least(1900, p_retailprice)) AS p_retailprice FROM part)")
def m2(spark, d):
    x = F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", F.round(sc.rescale01(x, F.lit(900.0), F.lit(1900.0)), 8).alias("up"), F.round(sc.rescale01(x, F.lit(900.0), F.lit(1900.0), reverse=True), 8).alias("down"))


@query("M3_transforms", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 8) AS log1p, round(sqrt(greatest(c_acctbal, 0)), 8) AS sqrt, round(asinh(greatest(c_acctbal, 0)), 8) AS asinh FROM customer")
def m3(spark, d):
    return read(spark, d, "customer").select("c_custkey", *(F.round(sc.transformed(F.col("c_acctbal"), how), 8).alias(how) for how in ("log1p", "sqrt", "asinh")))


@query("M4_units", "SELECT l_orderkey, l_linenumber, round(l_quantity * CASE l_returnflag WHEN 'A' THEN 0.001 WHEN 'N' THEN 1 / 3.6 ELSE 1 END, 9) AS twh FROM lineitem")
def m4(spark, d):
    unit = F.when(F.col("l_returnflag") == "A", " GWh").when(F.col("l_returnflag") == "N", "pj").otherwise("unknown")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sc.to_twh(F.col("l_quantity"), unit), 9).alias("twh"))


@query("M5_area_factor", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN 1000.0 / p_size ELSE 1000 / (p_size * 8.76) END, 8) AS km2 FROM part WHERE p_size > 0")
def m5(spark, d):
    unit = F.when(F.col("p_size") % 2 == 0, "gwh_km2").otherwise("w_m2")
    return read(spark, d, "part").where("p_size > 0").select("p_partkey", F.round(sc.km2_per_twh(F.col("p_size").cast("double"), unit), 8).alias("km2"))


@query(
    "M6_parsed_value",
    """WITH r AS (SELECT p_partkey, p_size::DOUBLE AS a, CASE p_partkey % 5 WHEN 0 THEN 'range' WHEN 1 THEN 'one_sided_bound' WHEN 2 THEN 'plus_minus' WHEN 3 THEN 'single_value' END AS rule FROM part),
    v AS (SELECT *, CASE rule WHEN 'range' THEN CASE WHEN least(a, 25) > 0 THEN sqrt(a * 25) ELSE (a + 25) / 2 END WHEN 'single_value' THEN a + 0.5 ELSE a END AS value FROM r),
    s AS (SELECT *, CASE rule WHEN 'range' THEN [least(a, 25), value, greatest(a, 25)] WHEN 'plus_minus' THEN [value, a - 10, a + 10] WHEN 'single_value' THEN [value] ELSE [] END AS source FROM v),
    k AS (SELECT *, list_transform(list_filter(source, lambda x: x > 0), lambda x: 1000 / x) AS km2 FROM s)
    SELECT p_partkey, rule, round(CASE WHEN rule IS NOT NULL THEN value END, 8) AS value, round(list_min(km2), 8) AS low, round(CASE WHEN rule IS NOT NULL AND value > 0 THEN 1000 / value END, 8) AS mid, round(list_max(km2), 8) AS high,
    CASE WHEN rule IS NOT NULL THEN rule <> 'one_sided_bound' AND value > 0 END AS used FROM k""",
)
def m6(spark, d):
    s = F.col("p_size").cast("string")
    r = F.col("p_partkey") % 5
    text = F.when(r == 0, F.concat(F.lit(" 25–"), s)).when(r == 1, F.concat(F.lit("about < "), s)).when(r == 2, F.concat(s, F.lit(" ± 10"))).when(r == 3, F.concat(s, F.lit(",5"))).otherwise("nan")
    v = sc.parsed_value(text)
    # Explode keeps the struct one value; a projection would compute it for each of its fields.
    return read(spark, d, "part").select("p_partkey", F.explode(F.array(v)).alias("v")).select("p_partkey", "v.rule", F.round("v.value", 8).alias("value"), *(F.round(f"v.{c}_km2_per_twh", 8).alias(c) for c in ("low", "mid", "high")), F.col("v.used_in_scenarios").alias("used"))


@query("M11_percent_change", "SELECT user_id, CASE WHEN b IS NULL THEN 0 WHEN abs(b) >= 1e-9 THEN round((a - b) / abs(b) * 100, 6) WHEN abs(a) < 1e-9 THEN 0 END AS change FROM (SELECT user_id, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS a, -sum(value) FILTER (event_type = 'error') AS b FROM events GROUP BY 1)")
def m11(spark, d):
    by = read(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), (-F.sum(F.when(F.col("event_type") == "error", F.col("value")))).alias("b"))
    return by.select("user_id", F.round(sc.percent_change(F.col("a"), F.col("b")), 6).alias("change"))


@query("M12_needed_cells", "SELECT l_returnflag, ceil(sum(l_quantity) / 5.16)::BIGINT AS cells FROM lineitem GROUP BY 1")
def m12(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.ceil(F.sum("l_quantity") / 5.16).alias("cells"))


@query("M13_half_even", "SELECT p_partkey, round_even(p_size / 4.0, 1) AS r FROM part")
def m13(spark, d):
    return read(spark, d, "part").select("p_partkey", F.bround(F.col("p_size") / 4.0, 1).alias("r"))


@query("M14_plateau", "SELECT l_orderkey, l_linenumber, round(l_discount * sqrt(greatest(l_quantity * l_tax, 0)), 9) AS plateau FROM lineitem")
def m14(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * F.sqrt(F.greatest(F.col("l_quantity") * F.col("l_tax"), F.lit(0.0))), 9).alias("plateau"))


@query("M16_fixed_bins", "SELECT bin::INTEGER AS bin, count(*) AS n FROM (SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 WHEN p_size < 40 THEN 3 ELSE 4 END AS bin FROM part) GROUP BY 1")
def m16(spark, d):
    bins = F.least(F.lit(4), F.floor(F.col("p_size") / 10)).cast("int")
    return read(spark, d, "part").groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("M18_affine", "SELECT p_partkey, 480000 + (p_partkey % 50 + 0.5) * 250 AS x, 6130000 - (p_partkey // 50 + 0.5) * 250 AS y FROM part")
def m18(spark, d):
    key = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", (480000 + (key % 50 + 0.5) * 250).alias("x"), (6130000 - (F.floor(key / 50) + 0.5) * 250).alias("y"))
