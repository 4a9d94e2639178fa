"""Sources and sinks (S1 to S3, S5 to S7, S14, S18 to S20, K1, K3 to K7): tables written to the shared folder and scanned again."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexagrove.functions import hexgrid
from hexagrove.operators.lineage import shared_path
from hexagrove.plans.inputs import cell_sql
from hexagrove.plans.registry import query, read
from hexagrove.sources import sinks, tables


@query("S1_csv_scan", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s1(spark, d):
    """A table written as CSV, and read with its schema."""
    path = shared_path(spark)
    sinks.write_csv(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("S2_manifests", "SELECT n_name AS region, n_nationkey::BIGINT AS key, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS layers FROM nation")
def s2(spark, d):
    """A JSON manifest for each nation, and all of them listed."""
    path = shared_path(spark)
    own = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_name")).alias("layers"))
    nations = read(spark, d, "nation").join(own, "n_nationkey", "left").select(F.col("n_name").alias("region"), F.col("n_nationkey").alias("key"), F.coalesce("layers", F.array().cast("array<string>")).alias("layers"))
    sinks.write_manifests(nations, path, "region")
    found = tables.read_manifests(spark, f"{path}/*")
    return found.select("region", F.col("key").cast("long").alias("key"), F.size("layers").cast("long").alias("layers"))


@query("S19_registry", "SELECT row_number() OVER (ORDER BY s_suppkey)::INT - 1 AS position, s_suppkey AS id, s_name AS label FROM supplier")
def s19(spark, d):
    """A registry document with its layers in order, and the layers' typed rows."""
    path = shared_path(spark)
    layers = F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))))
    sinks.write_manifests(read(spark, d, "supplier").agg(layers.alias("layers")).withColumn("name", F.lit("registry")), path, "name")
    return tables.registry_layers(spark, f"{path}/*").select("position", "id", "label")


def places_json(spark, d):
    """Customers as GeoJSON features, one a line; those of nation 0 have no geometry and are skipped."""
    path = shared_path(spark)
    at = F.when(F.col("c_nationkey") != 0, F.concat(F.lit("["), (F.col("c_custkey") % 360 - 180).cast("string"), F.lit(","), (F.col("c_custkey") % 170 - 85).cast("string"), F.lit("]")))
    df = read(spark, d, "customer").select(hexgrid.text_id(hexgrid.synthetic_cell(F.col("c_custkey"))).alias("hex_id"), F.col("c_nationkey").alias("class_k8"), F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).alias("class_km"), at.alias("at"))
    sinks.write_features(df, path, "Point", "at", ["hex_id", "class_km", "class_k8"])
    return path


@query("S5_geojson_attributes", f"SELECT lower(hex({cell_sql('c_custkey')})) AS hex_id, c_nationkey::INT AS class_km FROM customer WHERE c_nationkey <> 0")
def s5(spark, d):
    """Features written by all tasks and read as attributes; the class falls back to the other one."""
    return tables.landscape_attributes(tables.geojson_lines(spark, places_json(spark, d))).select("hex_id", "class_km")


@query("S6_geojson_geometry", f"SELECT lower(hex({cell_sql('c_custkey')})) AS hex_id, 'Point' AS geometry_type, '[' || (c_custkey % 360 - 180) || ',' || (c_custkey % 170 - 85) || ']' AS coordinates FROM customer WHERE c_nationkey <> 0")
def s6(spark, d):
    return tables.geojson_lines(spark, places_json(spark, d)).select("hex_id", "geometry_type", "coordinates")


@query("S7_format_dispatch", f"SELECT 'csv' AS source, c_custkey::VARCHAR AS key FROM customer UNION ALL SELECT 'geojson', lower(hex({cell_sql('c_custkey')})) FROM customer WHERE c_nationkey <> 0")
def s7(spark, d):
    """A table by the suffix of its path: CSV, or GeoJSON with the key of its features."""
    csv = shared_path(spark) + "/table.csv"
    sinks.write_csv(read(spark, d, "customer").select(F.col("c_custkey").alias("hex_id")), csv)
    geo = shared_path(spark) + "/features.geojson"
    read_lines = spark.read.text(places_json(spark, d))
    read_lines.write.text(geo)
    parts = [tables.by_suffix(spark, p, "hex_id string").select(F.lit(n).alias("source"), F.col("hex_id").alias("key")) for n, p in (("csv", csv), ("geojson", geo))]
    return parts[0].union(parts[1])


@query("S14_box_pushdown", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 5 >= 20 AND l_quantity <= 30 AND l_extendedprice + 500 >= 20000 AND l_extendedprice <= 40000")
def s14(spark, d):
    boxes = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("xmin"), F.col("l_extendedprice").alias("ymin"), (F.col("l_quantity") + 5).alias("xmax"), (F.col("l_extendedprice") + 500).alias("ymax"))
    return tables.within_box(boxes, (20, 20000, 30, 40000)).select("l_orderkey", "l_linenumber")


@query("S18_distance_tables", "SELECT 'there' AS layer, l_returnflag AS cell, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS hits FROM lineitem GROUP BY 2")
def s18(spark, d):
    """A layer's distance table, with unknown flags as false, and a layer that has none: an empty table of the same columns."""
    path = shared_path(spark)
    li = read(spark, d, "lineitem")
    sinks.write_csv(li.select(F.col("l_returnflag").alias("cell"), F.col("l_quantity").alias("distance_m"), F.when(F.col("l_discount") > 0.05, True).alias("intersects")), path)
    both = [tables.distance_table(spark, p).withColumn("layer", F.lit(n)) for n, p in (("there", path), ("missing", path + "-none"))]
    return both[0].unionByName(both[1]).groupBy("layer", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("intersects").alias("hits"))


@query("S20_file_listing", "SELECT count(DISTINCT r_regionkey)::BIGINT AS files, true AS sized FROM region")
def s20(spark, d):
    """One file for each region, listed without reading it."""
    path = shared_path(spark)
    read(spark, d, "region").repartitionByRange(64, "r_regionkey").write.partitionBy("r_regionkey").csv(path)
    found = tables.files(spark, path, "*.csv")
    return found.agg(F.count(F.lit(1)).alias("files"), F.bool_and((F.col("mb") >= 0) & F.col("changed").isNotNull() & F.col("name").endswith(".csv")).alias("sized"))


@query("K6_view", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name")
def k6(spark, d):
    """A view of the grid with features where there are any, and a query on it."""
    features = read(spark, d, "customer").where("c_acctbal > 0")
    sinks.create_view(read(spark, d, "nation").join(features, F.col("n_nationkey") == F.col("c_nationkey"), "left"), "grid_features")
    return spark.sql("SELECT n_name, count(c_custkey) AS n FROM grid_features GROUP BY n_name")


@query("K7_run_log_version", "SELECT s_nationkey AS layer, CASE WHEN s_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM supplier GROUP BY 1, 2")
def k7(spark, d):
    """The log's rows of some layers replaced by new ones, written as a new version."""
    path = shared_path(spark)
    log = read(spark, d, "supplier").select(F.col("s_nationkey").alias("layer"), "s_suppkey", F.lit("old").alias("state"))
    sinks.log_run(log, path, log.where("layer % 2 = 0").withColumn("state", F.lit("new")), "layer")
    return spark.read.parquet(path).groupBy("layer", "state").agg(F.count(F.lit(1)).alias("n"))
