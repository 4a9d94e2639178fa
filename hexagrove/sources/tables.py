"""Scans: tables with stated schemas, registries, GeoJSON features, distance tables, databases, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTANCE_SCHEMA = "cell string, distance_m double, intersects boolean"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A table, or an empty one of the same schema if there is none at ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def distance_table(spark: SparkSession, path: str) -> DataFrame:
    """A layer's distances; none gives an empty table, a missing ``intersects`` counts as false."""
    df = or_empty(spark, path, DISTANCE_SCHEMA)
    return df.withColumn("intersects", F.coalesce("intersects", F.lit(False)))


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """All JSON manifests under a pattern with the file each came from."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("manifest", F.input_file_name())


def registry_layers(spark: SparkSession, path: str) -> DataFrame:
    """A registry's layers in its own order."""
    found = spark.read.option("multiLine", True).json(path).select(F.posexplode("layers").alias("position", "layer"))
    return found.select("position", "layer.*")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: a FeatureCollection, a bare Feature or a bare geometry.

    ``hex_id`` is the property of that name or ``h3_address``; coordinates stay JSON text, because their
    nesting depends on the geometry's type.
    """
    return _features(spark.read.text(path, wholetext=True))


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with one document a line, which any number of tasks can share."""
    return _features(spark.read.text(path))


def by_suffix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its path's suffix: GeoJSON features line by line, anything else CSV of the schema."""
    return geojson_lines(spark, path) if path.lower().endswith((".geojson", ".json")) else read_csv(spark, path, schema)


def _features(texts: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("geometry", T.StringType()), T.StructField("properties", T.StringType()), T.StructField("coordinates", T.StringType())])
    raw = texts.select(F.col("value"), F.from_json("value", schema).alias("j"))
    one = F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).when(F.col("j.type") == "Feature", F.array("value")).otherwise(F.array(F.concat(F.lit('{"geometry":'), F.col("value"), F.lit("}"))))
    feature = F.from_json("f", "geometry string, properties map<string,string>")
    rows = raw.select(F.explode(one).alias("f")).select(feature.alias("x")).select("x.geometry", "x.properties")
    shape = F.from_json("geometry", "type string, coordinates string")
    ids = F.coalesce(F.try_element_at("properties", F.lit("hex_id")), F.try_element_at("properties", F.lit("h3_address")))
    return rows.select(ids.alias("hex_id"), shape["type"].alias("geometry_type"), shape["coordinates"].alias("coordinates"), "properties")


def landscape_attributes(features: DataFrame) -> DataFrame:
    """Class and type of landscape features: ``class_km`` falls back to ``class_k8``."""
    p = lambda name: F.try_element_at("properties", F.lit(name))
    return features.select("hex_id", F.coalesce(p("class_km"), p("class_k8")).cast("double").cast("int").alias("class_km"), F.coalesce(p("landscape_type_v10"), p("landscape_type")).alias("landscape_type"))


def read_database(spark: SparkSession, url: str, sql: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 16) -> DataFrame:
    """A query over JDBC, in ``parts`` ranges of ``key`` if one is named."""
    reader = spark.read.format("jdbc").option("url", url)
    if key is None:
        return reader.option("query", sql).load()
    return reader.option("dbtable", f"({sql}) q").option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts).load()


def within_box(df: DataFrame, box: tuple[float, float, float, float], columns: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Features whose box meets ``box``: plain range predicates that reach the Parquet footers."""
    x0, y0, x1, y1 = (F.col(c) for c in columns)
    return df.where((x1 >= box[0]) & (x0 <= box[2]) & (y1 >= box[1]) & (y0 <= box[3]))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size in MB and change time of files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.round(F.col("length") / 1e6, 3).alias("mb"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("changed"))
