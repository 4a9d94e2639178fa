"""Sinks: tables by key, layers, GeoJSON features, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexagrove.operators.frames import upsert


def write_table(df: DataFrame, name: str, key: str, buckets: int = 32) -> None:
    """A managed table bucketed and sorted by its key, so joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_layers(layers: list[tuple[str, DataFrame]], path: str) -> None:
    """Each layer as one partition of a Parquet dataset."""
    for name, df in layers:
        df.write.mode("overwrite").parquet(f"{path}/layer={name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifests(df: DataFrame, path: str, name: str) -> None:
    """One JSON document for each row, in a folder by the value of ``name``."""
    df.withColumn("__name", F.col(name)).write.mode("overwrite").partitionBy("__name").json(path)


def feature(geometry_type: str, coordinates: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as a JSON text column; ``coordinates`` is JSON text."""
    head = F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{geometry_type}","coordinates":'), coordinates, F.lit('},"properties":'))
    return F.concat(head, F.to_json(F.struct(*properties)), F.lit("}"))


def write_features(df: DataFrame, path: str, geometry_type: str, coordinates: str, properties: list[str]) -> None:
    """Line-delimited GeoJSON features, written by all tasks; rows without a geometry are skipped."""
    shown = df.where(F.col(coordinates).isNotNull())
    shown.select(feature(geometry_type, F.col(coordinates), properties)).write.mode("overwrite").text(path)


def log_run(df: DataFrame, path: str, new: DataFrame, key: str) -> None:
    """The run log with the rows of ``new`` in place of older ones with the same key, as a new version."""
    upsert(df, new, key).write.mode("overwrite").parquet(path)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
