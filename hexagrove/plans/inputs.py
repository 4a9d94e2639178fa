"""Hexagon frames laid over the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexagrove.functions import hexgrid
from hexagrove.plans.registry import read

BASE = (1 << 59) | (9 << 52) | (15 << 45) | hexgrid.unused_bits(9)


def cell_sql(key: str) -> str:
    digits = " | ".join(f"((({key})::BIGINT // {7**i} % 7) << {18 + 3 * i})" for i in range(7))
    return f"({BASE}::BIGINT | {digits})"


def parent_sql(cell: str, level: int) -> str:
    return f"((({cell}) & ({~hexgrid.RESOLUTION_MASK})::BIGINT) | {(level << 52) | hexgrid.unused_bits(level)}::BIGINT)"


def class_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 0 AND {score} < 25 THEN 'very_low' WHEN {score} >= 25 AND {score} < 45 THEN 'low' WHEN {score} >= 45 AND {score} < 65 THEN 'medium' WHEN {score} >= 65 AND {score} < 80 THEN 'high' ELSE 'very_high' END"


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as cells: cell, score 2..100, type, brand."""
    part = read(spark, sf_dir, "part")
    return part.select(hexgrid.synthetic_cell(F.col("p_partkey")).alias("cell"), (F.col("p_size") * 2.0).alias("score"), "p_type", "p_brand", "p_partkey", "p_retailprice")


PART_CELLS = f"cells AS (SELECT {cell_sql('p_partkey')} AS cell, p_size * 2.0::DOUBLE AS score, p_type, p_brand, p_partkey, p_retailprice FROM part)"


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as layer distances: cell of the part, group by return flag, distance, intersects."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(hexgrid.synthetic_cell(F.col("l_partkey")).alias("cell"), F.col("l_returnflag").alias("group_id"), (F.col("l_quantity") * 20).alias("distance_m"), (F.col("l_discount") < 0.005).alias("intersects"))


DISTANCES = f"distances AS (SELECT {cell_sql('l_partkey')} AS cell, l_returnflag AS group_id, l_quantity * 20 AS distance_m, l_discount < 0.005 AS intersects FROM lineitem)"

#: Acceptance of a cell without any distance to a group in D5, D6 and D24: SQL's ``least(1.0, ...)`` skips an unknown distance and leaves 1.
UNKNOWN = 1.0
