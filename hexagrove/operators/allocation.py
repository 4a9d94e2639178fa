"""Greedy allocation of an area need to ranked cells, without a loop and without one task.

In rank order a cell gets ``least(area, need - areas before it)``. The running sum over all cells would be one
window over one partition; here rows are range-partitioned by the order, summed within each
partition, and shifted by the partitions' totals, a table of one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.operators.lineage import written


def running_totals(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` with ``__rank`` (from 1) and ``__before`` (sum of ``value`` over earlier rows)."""
    placed = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    parts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    # One row for each partition: bounded by the number of shuffle partitions.
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("__p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n0"), F.coalesce(F.sum("v").over(earlier), F.lit(0.0)).alias("__v0"))
    within = Window.partitionBy("__p").orderBy(*order)
    ranked = placed.withColumn("__i", F.row_number().over(within)).withColumn("__s", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = ranked.join(F.broadcast(shifts), "__p").withColumn("__rank", F.col("__i") + F.col("__n0")).withColumn("__before", F.col("__s") + F.col("__v0"))
    return out.drop("__p", "__i", "__s", "__n0", "__v0")


def allocate(df: DataFrame, need: float, area: str, order: list[Column], cell_area: float | None = None) -> DataFrame:
    """The cells that get area: ``selected_rank``, ``allocated_area``, ``remaining_area_after``."""
    ranked = running_totals(df.where(F.col(area) > 0), order, area)
    got = F.least(F.col(area), F.greatest(F.lit(0.0), F.lit(need) - F.col("__before")))
    out = ranked.withColumn("allocated_area", got).where(F.col("allocated_area") > 1e-12)
    out = out.withColumn("remaining_area_after", F.greatest(F.lit(0.0), F.lit(need) - F.col("__before") - F.col("allocated_area"))).withColumnRenamed("__rank", "selected_rank").drop("__before")
    return out.withColumn("allocated_share_pct", F.col("allocated_area") / cell_area * 100) if cell_area else out


def summary(selected: DataFrame, need: float, cell_area: float) -> DataFrame:
    """One row: areas, unmet need, cells needed and used."""
    total = F.coalesce(F.sum("allocated_area"), F.lit(0.0))
    return selected.agg(
        total.alias("selected_area"),
        F.greatest(F.lit(0.0), F.lit(need) - total).alias("unmet_area"),
        F.count(F.lit(1)).alias("selected_cells"),
    ).withColumn("needed_cells", F.ceil(F.lit(need / cell_area)))
