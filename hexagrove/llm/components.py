"""Connected components of an edge table as Spark jobs.

Alternating large-star and small-star rounds: each node first hangs its larger neighbours on its
smallest one, then its smaller neighbours; after O(log) rounds the edges are one star for each component.
The rounds go on until the edges stay as they are. Every round's edges are a Parquet table in the shared
folder, dropped when the next round's is written: a checkpoint would keep the size estimate of its plan,
whose digits multiply with each round's joins. Nothing but two totals reaches the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import Tables


def _total(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to rows (node, component): the smallest node that each node reaches."""
    tables = Tables(edges.sparkSession)
    e = tables.write("0", edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = _total(e)
    for k in count(1):
        if not before[0]:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smallest, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        e = tables.write(f"{k}", small)
        tables.drop(f"{k - 1}")
        after = _total(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", "a").distinct())
