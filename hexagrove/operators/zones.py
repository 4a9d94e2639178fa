"""Zones of cells on the hexagon grid: components of equal class, boundary, depth, rank; rings.

Cells are dealt to square tiles of the axial grid. What lies inside a tile is settled there at once, so that only links
and depths across tiles' borders take rounds of Spark jobs; rounds go on until nothing changes. Every round is written.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexagrove.functions.hexgrid import DIRECTIONS, neighbours
from hexagrove.functions.scalars import round_even
from hexagrove.operators.lineage import written

#: Side of a tile; a task holds a tile's cells and those around it.
TILE = 64
FAR = 2**30


def edges_within(cells: DataFrame, key: str = "cell", cls: str = "cls") -> DataFrame:
    """Pairs (src, dst) of neighbouring cells of one class. ``cells``: key, q, r, cls."""
    near = neighbours(cells.select(F.col(key).alias("src"), "q", "r", cls)).select("src", F.col(cls).alias("__c"), F.col("nq").alias("q"), F.col("nr").alias("r"))
    return near.join(cells.select(F.col(key).alias("dst"), "q", "r", cls), ["q", "r"]).where(F.col("__c") == F.col(cls)).select("src", "dst")


def _grid(pdf: pd.DataFrame, values: dict[str, int]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Places of a tile's rows on a grid with a rim of one cell, and grids of the named columns, filled where none is."""
    r, q = (pdf[c].to_numpy() - pdf[t].iloc[0] * TILE + 1 for c, t in (("r", "tr"), ("q", "tq")))
    out = {}
    for name, fill in values.items():
        out[name] = np.full((TILE + 2, TILE + 2), fill, np.int64)
        out[name][r, q] = pdf[name].to_numpy()
    return r, q, out


def _around(grid: np.ndarray, fill: int) -> list[np.ndarray]:
    """The grid as each of the six neighbours sees it."""
    padded = np.pad(grid, 1, constant_values=fill)
    h, w = grid.shape
    return [padded[1 + dr : 1 + dr + h, 1 + dq : 1 + dq + w] for dq, dr in DIRECTIONS]


def _classed(cells: DataFrame, key: str, cls: str) -> DataFrame:
    """Cells with the hash of their class and their tile; equal classes have equal hashes."""
    tile = {t: F.floor(F.col(c) / TILE).cast("long") for t, c in (("tq", "q"), ("tr", "r"))}
    return cells.where(F.col(cls).isNotNull()).select(F.col(key).cast("long").alias("cell"), F.col("q").cast("long"), F.col("r").cast("long"), F.xxhash64(cls).alias("cls")).withColumns(tile)


def _settle_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    r, q, g = _grid(pdf, {"cell": np.iinfo(np.int64).max, "cls": 0})
    known = g["cell"] != np.iinfo(np.int64).max
    label = g["cell"]
    same = [known & k & (g["cls"] == c) for c, k in zip(_around(g["cls"], 0), _around(known, False))]
    while True:
        new = label
        for near, ok in zip(_around(label, 0), same):
            new = np.where(ok, np.minimum(new, near), new)
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"cell": pdf["cell"], "root": label[r, q]})


def spread_labels(edges: DataFrame) -> DataFrame:
    """(root, zone): the least node that each node of a symmetric edge table (a, b) reaches. Labels spread to neighbours and
    jump to their label's label until nothing changes."""
    labels = edges.select(F.col("a").alias("root"), F.col("a").alias("zone")).distinct()
    while True:
        least = edges.join(labels.withColumnRenamed("root", "b"), "b").groupBy("a").agg(F.min("zone").alias("least"))
        spread = labels.join(least, F.col("root") == F.col("a")).select("root", F.least("zone", "least").alias("next"), "zone")
        jump = spread.select(F.col("root").alias("next"), F.col("next").alias("further"))
        new = written(spread.join(jump, "next").select("root", F.least("next", "further").alias("next"), "zone"))
        labels = new.select("root", F.col("next").alias("zone"))
        if not new.where("next <> zone").limit(1).count():
            return labels


def components(cells: DataFrame, key: str = "cell", cls: str = "cls") -> DataFrame:
    """(key, zone): the smallest cell of each component. Tiles label their own parts; between parts labels spread and jump to their
    label's label, so that rounds grow with the logarithm of a component's width in tiles. Cells without class are zones alone."""
    own = _classed(cells, key, cls)
    local = written(own.join(own.groupBy("tq", "tr").applyInPandas(_settle_labels, "cell long, root long"), "cell"))
    rim = local.where(F.pmod("q", F.lit(TILE)).isin(0, TILE - 1) | F.pmod("r", F.lit(TILE)).isin(0, TILE - 1))
    near = neighbours(rim.select("q", "r", "cls", "tq", "tr", F.col("root").alias("a"))).select(F.col("nq").alias("q"), F.col("nr").alias("r"), "cls", F.col("tq").alias("oq"), F.col("tr").alias("or"), "a")
    edges = written(near.join(rim.select("q", "r", "cls", "tq", "tr", F.col("root").alias("b")), ["q", "r", "cls"]).where("tq <> oq or tr <> or").select("a", "b").distinct())
    labels = spread_labels(edges)
    zoned = local.join(labels, "root", "left").select("cell", F.coalesce("zone", "root").alias("zone"))
    alone = cells.where(F.col(cls).isNull()).select(F.col(key).cast("long").alias("cell"), F.col(key).cast("long").alias("zone"))
    return zoned.union(alone).withColumnRenamed("cell", key)


def _settle_depths(pdf: pd.DataFrame) -> pd.DataFrame:
    r, q, g = _grid(pdf, {"depth": FAR, "cls": 0, "known": 0})
    known = g["known"] > 0
    same = [known & k & (g["cls"] == c) for c, k in zip(_around(g["cls"], 0), _around(known, False))]
    depth = g["depth"]
    inside = np.zeros(depth.shape, bool)
    inside[1:-1, 1:-1] = known[1:-1, 1:-1]
    depth = np.where(inside & ~np.logical_and.reduce(same), 0, depth)
    while True:
        new = depth
        for near, ok in zip(_around(depth, FAR), same):
            new = np.where(ok & inside, np.minimum(new, near + 1), new)
        if (new == depth).all():
            break
        depth = new
    mine = pdf["own"].to_numpy()
    return pd.DataFrame({"cell": pdf["cell"], "depth": depth[r, q], "before": pdf["depth"]})[mine]


def depths(cells: DataFrame, zones: DataFrame, key: str = "cell", cls: str = "cls") -> DataFrame:
    """``zones`` with the steps from the zone's boundary: cells with any of six neighbours outside the zone have 0. Each
    round settles all tiles with the depths on their rims; a depth crosses one tile a round."""
    own = _classed(cells, key, cls).withColumn("known", F.lit(1).cast("long"))
    at = written(own.withColumn("depth", F.lit(FAR).cast("long")))
    while True:
        tiles = {t: F.explode(F.sequence(F.floor((F.col(c) - 1) / TILE), F.floor((F.col(c) + 1) / TILE))) for t, c in (("hq", "q"), ("hr", "r"))}
        spread = at.withColumn("hq", tiles["hq"]).withColumn("hr", tiles["hr"]).withColumn("own", (F.col("hq") == F.col("tq")) & (F.col("hr") == F.col("tr"))).drop("tq", "tr").withColumnsRenamed({"hq": "tq", "hr": "tr"})
        new = written(spread.groupBy("tq", "tr").applyInPandas(_settle_depths, "cell long, depth long, before long"))
        if not new.where("depth <> before").limit(1).count():
            break
        at = written(own.join(new.select("cell", "depth"), "cell"))
    depth = new.select(F.col("cell").alias(key), F.col("depth").cast("int").alias("depth"))
    return zones.join(depth, key, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def core_zones(cells: DataFrame, key: str = "cell", cls: str = "cls") -> DataFrame:
    """zone, zone_size, core_distance, core_score (share of the deepest), center_mass_rank."""
    deep = depths(cells, components(cells, key, cls), key, cls)
    zone = deep.groupBy("zone").agg(F.count(F.lit(1)).alias("zone_size"), F.max("depth").alias("deepest"))
    out = deep.join(zone, "zone")
    score = F.when(F.col("deepest") > 0, round_even(F.col("depth") / F.col("deepest"), 3)).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("depth"), key))
    return out.select(key, "zone", "zone_size", F.col("depth").alias("core_distance"), score.alias("core_score"), rank.alias("center_mass_rank"))


def core_label(out: DataFrame) -> DataFrame:
    label = F.when(F.col("zone_size") <= 1, "single").when(F.col("core_score") >= 0.72, "deep core").when(F.col("core_score") >= 0.34, "middle").otherwise("edge")
    return out.withColumn("core_label", label)


def rings(cells: DataFrame, seeds: DataFrame, most: int, key: str = "cell") -> DataFrame:
    """(key, ring): steps over neighbouring cells from the nearest seed, up to ``most``. A round joins the last ring only: its
    neighbours lie in it, in the ring before or in the next."""
    place = cells.select(key, "q", "r")
    found = [written(place.join(seeds.select(key).distinct(), key, "left_semi").withColumn("ring", F.lit(0)))]
    for ring in range(1, most + 1):
        near = neighbours(found[-1].select("q", "r")).select(F.col("nq").alias("q"), F.col("nr").alias("r")).distinct()
        before = reduce(lambda a, b: a.unionByName(b), found[-2:]).select(key)
        found.append(written(place.join(near, ["q", "r"]).join(before, key, "left_anti").select(key, "q", "r", F.lit(ring).alias("ring"))))
    return reduce(lambda a, b: a.unionByName(b), found).select(key, "ring")
