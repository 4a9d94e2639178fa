"""Aggregates, windows and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from hexagrove.functions import hexgrid
from hexagrove.functions.scalars import class_of, finite, round_even
from hexagrove.operators.allocation import running_totals
from hexagrove.operators.lineage import written

BREAKS = [("very_low", 0.0, 25.0), ("low", 25.0, 45.0), ("medium", 45.0, 65.0), ("high", 65.0, 80.0), ("very_high", 80.0, 100.0)]


def rollup(df: DataFrame, level: int, score: str = "score", types: tuple[str, ...] = (), source: int = 9, breaks=BREAKS) -> DataFrame:
    """Cells to their parents: mean score, share of high cells, smallest mode of types, child count."""
    high = class_of(F.col(score), breaks).isin("high", "very_high").cast("double")
    up = df.withColumn("cell", hexgrid.parent(F.col("cell"), level)).withColumn("__high", high)
    out = up.groupBy("cell").agg(
        F.count(score).alias("source_child_count"),
        round_even(F.avg(score), 1).alias(score),
        round_even(F.avg("__high"), 3).alias("high_potential_share"),
        *(F.mode(t, True).alias(t) for t in types),
    )
    return out.withColumn("class", class_of(F.col(score), breaks)).withColumn("h3_resolution", F.lit(level)).withColumn("source_resolution", F.lit(source))


def class_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), round_even(F.avg(value), 2).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def with_share(df: DataFrame, n: str, within: list[str] | None = None, out: str = "share") -> DataFrame:
    """Share of a total: the total is aggregated and joined back, so no single task gets all rows."""
    if within:
        return df.join(df.groupBy(*within).agg(F.sum(n).alias("__t")), within).withColumn(out, F.col(n) / F.col("__t")).drop("__t")
    return with_totals(df, F.sum(n).alias("__t")).withColumn(out, F.col(n) / F.col("__t")).drop("__t")


def with_totals(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Global aggregates beside every row: one row is broadcast, nothing is gathered in one window."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


def z_score(df: DataFrame, column: str, out: str, sample: bool = True) -> DataFrame:
    """Standard score; 0 for a flat column with the sample deviation, null with the population's."""
    sd = F.stddev_samp(column) if sample else F.stddev_pop(column)
    df = with_totals(df, F.avg(column).alias("__m"), sd.alias("__s"))
    z = (F.col(column) - F.col("__m")) / F.col("__s")
    flat = F.lit(0.0) if sample else F.lit(None).cast("double")
    return df.withColumn(out, F.when(F.col("__s") > 0, z).otherwise(flat)).drop("__m", "__s")


def min_max(df: DataFrame, column: str, out: str, top: float = 100.0, flat: float = 50.0) -> DataFrame:
    df = with_totals(df, F.min(column).alias("__a"), F.max(column).alias("__b"))
    scaled = (F.col(column) - F.col("__a")) / (F.col("__b") - F.col("__a")) * top
    return df.withColumn(out, F.when(F.col("__b") > F.col("__a"), scaled).otherwise(flat)).drop("__a", "__b")


def counts_before(df: DataFrame, column: str) -> DataFrame:
    """For each distinct value how many rows lie before it and share it; range-partitioned, so that no
    task holds all values."""
    distinct = df.groupBy(column).agg(F.count(F.lit(1)).alias("__peers"))
    return running_totals(distinct, [F.col(column)], "__peers").withColumn("__before", F.col("__before").cast("long")).drop("__rank")


def overall_quantile_type8(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the median-unbiased quantile (type 8) of all known values, from counts of distinct values."""
    known = df.where(F.col(column).isNotNull()).select(column)
    n = F.col("__n")
    place = (n + F.lit(1 / 3)) * p + F.lit(1 / 3)
    ranks = [F.greatest(F.lit(1), F.least(n, F.floor(place) + k)) for k in (0, 1)]
    held = [F.max(F.when((F.col("__before") < r) & (r <= F.col("__before") + F.col("__peers")), F.col(column))) for r in ranks]
    counted = counts_before(known, column).crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("__n"))))
    out = counted.agg(held[0].alias("__a"), held[1].alias("__b"), F.max(place - F.floor(place)).alias("__f"))
    return out.select((F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("quantile"))


def robust_scaled(df: DataFrame, column: str, out: str, p: float = 0.99) -> DataFrame:
    """0 to 1 over the quantile ``p`` of the positive values; unknown and infinite values are 0."""
    x = F.coalesce(finite(F.col(column).cast("double")), F.lit(0.0))
    df = df.withColumn("__x", x)
    cap = overall_quantile_type8(df.where("__x > 0"), "__x", p).select(F.coalesce("quantile", F.lit(1.0)).alias("__cap"))
    return df.crossJoin(F.broadcast(cap)).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__x") / F.col("__cap")))).drop("__x", "__cap")


def percent_rank_average(df: DataFrame, column: str, out: str) -> DataFrame:
    """Percent rank with the average rank for ties, 0 to 100."""
    ranks = counts_before(df, column)
    total = df.agg(F.count(column).alias("__n"))
    rank = F.col("__before") + (F.col("__peers") + 1) / 2
    joined = df.join(ranks, column).crossJoin(F.broadcast(total))
    return joined.withColumn(out, F.when(F.col("__n") > 1, (rank - 1) / (F.col("__n") - 1) * 100).otherwise(0.0)).drop("__before", "__peers", "__n")


def top_per_group(df: DataFrame, groups: list[str], n: int, *order: Column) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def group_quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, tuple[float, int]]) -> DataFrame:
    """For each group the quantiles named in ``wanted`` as (p, type 7 or 8) of its known values.

    Distinct values are counted first and then placed by range partitions over (keys, value), so that no task and no buffer
    holds a group, however large, and a value that many rows share is one row.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__peers"))
    run = running_totals(counts, [*(F.col(k) for k in keys), F.col(column)], "__peers")
    n, before = F.col("__n"), F.col("__before") - F.col("__start")
    groups = run.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min("__before").alias("__start"), F.sum("__peers").alias("__n"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    aggs, outs = [], []
    for name, (p, kind) in wanted.items():
        place = (n - 1) * p + 1 if kind == 7 else (n + F.lit(1 / 3)) * p + F.lit(1 / 3)
        for side in (0, 1):
            rank = F.greatest(F.lit(1), F.least(n, F.floor(place) + side))
            aggs.append(F.max(F.when((before < rank) & (rank <= before + F.col("__peers")), F.col(column))).alias(f"__{name}{side}"))
        aggs.append(F.max(place - F.floor(place)).alias(f"__{name}f"))
        outs.append((F.col(f"__{name}0") + (F.col(f"__{name}1") - F.col(f"__{name}0")) * F.col(f"__{name}f")).alias(name))
    return run.join(groups, same).groupBy(*keys).agg(*aggs).select(*keys, *outs)


def quantile_type8(df: DataFrame, column: str, p: float, keys: list[str]) -> DataFrame:
    """Median-unbiased quantile (type 8) by ranked interpolation."""
    return group_quantiles(df, keys, column, {"quantile": (p, 8)})


def ntile_of(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """The number from 1 to ``k`` of each row's equal part of its group in an order without ties, larger parts first; by
    range partitions, so that no task holds a group."""
    ranked = running_totals(df.withColumn("__one", F.lit(1.0)), [*(F.col(c) for c in keys), *order], "__one").drop("__one", "__before")
    groups = ranked.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys))).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)), F.lit(True))
    rank, least, more = F.col("__rank") - F.col("__first") + 1, F.floor(F.col("__n") / k), F.col("__n") % k
    part = F.when(rank <= more * (least + 1), F.ceil(rank / (least + 1))).otherwise(more + F.ceil((rank - more * (least + 1)) / F.greatest(least, F.lit(1))))
    return ranked.join(groups, same).withColumn(out, part.cast("int")).drop("__rank", "__first", "__n", *(f"__k{i}" for i in range(len(keys))))


def adjusted_rand(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adjusted Rand index of two labelings as one row; null when undefined."""
    cells = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    rows = cells.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    cols = cells.groupBy(y).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    one = both.crossJoin(rows).crossJoin(cols)
    expected = F.col("a") * F.col("b") / pairs(F.col("t"))
    most = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(most != expected, (F.col("s") - expected) / (most - expected)).alias("ari"), F.col("t").alias("n"))


def labels_of(df: DataFrame, key: str, label: str, first: int = 3) -> DataFrame:
    """Up to ``first`` distinct labels of a group in order, as text."""
    distinct = F.array_sort(F.collect_set(label))
    return df.groupBy(key).agg(F.array_join(F.slice(distinct, 1, first), ", ").alias("labels"))


def area_weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    known = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(known)).alias("mean"), (F.coalesce(F.sum(known), F.lit(0.0)) / F.sum(weight) * 100).alias("coverage_pct"))


def _packed(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows (i, u, c) as one row each, in which rows of a cluster lie together: keys, clusters, vectors as bytes of
    ``kind`` and whether each is known. A vector that is null or holds nulls is not known; zeros stand in its place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, block in zip(batch.column("b"), batch.column("rows")):
                rows, codes = block.values, {}
                order = np.argsort([codes.setdefault(c, len(codes)) for c in rows.field("c").to_pylist()], kind="stable")
                i, u, c = (rows.field(name).take(pa.array(order)) for name in "iuc")
                whole = [r if r is not None and None not in r else None for r in u.to_pylist()]
                width = max((len(r) for r in whole if r is not None), default=0)
                vectors = np.array([[0.0] * width if r is None else r for r in whole], dtype=kind).reshape(len(whole), width)
                known = np.array([r is not None for r in whole])
                yield pa.RecordBatch.from_arrays([pa.array([b.as_py()], pa.int32()), pa.array([i.to_pylist()], pa.list_(i.type)), pa.array([c.to_pylist()], pa.list_(c.type)), pa.array([vectors.tobytes()]), pa.array([known.tobytes()])], names=["b", "i", "c", "u", "known"])

    return pack


def _far(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by one product of matrices; where that would lose digits (near pairs, values that are
    not finite) each difference is taken."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = (u**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)
        square = u @ v.T
        square *= -2
        square += whole
        whole *= 1e-4
        near = ~(square > whole)
        for k in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[k])
            square[k, at] = ((v[at] - u[k]) ** 2).sum(axis=1)
        return np.sqrt(square, out=square)


def silhouette(df: DataFrame, key: str, vector: str, cluster: str, side: int = 2048) -> DataFrame:
    """Mean silhouette with Euclidean distances: all pairs, in blocks.

    Rows are dealt to blocks of about ``side`` by their key. Every task holds a block and meets the others one after another,
    as one cartesian product of the written blocks; it adds up each row's distances by the others' clusters, and only these sums
    are shuffled. So disk grows with the rows (one written copy, one shuffled for each side of the product, and a sum for each
    row and cluster), and a task's memory does not; time grows as the square of the rows. A vector that is null or holds nulls
    has no known distance, and rows without a key none at all.
    """
    d = df.select(F.col(key).alias("i"), F.col(vector).alias("u"), F.col(cluster).alias("c"))
    kind = "<f4" if d.schema["u"].dataType.elementType == FloatType() else "<f8"
    d = d if kind == "<f4" else d.withColumn("u", F.col("u").cast("array<double>"))
    key_type, cluster_type = (d.schema[c].dataType.simpleString() for c in ("i", "c"))
    n = max(1, math.ceil(d.count() / side))
    rows = d.where("i is not null").withColumn("b", F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"))
    grouped = rows.groupBy("b").agg(F.collect_list(F.struct("i", "u", "c")).alias("rows"))
    blocks = written(grouped.mapInArrow(_packed(kind), f"b int, i array<{key_type}>, c array<{cluster_type}>, u binary, known binary"))
    # A task's share of the other side is 32 MB of vectors or so: all of them, up to 130,000 rows of 64 floats.
    size = blocks.agg(F.sum(F.length("u"))).first()[0] or 0
    one = blocks.repartitionByRange(n, "b").select(*(F.col(c).alias(f"p{c}") for c in blocks.columns))
    other = blocks.repartitionByRange(max(1, math.ceil(size / (32 << 20))), "b").select(*(F.col(c).alias(f"q{c}") for c in blocks.columns))

    def unpacked(batch: pa.RecordBatch, side: str, at: int) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        i, c = (batch.column(side + name)[at].values for name in "ic")
        vectors = np.frombuffer(batch.column(f"{side}u")[at].as_py(), kind).astype(float)
        return i, c, vectors.reshape(len(i), -1) if len(vectors) else np.zeros((len(i), 0)), np.frombuffer(batch.column(f"{side}known")[at].as_py(), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, i, c, found = None, None, None, {}

        def result() -> Iterator[pa.RecordBatch]:
            for other, (s, m, any_other) in found.items():
                at = pa.array(np.flatnonzero(any_other))
                yield pa.RecordBatch.from_arrays([i.take(at), c.take(at), pa.array([other] * len(at), c.type), pa.array(s).take(at), pa.array(m).take(at)], names=["i", "ci", "cj", "s", "m"])

        for batch in batches:
            for at in range(batch.num_rows):
                mine, theirs = batch.column("pb")[at].as_py(), batch.column("qb")[at].as_py()
                if mine != block:
                    yield from result()
                    block, found = mine, {}
                    i, c, u, has = unpacked(batch, "p", at)
                keys, clusters, v, have = unpacked(batch, "q", at)
                clusters = clusters.to_pylist()
                ends = [k for k in range(1, len(clusters)) if clusters[k] != clusters[k - 1]] + [len(clusters)]
                # Rows of one key lie in one block.
                codes = {} if mine == theirs else None
                named = None if codes is None else np.array([codes.setdefault(x, len(codes)) for x in keys.to_pylist()])
                for a in range(0, len(i), 256):
                    z = min(a + 256, len(i))
                    away = _far(u[a:z], v) if has[a:z].any() and have.any() else np.zeros((z - a, len(have)))
                    away[:, ~have] = 0.0
                    away[~has[a:z]] = 0.0
                    same = np.zeros(away.shape, bool) if named is None else np.equal.outer(named[a:z], named)
                    away[same] = 0.0
                    for first, end in zip([0, *ends], ends):
                        s, m, others = found.setdefault(clusters[first], (np.zeros(len(i)), np.zeros(len(i), np.int64), np.zeros(len(i), bool)))
                        s[a:z] += away[:, first:end].sum(axis=1)
                        m[a:z] += np.where(has[a:z], (have[first:end] & ~same[:, first:end]).sum(axis=1), 0)
                        others[a:z] |= ~same[:, first:end].all(axis=1)
        yield from result()

    pairs = one.join(other.hint("shuffle_replicate_nl"))
    parts = pairs.mapInArrow(sums, f"i {key_type}, ci {cluster_type}, cj {cluster_type}, s double, m bigint").repartition("i", "ci")
    means = parts.groupBy("i", "ci", "cj").agg((F.sum("s") / F.nullif(F.sum("m"), F.lit(0))).alias("d"))
    each = means.groupBy("i", "ci").agg(F.max(F.when(F.col("ci") == F.col("cj"), F.col("d"))).alias("own"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return each.select(F.col("ci").alias("cluster"), s.alias("s")).groupBy("cluster").agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
