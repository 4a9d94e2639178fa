"""Factor analysis, eigenvalues and k-means over wide frames.

The correlation matrix comes from one distributed pass; it has as many rows as there are columns, so the
decomposition runs on the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vectors(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    values = F.slice(column, 1, first) if first else F.col(column)
    return df.where(F.col(column).isNotNull()).select(array_to_vector(values.cast("array<double>")).alias("features"))


def correlation(df: DataFrame) -> tuple[list[str], np.ndarray]:
    matrix = Correlation.corr(df, "features").first()[0].toArray()
    return [f"v{i + 1}" for i in range(len(matrix))], matrix


def eigenvalues(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Eigenvalues of a correlation matrix, largest first, with their cumulative share."""
    values = np.linalg.eigvalsh(matrix)[::-1]
    return spark.createDataFrame([(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(values, np.cumsum(values) / values.sum()))], "component int, eigenvalue double, cumulative double")


def principal_axes(matrix: np.ndarray, n: int, rounds: int = 200) -> np.ndarray:
    """Loadings by iterated principal axes: communalities replace the diagonal until they settle, which
    is where the minimum-residual criterion has its stationary point."""
    inverse = np.linalg.pinv(matrix)
    common = np.clip(1 - 1 / np.diag(inverse), 0.01, 0.99)
    for _ in range(rounds):
        reduced = matrix.copy()
        np.fill_diagonal(reduced, common)
        values, axes = np.linalg.eigh(reduced)
        out = axes[:, ::-1][:, :n] * np.sqrt(np.clip(values[::-1][:n], 0, None))
        new = np.clip((out**2).sum(axis=1), 0, 0.999)
        if np.abs(new - common).max() < 1e-9:
            break
        common = new
    return out


def varimax(loading: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Orthogonal rotation to the largest variance of squared loadings, by singular value steps."""
    rows, n = loading.shape
    turn, last = np.eye(n), 0.0
    for _ in range(rounds):
        now = loading @ turn
        u, s, vt = np.linalg.svd(loading.T @ (now**3 - now * (now**2).sum(axis=0) / rows))
        turn = u @ vt
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    return loading @ turn


def loadings(spark: SparkSession, names: list[str], matrix: np.ndarray, n_factors: int = 5) -> DataFrame:
    """Rotated loadings in long form; each factor's largest loading is positive."""
    rotated = varimax(principal_axes(matrix, n_factors))
    rotated = rotated[:, np.argsort(-(rotated**2).sum(axis=0))]
    rotated = rotated * np.sign(rotated[np.abs(rotated).argmax(axis=0), range(n_factors)])
    rows = [(name, f"F{k + 1}", float(rotated[i, k])) for i, name in enumerate(names) for k in range(n_factors)]
    return spark.createDataFrame(rows, "variable string, factor string, loading double")


def congruence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tucker's congruence of every factor of one solution with every factor of another."""
    return (a.T @ b) / np.sqrt(np.outer((a**2).sum(axis=0), (b**2).sum(axis=0)))


class _Start:
    """One run of k-means: its k, its centres, and the cost of its last pass."""

    def __init__(self, k: int, centres: np.ndarray):
        self.k, self.centres, self.cost, self.settled = k, centres, 0.0, False


def _pass(rows: DataFrame, runs: list[_Start]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each run, in one pass over the rows: the counts and the sums of the rows nearest to each centre, and the cost.

    Every task returns one row for each centre that has rows in it; these are summed by Spark before the driver takes them.
    """
    centres = np.concatenate([r.centres for r in runs])
    ends = np.cumsum([len(r.centres) for r in runs])
    starts, d = ends - [len(r.centres) for r in runs], centres.shape[1]
    # Runs of as many centres that follow each other: the first centre, the runs, and the centres of each.
    alike = [(int(starts[own[0]]), len(own), k) for k, own in ((k, [i for i, _ in g]) for k, g in groupby(enumerate(runs), lambda r: len(r[1].centres)))]
    # Lengths are taken from a point amid the centres, where they lose the fewest digits.
    origin = centres.mean(axis=0)
    moved = centres - origin
    lengths = (moved**2).sum(axis=1)
    # Rows at a time: their distances to all centres take 8 MB.
    step = max(1, (1 << 20) // len(moved))

    def summed(batches):
        n, cost, total = np.zeros(len(moved)), np.zeros(len(moved)), np.zeros((len(moved), d))
        for batch in batches:
            column = batch.column(0)
            whole = column.flatten().to_numpy().reshape(len(column), d) - origin
            for first in range(0, len(whole), step):
                x = whole[first : first + step]
                apart = x @ moved.T
                apart *= -2
                apart += lengths
                own = (x**2).sum(axis=1)[:, None]
                hits = np.zeros_like(apart)
                for a, count, k in alike:
                    part = apart[:, a : a + count * k].reshape(len(x), count, k)
                    best = part.argmin(axis=2)
                    near = np.take_along_axis(part, best[:, :, None], axis=2)[:, :, 0] + own
                    # A run's cost stands at its first centre.
                    cost[a : a + count * k : k] += np.maximum(near, 0.0).sum(axis=0)
                    hits[np.arange(len(x))[:, None], best + np.arange(a, a + count * k, k)] = 1.0
                n += hits.sum(axis=0)
                total += hits.T @ x
        at = np.flatnonzero((n > 0) | (cost != 0))
        if len(at):
            values = np.column_stack((n, cost, total))[at]
            yield pa.RecordBatch.from_pydict({"centre": at.astype(np.int32), "sums": pa.array(list(values), pa.list_(pa.float64()))})

    each = rows.mapInArrow(summed, "centre int, sums array<double>")
    found = np.zeros((len(moved), d + 2))
    for r in each.groupBy("centre").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(d + 2))).alias("sums")).collect():
        found[r["centre"]] = r["sums"]
    found[:, 2:] += found[:, :1] * origin
    return [(found[a:b, 0], found[a:b, 2:], float(found[a:b, 1].sum())) for a, b in zip(starts, ends)]


def _drawn(rows: DataFrame, ks: list[int], starts: int, seed: int) -> list[_Start]:
    """``starts`` runs for each k, their first centres distinct rows at random, as in R's ``kmeans``: one job draws as many
    rows as the runs have centres, and each run draws its own of these."""
    pool = rows.dropDuplicates(["v"]).orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sum(ks) * starts).collect()
    pool, rng = np.array([r["v"] for r in pool]), np.random.default_rng(seed)
    return [_Start(k, pool[rng.choice(len(pool), min(k, len(pool)), replace=False)]) for k in ks for _ in range(starts)]


def kmeans(df: DataFrame, column: str, ks: Iterable[int], seeds: Iterable[int] = (42,), rounds: int = 50, close: float = 1e-4, starts: int | None = None) -> DataFrame:
    """Cluster sizes for each k, of the run with the least cost.

    MLlib draws the first centres of a run for each seed; with ``starts``, so many runs for each k start from rows drawn at
    random by the first seed. Then all runs go on together, one pass over the rows a round for as many as have not settled,
    by MLlib's own rules: a run settles when no centre moves further than ``close``, a centre without rows stays, and the
    cost is that of the last round's assignment.
    """
    ks, seeds = list(ks), list(seeds)
    plain = df.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    n = plain.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    plain = plain.repartition(max(1, min(cores, n >> 12), n >> 18)).cache()
    if starts:
        runs = _drawn(plain, ks, starts, seeds[0])
    else:
        rows = vectors(df, column).cache()
        first = lambda k, seed: np.array(KMeans(k=k, seed=seed, maxIter=0).fit(rows).clusterCenters())
        runs = [_Start(k, first(k, seed)) for k in ks for seed in seeds]
        rows.unpersist()
    for _ in range(rounds):
        going = [r for r in runs if not r.settled]
        if not going:
            break
        for run, (n, total, cost) in zip(going, _pass(plain, going)):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], run.centres)
            run.settled = bool((((new - run.centres) ** 2).sum(axis=1) <= close**2).all())
            run.centres, run.cost = new, cost
    best = {}
    for run in runs:
        best.setdefault(run.k, []).append(run)
    best = [min(of_k, key=lambda r: r.cost) for of_k in best.values()]
    found = []
    for run, (n, _, _) in zip(best, _pass(plain, best)):
        sizes = sorted((int(x) for x in n), reverse=True)
        found += [(run.k, i, x, run.cost) for i, x in enumerate(sizes + [0] * (run.k - len(sizes)))]
    plain.unpersist()
    return df.sparkSession.createDataFrame(found, "k int, rank int, n long, cost double")


def _root(matrix: np.ndarray, power: float) -> np.ndarray:
    """A symmetric matrix to a power, by its eigenvalues."""
    values, axes = np.linalg.eigh(matrix)
    return (axes * np.clip(values, 1e-12, None) ** power) @ axes.T


def score_weights(matrix: np.ndarray, loading: np.ndarray, phi: np.ndarray | None = None) -> np.ndarray:
    """Weights of standardised variables whose scores have exactly the factors' correlation ``phi`` (none: uncorrelated):
    of all such scores those closest to the factors."""
    phi = np.eye(loading.shape[1]) if phi is None else phi
    turned = loading @ _root(phi, 0.5)
    back = _root(matrix, -0.5)
    inner = turned.T @ np.linalg.solve(matrix, turned)
    return back @ (back @ turned @ _root(inner, -0.5)) @ _root(phi, 0.5)


def scores(df: DataFrame, key: str, column: str, weights: np.ndarray) -> DataFrame:
    """Factor scores of every row: one pass for means and sample deviations, then one projection of columns."""
    d, n = weights.shape
    value = F.col(column).cast("array<double>")
    rows = df.where(F.col(column).isNotNull()).select(key, value.alias("v"))
    moments = rows.agg(*(f(F.get("v", F.lit(i))).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    means, widths = ([moments[f"{name}{i}"] for i in range(d)] for name in "ms")
    scaled = weights / np.array([w or 1.0 for w in widths])[:, None]
    shift = np.array(means) @ scaled

    def score(k: int):
        weight = F.lit(np.array(scaled[:, k]))
        return F.aggregate(F.zip_with("v", weight, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) - float(shift[k])

    return rows.select(key, *(score(k).alias(f"F{k + 1}") for k in range(n)))


def oblimin(loading: np.ndarray, rounds: int = 1000, close: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation: loadings and factor correlations that make squared loadings share the least between
    factors, by projecting the criterion's gradient onto rotations with columns of length 1."""
    n = loading.shape[1]
    others = np.ones((n, n)) - np.eye(n)

    def value(turn: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(turn)
        now = loading @ inverse.T
        shared = now**2 @ others
        return float((now**2 * shared).sum() / 4), now, -(now.T @ (now * shared) @ inverse).T

    turn, step = np.eye(n), 1.0
    cost, now, gradient = value(turn)
    for _ in range(rounds):
        along = gradient - turn * (turn * gradient).sum(axis=0)
        size = float(np.linalg.norm(along))
        if size < close:
            break
        step *= 2
        for _ in range(20):
            tried = turn - step * along
            tried /= np.sqrt((tried**2).sum(axis=0))
            less, other, slope = value(tried)
            if cost - less > 0.5 * size**2 * step:
                break
            step /= 2
        turn, cost, now, gradient = tried, less, other, slope
    return now, turn.T @ turn


def fit_indices(matrix: np.ndarray, loading: np.ndarray, n_rows: int, phi: np.ndarray | None = None) -> dict[str, float]:
    """How well a factor model of a correlation matrix fits: TLI, RMSEA, BIC, root mean residuals, shares explained."""
    p, m = loading.shape
    model = loading @ (np.eye(m) if phi is None else phi) @ loading.T
    residual = matrix - model
    off = residual - np.diag(np.diag(residual))
    free = p * (p - 1) / 2 - p * m + m * (m - 1) / 2
    np.fill_diagonal(model, 1.0)
    ratio = np.linalg.solve(model, matrix)
    discrepancy = float(np.trace(ratio) - np.linalg.slogdet(ratio)[1] - p)
    weight = n_rows - 1 - (2 * p + 5) / 6
    statistic = discrepancy * (weight - 2 * m / 3)
    none = -np.linalg.slogdet(matrix)[1] * weight / (p * (p - 1) / 2)
    without = matrix - np.diag(np.diag(matrix))
    return {
        "cumulative_var": float((loading**2).sum() / p),
        "TLI": float((none - statistic / free) / (none - 1)) if free > 0 else float("nan"),
        "RMSEA": max(discrepancy / free - 1 / (n_rows - 1), 0.0) ** 0.5 if free > 0 else float("nan"),
        "BIC": float(statistic - free * np.log(n_rows)),
        "rms": float((off**2).sum() / (p * (p - 1))) ** 0.5,
        "crms": float((off**2).sum() / (2 * free)) ** 0.5 if free > 0 else float("nan"),
        "fit": float(1 - (residual**2).sum() / (matrix**2).sum()),
        "fit_off": float(1 - (off**2).sum() / (without**2).sum()),
    }


def factor_sweep(df: DataFrame, column: str, counts: Iterable[int]) -> DataFrame:
    """Fit indices for each number of factors, in long form; one pass over the rows for all."""
    rows = vectors(df, column)
    _, matrix = correlation(rows)
    n_rows = rows.count()
    found = [(m, name, float(v)) for m in counts for name, v in fit_indices(matrix, principal_axes(matrix, m), n_rows).items()]
    return df.sparkSession.createDataFrame(found, "n_factors int, metric string, value double")


def oblique(df: DataFrame, column: str, n_factors: int) -> DataFrame:
    """Oblique loadings and factor correlations in long form, with the congruence of each factor with its nearest one
    of the orthogonal rotation."""
    names, matrix = correlation(vectors(df, column))
    axes = principal_axes(matrix, n_factors)
    turned, phi = oblimin(axes)
    near = np.abs(congruence(turned, varimax(axes))).max(axis=1)
    rows = [("loading", name, f"F{k + 1}", float(turned[i, k])) for i, name in enumerate(names) for k in range(n_factors)]
    rows += [("phi", f"F{i + 1}", f"F{k + 1}", float(phi[i, k])) for i in range(n_factors) for k in range(n_factors)]
    rows += [("congruence", "varimax", f"F{k + 1}", float(near[k])) for k in range(n_factors)]
    return df.sparkSession.createDataFrame(rows, "kind string, variable string, factor string, value double")
