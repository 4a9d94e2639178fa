"""Whitening of embeddings by the leading eigenvectors of their covariance, isolated by spectrum slicing.

Entries become whole numbers, so that sums and centred products are exact: a first pass gives counts and sums, a second
one the products of entries less a whole number near their mean, from which the covariance follows with one rounding
for each entry. Both passes send d or d * (d + 1) / 2 numbers from each task, and the driver holds the d by d matrix alone.

There the symmetric indefinite factorisation L D L' of the covariance less a shift tells by the signs of D how many
eigenvalues lie above the shift (Sylvester's law of inertia). Halving finds an interval with one eigenvalue, or
with several that no double tells apart; Rayleigh quotient iteration goes to it in a few steps, and counts just below
and just above certify its number. Another pass whitens, and measures the covariance of what it gave.

Cases: a row whose vector is null or holds a null or non-finite entry is left out; so is one with an entry
that exceeds 2**47 after scaling, or whose length is not the most frequent one (of equally frequent ones, the largest).
Rows with one id are rows each; a null id passes. A component with no variance (its eigenvalue below ``FLAT`` of the trace,
or no more than one distinct vector) gives no rows, as nothing can be divided by it. An empty table gives an empty result.
``deviation`` is null where it exceeds 64 bits. Among eigenvectors of equal eigenvalues any orthonormal ones are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, LIMIT = 1024, 100_000, float(1 << 47)
#: Share of the trace below which an eigenvalue counts as none.
FLAT = 1e-13


def whole_numbers(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``d`` finite entries, and these rows as whole numbers."""
    if pa.types.is_large_list(vectors.type) or pa.types.is_list(vectors.type):
        size = np.array(pc.list_value_length(vectors).fill_null(-1), np.int64)
    else:
        raise TypeError(f"vectors are lists, not {vectors.type}")
    fit = size == d
    flat = vectors.filter(pa.array(fit)).flatten().cast(pa.float64())
    c = np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    with np.errstate(invalid="ignore", over="ignore"):
        ok = (np.abs(c * SCALE) <= LIMIT).all(axis=1)
    fit[np.flatnonzero(fit)[~ok]] = False
    return fit, np.floor(c[ok] * SCALE).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    high, low = (x >> 24).sum(axis=0), (x & ((1 << 24) - 1)).sum(axis=0)
    return [(int(a) << 24) + int(b) for a, b in zip(high, low)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """The sum of the rows' outer products, as Python's integers."""
    most = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // max(1, most * most)
    if not rows:
        z = y.astype(object)
        return z.T @ z
    total = np.zeros((y.shape[1],) * 2, object)
    for a in range(0, len(y), rows):
        part = y[a : a + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def entries(values: dict[tuple[int, int], int]) -> pa.RecordBatch:
    i, j = zip(*values) if values else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in values.values()], pa.string())], names=["i", "j", "v"])


def first_moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            _, x = whole_numbers(batch.column("vector"), d)
            n, total = n + len(x), [a + b for a, b in zip(total, exact_sums(x))]
        if n:
            yield entries({(-1, -1): n} | {(i, -1): v for i, v in enumerate(total)})

    return run


def second_moments(middle: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(middle)
        total = np.zeros((d, d), object)
        for batch in batches:
            total = total + exact_products(whole_numbers(batch.column("vector"), d)[1] - np.array(middle, np.int64))
        yield entries({(i, j): total[i, j] for i in range(d) for j in range(i, d) if total[i, j]})

    return run


def gathered(moments: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over tasks; the driver gets one number for each entry."""
    rows = moments.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return {(r["i"], r["j"]): int(r["v"]) for r in rows}


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``shift``: positive pivots of L D L' with complete
    pivoting, in which a pivot of two rows has one positive and one negative eigenvalue."""
    a = a - shift * np.eye(len(a))
    ratio, positive = (1 + 17**0.5) / 8, 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        i, j = np.unravel_index(int(np.abs(a).argmax()), a.shape)
        if abs(a[i, j]) == 0:
            break
        if diagonal[p] >= ratio * abs(a[i, j]):
            positive += a[p, p] > 0
            rest = np.delete(np.arange(len(a)), p)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:
            positive += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            columns = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_([i, j], [i, j])], columns.T)
        a = (a + a.T) / 2
    return positive


def _towards(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    try:
        y = np.linalg.solve(v - shift * np.eye(len(v)), x)
    except np.linalg.LinAlgError:
        y = np.linalg.solve(v - (shift + 4e-16 * (np.abs(v).max() + 1e-300)) * np.eye(len(v)), x)
    return y / np.linalg.norm(y)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; fewer, where
    the rest are flat."""
    trace, d = float(np.trace(v)), len(v)
    if trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12)
    near = 8 * np.finfo(float).eps * d * top
    rng = np.random.default_rng(5)
    values, vectors, counts = [], np.zeros((d, 0)), {top: 0, 0.0: d}

    def count(at: float) -> int:
        if at not in counts:
            counts[at] = above(v, at)
        return counts[at]

    for j in range(1, k + 1):
        if count(FLAT * trace) < j:
            break
        low = max(a for a, c in counts.items() if c >= j)
        high = min(a for a, c in counts.items() if c < j)
        while True:
            while count(low) - count(high) > 1 and high - low > near:
                middle = (low + high) / 2
                low, high = (middle, high) if count(middle) >= j else (low, middle)
            cluster = count(low) - count(high) > 1
            # Where several lie within rounding, what was found of them is kept away from.
            x = rng.standard_normal(d)
            rho = (low + high) / 2
            for step in range(60):
                x = _towards(v, rho, x - vectors @ (vectors.T @ x))
                x -= vectors @ (vectors.T @ x)
                x /= np.linalg.norm(x)
                found = float(x @ v @ x)
                residual = float(np.linalg.norm(v @ x - found * x))
                if residual <= near / 4:
                    break
                # Inverse iteration until the quotient lies inside, then Rayleigh's quotient as the shift.
                if not cluster and low < found < high and residual < (high - low) / 2:
                    rho = found
            if cluster or low <= found <= high or high - low <= near:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= j else (low, middle)
        slack = max(near, 2 * residual)
        if not (count(found - slack) >= j > count(found + slack)):
            raise ArithmeticError(f"eigenvalue {j} is not certified: {count(found - slack)} above {found - slack}, {count(found + slack)} above {found + slack}")
        values.append(found)
        vectors = np.column_stack((vectors, x))
    return np.array(values), vectors


@dataclass
class Model:
    """What whitening needs: rows, sums, a whole number near each mean, leading eigenvalues and vectors, the trace."""

    n: int
    sums: list[int]
    middle: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, self.middle)])
        return ((x - np.array(self.middle, np.int64)) - rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S)**2."""
        y, rest = x - np.array(self.middle, np.int64), [s - self.n * m for s, m in zip(self.sums, self.middle)]
        about = ((self.n * y.astype(np.float64) - np.array(rest, np.float64)) ** 2).sum(axis=1)
        if self.n < 1 << 62 and about.max(initial=0) < 1 << 62:
            return ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in y)
        return [e if e < 1 << 63 else None for e in exact]


def fit(df: DataFrame, vector: str = "embedding", k: int = 8) -> Model:
    """The model over every usable row of ``df``."""
    vectors = df.select(F.col(f"`{vector}`").alias("vector")).where(F.col("vector").isNotNull())
    usual = vectors.groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    moments = gathered(vectors.mapInArrow(first_moments(d), "i int, j int, v string")) if d else {}
    n = moments.get((-1, -1), 0)
    if not n:
        return Model(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0)
    sums = [moments[i, -1] for i in range(d)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    products = gathered(vectors.mapInArrow(second_moments(middle), "i int, j int, v string"))
    rest = [s - n * m for s, m in zip(sums, middle)]
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - rest[i] * rest[j]) / (n * n)
    values, basis = leading(v, k)
    return Model(n, sums, middle, values, basis, float(np.trace(v)))


def identity_error(df: DataFrame, model: Model, vector: str = "embedding") -> float:
    """The largest entry of the covariance of the whitened rows less the identity, measured on all rows."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            w = model.whitened(whole_numbers(batch.column("vector"), len(model.middle))[1])
            total += w.T @ np.column_stack((w, np.ones(len(w))))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    moments = np.zeros((k, k + 1))
    sums = df.select(F.col(f"`{vector}`").alias("vector")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in sums.collect():
        moments[r["i"], r["j"]] = r["v"] / model.n
    return float(np.abs(moments[:, :k] - np.outer(moments[:, k], moments[:, k]) - np.eye(k)).max(initial=0))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row for each usable row of ``df`` and component: key, component, n, deviation, whitened, explained, identity_error."""
    model = fit(df, vector, k)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [df.schema[key].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    components = len(model.values)
    if not components:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(df, model, vector)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit_rows, x = whole_numbers(batch.column("vector"), len(model.middle))
            rows = np.repeat(np.arange(len(x)), components)
            component = np.tile(np.arange(components), len(x))
            columns = [batch.column("key").filter(pa.array(fit_rows)).take(pa.array(rows)), pa.array((component + 1).astype(np.int32))]
            columns += [pa.array(np.full(len(rows), model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(rows))]
            columns += [pa.array(model.whitened(x).ravel()), pa.array(explained[component]), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("vector")).mapInArrow(run, schema)
