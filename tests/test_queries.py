"""Every registered query against its oracle on the smallest tables; those without one by what must hold of them."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

from hexagrove.plans import registry
from tests.oracle import duck, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def embeddings(con) -> np.ndarray:
    return np.array([r[0] for r in con.execute("SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id").fetchall()])


def eigenvalues(rows, con):
    want = np.linalg.eigvalsh(np.corrcoef(embeddings(con).T))[::-1]
    assert np.abs(np.array([r["eigenvalue"] for r in sorted(rows, key=lambda r: -r["eigenvalue"])]) - want).max() < 1e-8
    assert max(r["cumulative"] for r in rows) == pytest.approx(1)


def matrix_of(rows, first, second, value):
    names, others = (sorted({r[c] for r in rows}, key=lambda n: int(n[1:])) for c in (first, second))
    out = np.zeros((len(names), len(others)))
    for r in rows:
        out[names.index(r[first]), others.index(r[second])] = r[value]
    return out


def loadings(rows, con):
    """The model leaves little of the correlations, and no rotation of it has a larger varimax criterion nearby."""
    loading, matrix = matrix_of(rows, "variable", "factor", "loading"), np.corrcoef(embeddings(con).T)
    rest = matrix - loading @ loading.T
    np.fill_diagonal(rest, 0)
    eye = np.sqrt(((matrix - np.eye(len(matrix))) ** 2).sum())
    assert np.sqrt((rest**2).sum()) < eye and ((loading**2).sum(axis=1) <= 1 + 1e-9).all()
    criterion = lambda x: (x**2).var(axis=0).sum()
    for i in range(4):
        for angle in (-0.02, 0.02):
            turn = np.eye(5)
            turn[np.ix_([i, i + 1], [i, i + 1])] = [[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]]
            assert criterion(loading @ turn) <= criterion(loading) + 1e-9


def cluster_sizes(rows, con):
    n, costs = len(embeddings(con)), {}
    for k in {r["k"] for r in rows}:
        own = [r for r in rows if r["k"] == k]
        assert len(own) == k and sum(r["n"] for r in own) == n
        costs[k] = own[0]["cost"]
    assert costs[10] < costs[5]


def oblique(rows, con):
    phi = matrix_of([r for r in rows if r["kind"] == "phi"], "variable", "factor", "value")
    assert np.abs(phi - phi.T).max() < 1e-9 and np.abs(np.diag(phi) - 1).max() < 1e-9 and np.linalg.eigvalsh(phi).min() > 0


def sweep(rows, con):
    rms = {r["n_factors"]: r["value"] for r in rows if r["metric"] == "rms"}
    assert sorted(rms) == list(range(2, 8)) and all(rms[m + 1] <= rms[m] + 1e-9 for m in range(2, 7))


def point_counts(rows, con):
    assert sum(r["n"] for r in rows) == len(embeddings(con))


def lengths(rows, con):
    e = embeddings(con)
    total = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum()
    value = next(c for c in rows[0].asDict() if c not in ("q", "r"))
    assert sum(r[value] for r in rows) == pytest.approx(total, rel=1e-6)


def boundaries(rows, con):
    """Rings of different cells may share corners, never a whole side's middle: each ring is its own, closed, of five corners at least."""
    assert len({r["ring"] for r in rows}) == len(rows) and all(5 <= r["corners"] <= 10 for r in rows)


def simplified(rows, con):
    assert all(r["points"] >= 2 for r in rows)


CHECKS = {
    "X6_factor_loadings": loadings, "X7_oblique_rotation": oblique, "X8_factor_count_sweep": sweep, "X9_kmeans_sizes": cluster_sizes, "X11_eigenvalues": eigenvalues,
    "G1_points_per_hex": point_counts, "G2_line_length_per_hex": lengths, "G15_simplify": simplified, "H8_cell_boundary": boundaries,
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracles().get(name)
    if sql is None:
        CHECKS[name](df.collect(), con)
    else:
        assert same(df, con, sql) == ""


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())


def test_every_query_without_an_oracle_is_checked():
    assert set(CHECKS) == set(registry.queries()) - set(registry.oracles())


@pytest.mark.parametrize("name", ["D24_candidate_summary", "D5_group_acceptance", "D6_group_layer"])
def test_parts_without_distances_follow_the_sql(spark, tmp_path, name):
    """Part 2 has no line of any group, part 3 none of group A, part 4 none of N; part 5 touches A and blocks R."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT p_partkey::BIGINT AS p_partkey, 'STANDARD' AS p_type, 'Brand#11' AS p_brand, (20 + p_partkey)::INTEGER AS p_size, 900.0::DOUBLE AS p_retailprice FROM range(1, 6) t(p_partkey)")
    lines = "(1, 'A', 3, 0.05), (1, 'N', 9, 0.05), (1, 'R', 4, 0.05), (3, 'N', 9, 0.05), (3, 'R', 4, 0.05), (4, 'A', 3, 0.05), (4, 'R', 4, 0.05), (5, 'A', 5, 0.0), (5, 'N', 50, 0.05), (5, 'R', 1, 0.05)"
    con.execute(f"CREATE TABLE lineitem AS SELECT k::BIGINT AS l_partkey, g AS l_returnflag, q::DOUBLE AS l_quantity, x::DOUBLE AS l_discount FROM (VALUES {lines}) t(k, g, q, x)")
    for table in ("part", "lineitem"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    assert same(registry.queries()[name](spark, str(tmp_path)), con, registry.oracles()[name]) == ""
