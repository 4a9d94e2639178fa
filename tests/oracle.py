"""Compare a Spark result with a DuckDB result of the same tables, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return plain(float(v)) if v % 1 else int(v)
    if isinstance(v, bool) or isinstance(v, (int, str)) or v is None:
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def same(df, con, sql: str) -> str:
    """Empty if the frame holds what the SQL gives; else what differs."""
    cur = con.execute(sql)
    want, want_names = rows_of(cur.fetchall(), [c[0] for c in cur.description])
    got, got_names = rows_of([tuple(r) for r in df.collect()], df.columns)
    if got_names != want_names:
        return f"columns {got_names} not {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows not {len(want)}"
    for g, w in zip(got, want):
        if g != w and not all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)) for x, y in zip(g, w)):
            return f"{g} not {w}"
    return ""
