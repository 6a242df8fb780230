"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def database(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "float64", "int32"):
        f = float(v)
        return None if math.isnan(f) else f
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(spark, query, sql: str, con, sf_dir: str = SF) -> list[str]:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want = rows_of(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return [f"columns {sorted(df.columns)} against {sorted(found.columns)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}", *(f"only ours {x}" for x in [g for g in got if g not in want][:3] if len(want) < 20000), *(f"only SQL {x}" for x in [w for w in want if w not in got][:3] if len(got) < 20000)]
    return [f"{g} against {w}" for g, w in zip(got, want, strict=True) if g != w][:5]
