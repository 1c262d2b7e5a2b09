"""Spark results against SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    rel = con.sql(sql)
    return _sorted(rel.columns, rel.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def _sorted(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def differences(a: list[tuple], b: list[tuple]) -> list:
    """Pairs of rows that differ in more than the last digits of a float."""
    near = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
    if len(a) != len(b):
        return [("rows", len(a), len(b)), *[(x,) for x in list(set(a) ^ set(b))[:4]]]
    return [(x, y) for x, y in zip(a, b, strict=True) if not all(map(near, x, y))]
