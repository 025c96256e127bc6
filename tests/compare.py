"""Holds queries against their SQL on the same tables, as unordered rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, db, query, sql: str, sf_dir: str) -> str:
    """Empty if both have equal columns and rows, else a few words on where they differ."""
    got = query(spark, sf_dir)
    want = db.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    if not b:
        return "no rows"
    if a == b:
        return ""
    for x, y in zip(a, b, strict=False):
        if x != y:
            return f"{len(a)} and {len(b)} rows; {x} and {y}"
    return f"{len(a)} and {len(b)} rows"
