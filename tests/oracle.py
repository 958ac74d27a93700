"""Comparison of a query's rows with those of DuckDB on the same tables, as multisets of rounded values."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def shown(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(shown, value))
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def same_rows(df: DataFrame, sql: str, sf_dir: str) -> None:
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = Counter(tuple(shown(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    ours = Counter(tuple(shown(r[c]) for c in order) for r in df.collect())
    assert sum(ours.values()) == sum(theirs.values())
    assert not ours - theirs, list((ours - theirs).items())[:3] + list((theirs - ours).items())[:3]
