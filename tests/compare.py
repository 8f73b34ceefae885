"""A query against its SQL twin, order aside."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def _plain(v):
    if v is None or str(v) in ("<NA>", "NaT") or isinstance(v, float) and math.isnan(v):
        return "null"
    if str(v) in ("True", "False"):
        return str(v)
    try:
        return repr(round(float(v), 8) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(df) -> Counter:
    return Counter(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def differences(got, want) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"only in Spark {list((a - b).items())[:3]}, only in SQL {list((b - a).items())[:3]}"
