"""Comparison of a query with its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def _shown(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(_shown, v)) + "]"
    if v is None or v is pd.NA:
        return "nan"  # as a null is in a column of whole numbers that has become one of doubles
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool) and abs(v) < 1 << 53:
        v = float(v)
    if isinstance(v, (float, np.floating)):
        return "nan" if np.isnan(v) else f"{v + 0.0:.0f}" if v == np.floor(v) and abs(v) < 1e15 else f"{v + 0.0:.9g}"
    return str(v)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(tuple(_shown(x) for x in r) for r in frame[names].itertuples(index=False, name=None))


def same(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
