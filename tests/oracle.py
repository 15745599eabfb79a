"""Compare a registered query with its SQL equivalent run by DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from tallywarden.schemas import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """Equal values in both engines become equal here; types stay apart."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("double", value + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def differences(df, con, sql: str) -> str | None:
    """None if both give the same rows as multisets, else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(n) for n in order]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*order).collect())
    if ours == theirs:
        return None if ours else "no rows on either side"
    extra, missing = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {list(extra)[:3]}; only theirs {list(missing)[:3]}"
    )
