"""Compares a query's rows with those of its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql):
    """What differs, in a few words; empty if nothing does."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(odd)} of {len(ours)} rows, such as {odd[0]}" if odd else ""
