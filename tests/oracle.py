"""Runs a query and its SQL on the same tables and compares them as bags of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "quantize"):
        return float(f"{float(v):.9g}")
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """Empty if both give the same columns and rows; else what differs."""
    names, got = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    wanted_names, wanted = bag([c[0] for c in cur.description], cur.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if got != wanted:
        return f"rows {sum(got.values())} and {sum(wanted.values())}; only here {list((got - wanted).items())[:3]}; only in SQL {list((wanted - got).items())[:3]}"
    return ""
