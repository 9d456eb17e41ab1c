"""Compare a query with its SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def views(con, folder: str) -> None:
    for p in Path(folder).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create or replace view {p.stem} as select * from read_parquet('{src}')")


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canonical(x)) for k, x in v.items()))
    return v


def compare(df, sql: str, con) -> str:
    """Empty if equal, else what differs."""
    names = sorted(df.columns)
    got = Counter(tuple(canonical(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(canonical(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:4]}; only in SQL {list((want - got).items())[:4]}"
