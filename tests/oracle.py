"""Compare a query with its SQL in DuckDB on the driver's tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as con:
        for t in TABLES:
            if Path(sf_dir, f"{t}.parquet").exists():
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        con.execute(sql)
        names = [d[0] for d in con.description]
        rows = con.fetchall()
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def rows_of_frame(df) -> tuple[list[str], Counter]:
    order = sorted(df.columns)
    return order, Counter(tuple(plain(r[c]) for c in order) for r in df.collect())


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    a, b = rows_of_frame(df), rows_of_sql(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"only in Spark: {list((a[1] - b[1]).items())[:3]} ({sum((a[1] - b[1]).values())}); only in SQL: {list((b[1] - a[1]).items())[:3]} ({sum((b[1] - a[1]).values())}); {sum(a[1].values())} rows"
    return ""
