"""Compare queries with their SQL, as the driver does: sorted columns, rows as multisets."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("SARRAF_TESTDATA", "/root/testdata"))


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in folder.glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return float(value)
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of_frame(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def differences(spark, name: str, folder: Path, queries: dict, sql: dict) -> str:
    """Empty if the query and its SQL agree over `folder`."""
    names, ours = rows_of_frame(queries[name](spark, str(folder)))
    their_names, theirs = rows_of_sql(connect(folder), sql[name])
    if names != their_names:
        return f"{name}: columns {names} and {their_names}"
    if ours != theirs:
        more, less = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows; only here {more}; only in SQL {less}"
    return ""
