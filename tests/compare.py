"""A query against its SQL on the smallest test tables, as sets of rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def canon(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, dict):
        return str({k: canon(x) for k, x in sorted(v.items())})
    return str([canon(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def assert_same(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, SF)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(canon(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(canon(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want
