"""Queries against their SQL on the small test tables."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection(folder: Path):
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def same(spark, folder: Path, query, sql: str) -> None:
    df = query(spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(*cols).collect())
    r = connection(folder).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want
