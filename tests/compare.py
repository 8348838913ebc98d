"""Compare a DataFrame with the result of SQL, order aside."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def sql_rows(folder, sql):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def assert_same(df, folder, sql):
    names, rows = sql_rows(folder, sql)
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, rows)
    assert len(mine) == len(theirs)
    assert mine == theirs
