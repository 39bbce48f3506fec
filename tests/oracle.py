"""Compare a query with its SQL on the same parquet files."""

from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0 or 0.0
    return float(v) if hasattr(v, "as_tuple") else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(_plain(x) for x in r)) for r in df.select(*columns).collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(repr(tuple(_plain(r[i]) for i in order)) for r in found.fetchall())
