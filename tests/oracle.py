"""Spark query against DuckDB SQL over the same files."""

import os


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[str]]:
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([_plain(row[i]) for i in order]) for row in r.fetchall())


def _plain(v):
    return round(float(v), 9) if isinstance(v, float) else v


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr([_plain(v) for v in row]) for row in df.select(*names).collect())
