"""Compare a query's Spark result with its SQL result in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=key)


SPARK_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in result.description}
    theirs = _rows(list(kinds), result.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(df.columns) != sorted(kinds):
        return [f"columns {sorted(df.columns)} != {sorted(kinds)}"]
    for name, kind in df.dtypes:
        if SPARK_KIND.get(kind) != kinds[name]:
            found.append(f"{name}: {kind} != {kinds[name]}")
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows != {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first {sorted(df.columns)}\n  {bad[0][0]}\n  {bad[0][1]}")
    return found
