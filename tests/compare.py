"""Compare a Spark result with DuckDB's by columns, kinds of type and values, in any row order."""

from __future__ import annotations

import glob
import os

import duckdb
from pyspark.sql import DataFrame

_KINDS = {
    "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT",
}


def duckdb_on(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(got: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want_rows = cursor.fetchall()
    columns = sorted(names)
    if sorted(got.columns) != columns:
        return [f"columns {sorted(got.columns)} != {columns}"]
    problems = [
        f"type of {name}: {kind} != {kinds[name]}" for name, kind in got.dtypes if _KINDS.get(kind, kind) != kinds[name]
    ]
    want = sorted((tuple(row[names.index(c)] for c in columns) for row in want_rows), key=repr)
    have = sorted((tuple(row[c] for c in columns) for row in got.collect()), key=repr)
    if len(want) != len(have):
        problems.append(f"rows {len(have)} != {len(want)}")
    odd = [(h, w) for h, w in zip(have, want) if h != w]
    if odd:
        problems.append(f"{len(odd)} rows differ, first: {odd[0][0]} != {odd[0][1]}")
    return problems
