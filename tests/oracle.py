"""Spark-vs-DuckDB comparison in the manner of the driver's correctness gate."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str, sql: str) -> pa.Table:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).to_arrow_table()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in row)


def rows(table: pa.Table, names: list[str]) -> list[tuple]:
    cols = [table.column(n).to_pylist() for n in names]
    out = [tuple(_norm(c[i]) for c in cols) for i in range(table.num_rows)]
    out.sort(key=_key)
    return out


def _close(a, b, rel=1e-9):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= rel * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, rel) for x, y in zip(a, b))
    return a == b


def compare(spark_tbl: pa.Table, duck_tbl: pa.Table) -> dict:
    s_names, d_names = sorted(spark_tbl.column_names), sorted(duck_tbl.column_names)
    res = {"rows_spark": spark_tbl.num_rows, "rows_oracle": duck_tbl.num_rows, "names": s_names == d_names}
    if s_names != d_names:
        res["detail"] = f"columns {s_names} vs {d_names}"
        res["exact"] = res["close"] = False
        return res
    res["types"] = {
        n: (str(spark_tbl.schema.field(n).type), str(duck_tbl.schema.field(n).type))
        for n in s_names
        if str(spark_tbl.schema.field(n).type) != str(duck_tbl.schema.field(n).type)
    }
    a, b = rows(spark_tbl, s_names), rows(duck_tbl, s_names)
    res["exact"] = a == b
    res["close"] = len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if not res["close"]:
        bad = [(x, y) for x, y in zip(a, b) if not _close(x, y)][:3]
        res["detail"] = f"first differences: {bad}"
    elif not res["exact"]:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        res["detail"] = f"{len(bad)} rows differ in the last bits, e.g. {bad[:1]}"
    return res
