"""Run registered queries beside their oracle SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pairlens.plans.registry import TABLES  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, decimal.Decimal):
        return f"DECIMAL{value}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return str(value)


def compare(spark, con, query, folder: str) -> tuple[str, int, float]:
    """Status text, row count and Spark seconds."""
    start = time.time()
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if not query.sql:
        return "rows-only", len(rows), seconds
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}", len(rows), seconds
    kinds = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
        "boolean": "BOOLEAN", "float": "FLOAT",
    }
    for field in df.schema.fields:
        want, got = kinds.get(field.dataType.simpleString()), types[field.name]
        if want != got:
            return f"type of {field.name}: {field.dataType.simpleString()} vs {got}", len(rows), seconds
    order = sorted(names)
    mine = sorted(tuple(_cell(r[df.columns.index(n)]) for n in order) for r in rows)
    theirs = sorted(tuple(_cell(r[names.index(n)]) for n in order) for r in result.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}", len(rows), seconds
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {order}: {bad[0]}", len(rows), seconds
    return "ok", len(rows), seconds


def main(argv: list[str]) -> int:
    from pairlens.plans.catalog import REGISTRY
    from pairlens.session import local_session

    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(folder)
    names = [n for n in REGISTRY if not argv or any(a in n for a in argv)]
    bad = 0
    for name in names:
        try:
            status, rows, seconds = compare(spark, con, REGISTRY[name], folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, rows, seconds = "ERROR " + str(error)[:1500], 0, 0.0
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {rows:8d} rows {seconds:6.2f}s  {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
