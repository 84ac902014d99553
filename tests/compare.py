"""A query's rows against those of its SQL form in DuckDB. `python -m tests.compare SF_DIR [NAME...]` compares the registered ones."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import tempfile
import threading
import time

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """The tables as views. A form that needs more than a few GB of temporary files fails here, and doesn't fill the disk."""
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="spark-duck-"), "max_temp_directory_size": "4GB", "memory_limit": "6GB"})
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.UTC).replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def rows(table) -> list[tuple]:
    """Rows with their columns in order of name, sorted; doubles sort by six digits."""
    table = table.select(sorted(table.column_names))
    out = [tuple(map(plain, r)) for r in zip(*(c.to_pylist() for c in table.columns))]
    return sorted(out, key=lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else repr(v) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def difference(result, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What tells the DataFrame's rows from the SQL's; empty if nothing does."""
    got, want = result.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)}, {sorted(want.column_names)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)}"
    return next((f"{x} for {y}" for x, y in zip(a, b, strict=True) if not same(x, y)), "")


def main(sf_dir: str, *names: str) -> int:
    import __spark_entry__ as entry
    from almanac.session import session

    spark = session("compare", spark_master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, forms, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        con, began = connection(sf_dir), time.time()
        stop = threading.Timer(60, con.interrupt)
        stop.start()
        try:
            if name in forms:
                said = difference(queries[name](spark, sf_dir), forms[name], con) or "same"
            else:
                said = f"no SQL form; {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"failed: {str(e)[:500]}"
        bad += said not in ("same",) and not said.startswith("no SQL")
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
        stop.cancel()
        con.close()
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
