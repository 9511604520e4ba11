"""Runs queries and their SQL side by side: python tests/tests_compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    """One form for a value of either engine."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, f, sql: str) -> tuple[str | None, int]:
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}", len(got)
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"{len(got)} rows and {len(want)}; first differences {odd}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        start = time.time()
        try:
            if name in oracles:
                why, n = difference(spark, con, sf, queries[name], oracles[name])
            else:
                why, n = "no SQL", queries[name](spark, sf).count()
        except Exception as e:  # noqa: BLE001  a report, not a test
            why, n = f"{type(e).__name__}: {str(e)[:400]}", -1
        print(f"{name}: {'equal' if why is None else why} ({n} rows, {time.time() - start:.1f} s)", flush=True)
