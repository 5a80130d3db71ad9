"""Run registered queries next to their oracle SQL and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    cursor = con.execute(sql)
    columns = [(d[0], TYPES.get(str(d[1]), str(d[1]))) for d in cursor.description]
    return columns, cursor.fetchall()


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    columns, expected = oracle_rows(sql, sf_dir)
    if sorted(df.dtypes) != sorted(columns):
        return f"schema {sorted(set(df.dtypes) - set(columns))} vs {sorted(set(columns) - set(df.dtypes))}"
    names = sorted(n for n, _ in columns)
    at = [[n for n, _ in columns].index(n) for n in names]
    left = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    right = sorted((tuple(r[i] for i in at) for r in expected), key=_key)
    if len(left) != len(right):
        extra = [r for r in left if r not in right][:2], [r for r in right if r not in left][:2]
        return f"{len(left)} rows vs {len(right)}: {extra}"
    for a, b in zip(left, right):
        if a != b:
            return f"{names}\n  spark  {a}\n  oracle {b}"
    return None


def main() -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry

    from pageloom.session import build_session

    # arguments: folder, then parts of query names and key=value session settings
    sf_dir, rest = sys.argv[1], sys.argv[2:]
    wanted = [a for a in rest if "=" not in a]
    extra = dict(a.split("=", 1) for a in rest if "=" in a)
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", **extra},
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                result = difference(df, oracles[name], sf_dir)
            else:
                result = f"no oracle, {df.count()} rows"
        except Exception as err:  # noqa: BLE001
            result = f"error {type(err).__name__}: {str(err)[:1500]}"
        print(f"{name}: {'ok' if result is None else result} ({time.time() - started:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
