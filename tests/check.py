"""Run registered queries next to their SQL and compare the results.

``python tests/check.py [pattern ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, function, sql):
    """None when equal, otherwise what differs."""
    frame = function(spark, sf_dir)
    left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if left else "no rows"
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    right = rows_of(columns, answer.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    bad_types = {
        c: t for c, t in types.items() if t in ("HUGEINT",) or t.startswith(("DECIMAL", "INTERVAL", "UHUGEINT"))
    }
    if bad_types:
        return f"oracle types {bad_types}"
    if not left:
        return "no rows"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:2]
        only_right = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} rows vs {len(right)}; spark {str(only_left)[:700]} | duckdb {str(only_right)[:700]}"
    return None


def main(patterns):
    import __spark_entry__ as entry
    from parlance.session import get_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if patterns and not any(re.search(p, name) for p in patterns):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, function, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
