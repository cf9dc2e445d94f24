"""Run registered queries beside their SQL and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SPARK_SECONDS: dict[str, float] = {}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    """None if equal (or unchecked), else what differs."""
    began = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    SPARK_SECONDS[name] = time.time() - began
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if got != want:
        a, b = [r for r in got[:20000] if r not in set(want)], [r for r in want[:20000] if r not in set(got)]
        return f"{len(got)} rows != {len(want)} rows; only spark {len(a)}: {str(a[:2])[:300]}; only sql {len(b)}: {str(b[:2])[:300]}", len(got)
    return None, len(got)


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    from hushframe.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in args or qs:
        t = time.time()
        try:
            diff, n = compare(spark, con, sf_dir, name, qs[name], sqls.get(name))
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:500]}", -1
        bad += diff is not None
        state = "FAIL" if diff else ("ok" if name in sqls else "rows")
        print(f"{state:5}{name:32}{n:8} rows {SPARK_SECONDS.get(name, 0):6.1f}s spark {time.time() - t:6.1f}s all {diff or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
