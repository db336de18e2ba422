"""Run registered queries beside their SQL: python tests/check_queries.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    want_cols, want = rows_of(names, cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return False, f"columns {got_cols} vs {want_cols}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", len(got)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{len(bad)} rows differ; first spark={bad[0][0]} sql={bad[0][1]}", len(got)
    kind_of = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
               "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in df.dtypes if kind_of.get(t, t) != kinds[n]]
    return True, ("types " + ", ".join(odd)) if odd else "", len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from basketry.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                         "spark.driver.memory": "16g"})
    con = connect(sf_dir)
    checks, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                ok, note, n = compare(df, con, checks[name])
            else:
                n = len(df.collect())
                ok, note = True, "rows only"
        except Exception as exc:  # noqa: BLE001
            ok, note, n = False, f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
