"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    return "NULL" if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty text when names and values agree, else the first difference."""
    got = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}; extra {list(set(got[1]) - set(want[1]))[:2]} missing {list(set(want[1]) - set(got[1]))[:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"row {a} != {b} ({sum(x != y for x, y in zip(*[got[1], want[1]]))} rows)"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tillwise.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("8", 8, "8g"), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(queries[name](spark, sf), con, oracle[name])
            else:
                problem = "" if queries[name](spark, sf).count() >= 0 else "no rows"
        except Exception as err:  # noqa: BLE001
            problem = f"{type(err).__name__}: {str(err)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracle else '(rows only) '}{problem}", flush=True)
    print("failures:", bad)
