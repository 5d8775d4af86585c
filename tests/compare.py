"""Run registered queries beside their SQL and compare rows, names and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "array<string>": "VARCHAR[]"}


def compare(spark, con, build, sql: str, folder: str) -> list[str]:
    """Differences found; an empty list means equal."""
    df = build(spark, folder)
    names = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in names) for r in df.collect()]
    result = con.execute(sql)
    order = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    rows = [dict(zip(order, r)) for r in result.fetchall()]
    problems = []
    if sorted(order) != names:
        return [f"columns {names} against {sorted(order)}"]
    for c, k in df.dtypes:
        if KINDS.get(k, k) != kinds[c]:
            problems.append(f"type of {c}: {k} against {kinds[c]}")
    want = [tuple(norm(r[c]) for c in names) for r in rows]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} against {len(want)}")
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    if a != b:
        only_a = list(set(map(repr, a)) - set(map(repr, b)))[:2]
        only_b = list(set(map(repr, b)) - set(map(repr, a)))[:2]
        problems.append(f"values {names}\n   ours {only_a}\n   sql  {only_b}"[:1500])
    return problems


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import importlib

    from plaintscope import build_session, catalog

    folder = sys.argv[1]
    for m in (sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] != "all" else []):
        importlib.import_module(f"plaintscope.catalog.{m}")
    if len(sys.argv) < 3 or sys.argv[2] == "all":
        catalog.load_all()
    only = sys.argv[3].split(",") if len(sys.argv) > 3 else None
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, build in catalog.QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in catalog.ORACLES:
                problems = compare(spark, con, build, catalog.ORACLES[name], folder)
            else:
                problems = []
                print(f"     {name}: {build(spark, folder).count()} rows, no SQL")
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        took = time.time() - start
        bad += bool(problems)
        print(("ok  " if not problems else "BAD "), name, f"{took:.1f}s", *problems, sep=" ", flush=True)
    print("bad:", bad)
