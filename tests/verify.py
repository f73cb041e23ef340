"""Compare registered queries with their SQL: python tests/verify.py DIR [NAME...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings geo_series concepts triples omim_responses bioc_docs w2v_cache pack_sizes".split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


def compare(spark, con, name, query, sql, data):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return len(got), None, "rows only"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return len(got), False, f"columns {cols} != {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted("|".join(norm(r[i]) for i in at) for r in rel.fetchall())
    bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return len(got), got == want, "" if got == want else f"{len(got)} vs {len(want)} rows: {bad}"


def connect(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e
    from annotara.session import get_session

    data, names = sys.argv[1], sys.argv[2:]
    spark, con = get_session(cores="8"), connect(data)
    spark.sparkContext.setLogLevel("ERROR")
    q, s = e.queries(), e.oracle_sql()
    bad = 0
    for n in [x for x in q if not names or any(x.startswith(p) for p in names)]:
        t = time.time()
        try:
            rows, ok, why = compare(spark, con, n, q[n], s.get(n), data)
        except Exception as x:  # noqa: BLE001
            rows, ok, why = -1, False, str(x)[:600]
        bad += ok is False
        print(f"{n:34s} {rows:8d} {ok} {time.time() - t:6.1f}s {why}", flush=True)
    print("failed:", bad)
