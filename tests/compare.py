"""Run a named query on Spark and its check on DuckDB over the same files, and compare all values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else round(float(v), 9)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) if abs(v) < 1e15 else False:
            return int(v)
        return float(f"{v:.12g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def table(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def type_class(name: str) -> str:
    n = name.lower()
    if any(x in n for x in ("[]", "array")):
        return "array"
    if n.startswith("struct"):
        return "struct"
    if any(x in n for x in ("int", "long")):
        return "int"
    if n.startswith("decimal"):
        return "decimal"
    if any(x in n for x in ("double", "float")):
        return "float"
    if "timestamp" in n:
        return "timestamp"
    return {"varchar": "string"}.get(n, n)


def compare(spark, con, name, queries, checks, folder):
    start = time.time()
    df = queries[name](spark, folder)
    rows = df.collect()
    took = time.time() - start
    if name not in checks:
        return took, len(rows), None
    res = con.execute(checks[name])
    dcols = [c[0] for c in res.description]
    dtypes = {c[0]: str(c[1]) for c in res.description}
    drows = res.fetchall()
    problems = []
    if sorted(df.columns) != sorted(dcols):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(dcols)}")
    else:
        types = dict(df.dtypes)
        odd = {c: (types[c], dtypes[c]) for c in df.columns if type_class(types[c]) != type_class(dtypes[c])}
        if odd and {k for k, v in odd.items() if "void" not in v}:
            problems.append(f"types {odd}")
        a, b = table(rows, df.columns), table(drows, dcols)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            problems.append(f"{len(diff)} differing rows, e.g. {diff[:2]}")
    return took, len(rows), problems


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from wattline.session import build_session

    sf = os.environ.get("SF", "0.01")
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, checks = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            took, n, problems = compare(spark, con, name, queries, checks, folder)
        except Exception as e:  # noqa: BLE001
            took, n, problems = 0, 0, [f"{type(e).__name__}: {str(e)[:1500]}"]
        flag = "rows-only" if problems is None else ("ok" if not problems else "BAD")
        bad += flag == "BAD"
        if flag != "ok" or len(sys.argv) > 1:
            print(f"{flag:9s} {name} {n} rows {took:.2f}s", *(problems or []), flush=True)
        elif took > 4:
            print(f"slow {name} {took:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
