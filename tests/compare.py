"""Run registered queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tidewatch.plans.adapters import BASE_TABLES  # noqa: E402


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value


def _key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n", v if v is not None else 0) for v in row)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def kind(text: str) -> str:
    text = text.lower()
    for name, words in {
        "int": ("int", "long", "short"), "float": ("double", "float", "decimal"), "bool": ("bool",),
        "str": ("string", "varchar"), "time": ("timestamp",), "date": ("date",),
    }.items():
        if any(w in text for w in words):
            return name
    return text


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def same(a, b, tolerance):
    """Rows agree; with a tolerance, results rounded to 4 decimals may differ in the last one.

    The engines round ties differently: 57.56875 becomes 57.5687 or 57.5688.
    """
    if a == b:
        return True
    return all(
        x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=0, abs_tol=tolerance))
        for x, y in zip(a, b)
    )


def compare(spark, con, folder, plan, sql, tolerance=0.0):
    """None if both sides agree, else a description of the difference."""
    df = plan(spark, folder)
    left = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if left[1] else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: kind(str(d[1])) for d in cursor.description}
    right = table(names, cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema.fields if kind(f.dataType.simpleString()) != types[f.name]}
    if wrong:
        return f"types {wrong}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}; {left[1][:2]} / {right[1][:2]}"
    for a, b in zip(left[1], right[1]):
        if not same(a, b, tolerance):
            return f"{left[0]}: {a} against {b}"
    return None if left[1] else "empty on both sides"


if __name__ == "__main__":
    from tidewatch.plans import load_all
    from tidewatch.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load_all()
    con = connect(folder)
    bad = 0
    for name, plan in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, plan, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(no sql) '}{problem or ''}", flush=True)
    print("failed:", bad)
