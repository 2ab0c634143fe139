"""Run registered queries in Spark and their SQL in DuckDB and compare rows, column names, types and values.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def kind(dtype: str) -> str:
    dtype = dtype.upper()
    return {"INT": "INTEGER", "BIGINT": "BIGINT", "STRING": "VARCHAR"}.get(dtype, dtype)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return a == b or abs(float(a) - float(b)) <= 1e-9 * max(1.0, abs(float(a))) or (a != a and b != b)
    return a == b


def compare(frame, con, statement: str) -> str | None:
    """None when equal, else what differs."""
    names = sorted(frame.columns)
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in frame.schema.fields}
    result = con.execute(statement)
    duck_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(duck_types) != names:
        return f"columns {names} / {sorted(duck_types)}"
    order = [d[0] for d in result.description]
    duck = [tuple(row[order.index(n)] for n in names) for row in result.fetchall()]
    spark = [tuple(r) for r in frame.select(*names).collect()]
    key = lambda row: tuple((v is not None, str(type(v)) if v is None else "", v if v is not None else 0) for v in row)
    if len(spark) != len(duck):
        return f"rows {len(spark)} / {len(duck)}"
    bad = [(a, b) for a, b in zip(sorted(spark, key=key), sorted(duck, key=key)) if not all(map(same, a, b))]
    if bad:
        return f"{len(bad)} of {len(spark)} rows differ ({names}), first {bad[0]}"
    exact = sum(a != b for a, b in zip(sorted(spark, key=key), sorted(duck, key=key)))
    types = {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]}
    notes = []
    if types:
        notes.append(f"types {types}")
    if exact:
        notes.append(f"{exact} rows equal only within tolerance")
    return "; ".join(notes) or None


def main() -> int:
    from ionloom.plans import catalog
    from ionloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failures = 0
    for name in names:
        started = time.time()
        try:
            frame = catalog.QUERIES[name](spark, sf_dir)
            if name in catalog.ORACLES:
                verdict = compare(frame, con, catalog.ORACLES[name])
                note = "ok" if verdict is None else verdict
            else:
                verdict, note = None, f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = note = f"{type(error).__name__}: {str(error)[:700]}"
        failures += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {failures} failures")
    spark.stop()
    return failures


if __name__ == "__main__":
    raise SystemExit(main())
