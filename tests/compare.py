"""Run a registered query and its SQL over the same tables and compare all rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value) if value is not None else None


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark, con, name, run, sql, sf_dir) -> str | None:
    """None when equal, otherwise what differs."""
    df = run(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    theirs_columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} vs {sorted(theirs_columns)}"
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "binary": "BLOB",
    }
    theirs_types = {c[0]: str(c[1]) for c in result.description}
    other = [
        f"{n}: {t} vs {theirs_types[n]}"
        for n, t in df.dtypes
        if kinds.get(t, t) != theirs_types[n]
    ]
    if other:
        return f"types {other}"
    a, b = canonical(ours, df.columns), canonical(theirs, theirs_columns)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2] if len(a) < 50_000 else []
        lack = [x for x in b if x not in set(a)][:2] if len(b) < 50_000 else []
        return f"{len(a)} rows vs {len(b)}; only ours {extra}; only theirs {lack}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, e.g. {wrong[0]}"
    if not a:
        return "no rows"
    return None


def main() -> int:
    import __spark_entry__ as entry_point
    from gaugeworks.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
