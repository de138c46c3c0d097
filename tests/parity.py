"""Compare registered queries with their SQL on one folder of tables.

    python -m tests.parity [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


# Types that count as the same column type in both engines.
_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and a SQL statement; empty when they agree."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: _TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    problems = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    for name, kind in df.dtypes:
        if kind != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(columns, cursor.fetchall())
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        problems.append(
            f"rows {ours.total()} != {theirs.total()}; "
            f"{only_ours.total()} only in Spark, e.g. {list(only_ours)[:2]}; "
            f"{only_theirs.total()} only in SQL, e.g. {list(only_theirs)[:2]}"
        )
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as registry
    from tests.session import session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = registry.queries(), registry.oracle_sql()
    spark, con = session(), connect(folder)
    failed = 0
    for name in argv[1:] or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            problems = compare(df, con, oracles[name]) if name in oracles else ["no SQL"]
            n = df.count() if not problems else "-"
        except Exception as e:  # report and go on with the next query
            problems, n = [f"{type(e).__name__}: {str(e)[:600]}"], "-"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {time.time() - started:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:1500])
    print(f"{failed} of {len(argv[1:] or queries)} disagree; no SQL for {sorted(set(queries) - set(oracles))}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
