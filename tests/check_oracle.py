"""Compare every registered query with its SQL in DuckDB, value by value.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        return f"f{value!r}"
    return f"s{value}"


def digest(names, rows) -> tuple[list[str], int, str, list[str]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    lines = sorted("|".join(cell(row[i]) for i in order) for row in rows)
    value = hashlib.md5("\n".join(lines).encode()).hexdigest()
    return [names[i] for i in order], len(lines), value, lines


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, build, sql: str | None) -> tuple[str, str]:
    frame = build(spark, sf_dir)
    ours = digest(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return ("rows" if ours[1] else "EMPTY"), f"{ours[1]} rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = digest(names, result.fetchall())
    if ours[0] != theirs[0]:
        return "COLUMNS", f"{sorted(set(ours[0]) ^ set(theirs[0]))}"
    if ours[1] != theirs[1]:
        return "COUNT", f"{ours[1]} against {theirs[1]}"
    if ours[2] != theirs[2]:
        left = [x for x in ours[3] if x not in set(theirs[3])][:2]
        right = [x for x in theirs[3] if x not in set(ours[3])][:2]
        return "VALUES", f"{ours[0]}\n  spark {left}\n  sql   {right}"
    return "ok", f"{ours[1]} rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tideline.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    found, sql = queries(), oracle_sql()
    bad = 0
    for name in args or found:
        started = time.time()
        try:
            status, note = compare(spark, con, sf_dir, found[name], sql.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            status, note = "FAILED", str(error)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:8s} {name:28s} {time.time() - started:6.1f}s  {note}", flush=True)
    print(f"{bad} problems in {len(args or found)} queries")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
