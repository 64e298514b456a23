"""Runs a named query on Spark and on DuckDB and compares all rows.

As a script: ``python tests/oracle.py FOLDER [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and all values agree."""
    cursor = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want_rows = cursor.fetchall()
    names = sorted(want_types)
    problems = []
    if sorted(df.columns) != names:
        return [f"columns differ: {sorted(set(df.columns) ^ set(names))}"]
    for field, kind in df.dtypes:
        if TYPES.get(kind, kind) != want_types[field]:
            problems.append(f"{field}: spark {kind}, duckdb {want_types[field]}")
    order = list(want_types)
    want = _sorted(tuple(r[order.index(n)] for n in names) for r in want_rows)
    got = _sorted(tuple(r[n] for n in names) for r in df.collect())
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)}, duckdb {len(want)}")
        return problems
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        problems.append(f"{len(bad)} of {len(got)} rows differ")
        g, w = bad[0]
        problems += [f"  {n}: spark {x!r}, duckdb {y!r}" for n, x, y in zip(names, g, w, strict=True) if x != y][:6]
    return problems


def main(folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from lapsekit.session import local_session

    spark, con = local_session(cores=8), duck(folder)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.monotonic()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = differences(df, con, oracles[name])
                note = "ok" if not problems else "DIFF " + "; ".join(problems)
            else:
                note = f"rows only: {len(df.collect())}"
        except Exception as error:
            note = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{name:26s} {time.monotonic() - start:6.2f}s  {note}", flush=True)
    print(f"missing oracles: {sorted(set(entry.queries()) - set(oracles))}")
    print(f"oracles without query: {sorted(set(oracles) - set(entry.queries()))}")
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
