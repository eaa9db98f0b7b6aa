"""Run queries against DuckDB on the same tables: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = canonical(got, df.columns), canonical(want, names)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return f"{len(a)} vs {len(b)} rows; only spark {only_a}; only sql {only_b}"


def main() -> None:
    import __spark_entry__ as e
    from quillfin.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = os.path.join("/root/testdata", f"sf{sf}")
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    if os.environ.get("HOT_ROWS"):
        spark.conf.set("spark.quillfin.hotKeyRows", os.environ["HOT_ROWS"])
    names = sys.argv[2:] or list(queries)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in oracles:
                diff = compare(spark, con, sf_dir, queries[n], oracles[n])
            else:
                diff = None
                print(f"   {n}: {len(queries[n](spark, sf_dir).collect())} rows, no sql")
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print(f"{bad} bad of {len(names)}")


if __name__ == "__main__":
    main()
