"""Run registered queries against their SQL twins: ``python tests/oracle.py [--sf 0.01] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def compare(df, con, sql: str) -> str:
    """Empty text when equal, else a description of the first difference."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    bad = [f"{d[0]}:{d[1]}" for d in cur.description if any(t in str(d[1]).upper() for t in ("DECIMAL", "HUGEINT"))]
    if bad:
        return f"oracle types {bad}"
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    if os.environ.get("SHOW_TYPES"):
        short = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
        kinds = dict(df.dtypes)
        other = [f"{d[0]}: {kinds[d[0]]} vs {d[1]}" for d in cur.description if short.get(kinds[d[0]]) != str(d[1])]
        if other:
            print("   types", other)
    pos = [names.index(c) for c in cols]
    want = sorted(tuple(plain(row[i]) for i in pos) for row in cur.fetchall())
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}; e.g. spark {got[:1]} sql {want[:1]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        g, w = diff[0]
        return f"{len(diff)}/{len(got)} rows differ, columns {cols}\n   spark {g}\n   sql   {w}"
    if not got:
        return "no rows"
    return ""


def main(argv):
    import __spark_entry__ as entry
    from swarf.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session(shuffle_partitions=8, small_partitions=True), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    from swarf.queries.registry import MODULES

    names = [n for n in queries if not argv or any(n == a or f"{MODULES.get(n, '')}." == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = compare(df, con, sql[name]) if name in sql else ("" if df.count() else "no rows")
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
