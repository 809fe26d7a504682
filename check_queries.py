"""Compares every registered query with its SQL on the same tables.

usage: check_queries.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from shelfspark.plans import all_oracles, all_queries
from shelfspark.session import local_session


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"f{v:.6f}"
        return f"{type(v).__name__}:{v}"

    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in args if not a.startswith("/")]
    spark = local_session()
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    bad, oracles = [], all_oracles()
    for name, query in all_queries().items():
        if wanted and not any(w in name or query.__module__.endswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:900]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name} {len(got)} ({took:.1f}s)", flush=True)
            continue
        try:
            cursor = con.execute(oracles[name])
            names = [d[0] for d in cursor.description]
            want = cursor.fetchall()
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"SQL  {name}: {str(error)[:900]}", flush=True)
            continue
        if sorted(names) != sorted(df.columns):
            bad.append(name)
            print(f"COLS {name}: {sorted(df.columns)} vs {sorted(names)}", flush=True)
            continue
        a, b = canonical(got, df.columns), canonical(want, names)
        if a == b:
            print(f"ok   {name} {len(got)} ({took:.1f}s)", flush=True)
        else:
            bad.append(name)
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows, columns {sorted(names)}")
            for x in list((a - b).items())[:4]:
                print("   spark", x)
            for x in list((b - a).items())[:4]:
                print("   sql  ", x, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
