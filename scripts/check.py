"""Run registered queries against their DuckDB oracle.

    python scripts/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from keepsake.compare import compare, oracle  # noqa: E402
from keepsake.plans import REGISTRY, Tables  # noqa: E402
from keepsake.session import local_session  # noqa: E402


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--module")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark = local_session(8)
    duck = oracle(opt.sf)
    tables = Tables(spark, opt.sf)
    names = opt.names or [n for n, p in REGISTRY.items()
                          if not opt.module or p.build.__module__.endswith(opt.module)]
    bad = 0
    for name in names:
        p = REGISTRY[name]
        t0 = time.perf_counter()
        try:
            df = p.build(tables)
            rows = df.collect()
            t1 = time.perf_counter()
            if p.sql is None:
                problem, note = None, f"{len(rows)} rows, no oracle"
            else:
                problem = compare(df.schema, rows, duck.execute(p.sql))
                note = f"{len(rows)} rows"
            if not rows and problem is None:
                note += "  EMPTY"
            took = f"{t1 - t0:.2f}s + {time.perf_counter() - t1:.2f}s"
        except Exception as e:  # noqa: BLE001
            problem, note, took = f"{type(e).__name__}: {str(e)[:900]}", "", ""
        bad += problem is not None
        print(("ok  " if problem is None else "BAD ") + f"{name}: {note} {took}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
