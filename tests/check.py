"""Command line: compare named queries with their SQL twins.  ``python -m tests.check [sf] [name …]``"""

from __future__ import annotations

import sys
import time
import traceback

from foliolake import plans
from foliolake.session import local_session

from .oracle import compare, connect


def main() -> None:
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    modules = [a[2:] for a in sys.argv[2:] if a.startswith("m:")]
    if modules:
        plans.MODULES[:] = modules
    wanted = [a for a in sys.argv[2:] if not a.startswith("m:")]
    spark, con = local_session("check"), connect(sf)
    queries, oracle = plans.queries(), plans.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                n = ""
            else:
                n = df.count()
                problem = None
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", ""
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.2f}s {n} {problem or ''}"[:1500], flush=True)
    print("failures:", bad)


main()
