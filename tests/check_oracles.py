"""Run every query beside its SQL in DuckDB and compare. Usage: check_oracles.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from tallyspark.session import local_session  # noqa: E402
from tests_support import compare, connect  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if not problem else "DIFFERS " + problem
            else:
                state = f"rows {len(df.collect())}"
        except Exception as error:  # report every query
            state = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        failed += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:32s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{failed} problems")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
