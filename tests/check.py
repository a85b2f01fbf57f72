"""Command line: compare queries with their SQL. ``python tests/check.py SF_DIR [name-prefix ...]``"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from episcope.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        sql, start = entry.oracle_sql().get(name), time.time()
        try:
            df = fn(spark, sf)
            result = compare(con, sql, df) if sql else f"ROWS {df.count()}"
        except Exception as e:  # noqa: BLE001
            result = "ERROR " + ("".join(traceback.format_exception_only(e)))[:1500]
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        bad = result is not None and not result.startswith("ROWS")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name:28s} {time.time() - start:6.2f}s {result or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
