"""Run queries and compare them with their SQL twins: python tests/check_queries.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from mailsift.session import build_session  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            got = fn(spark, folder).toPandas()
            spent = time.time() - t
            note = difference(got, con.execute(sqls[name]).df()) if name in sqls else None
            state = "OK " if name in sqls else "ROWS"
            if note:
                bad += 1
                state = "BAD"
            print(f"{state} {name} rows={len(got)} spark={spent:.1f}s sql={time.time() - t - spent:.1f}s {note or ''}", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
        spark.catalog.clearCache()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
