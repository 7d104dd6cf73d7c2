"""Command line check: ``python tests/check.py [sf] [pattern ...]``; ``HOT=1`` forces the chunked forms."""

import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from stripweave.session import local_session
from tests.harness import compare, duck

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pats = sys.argv[2:] or ["."]
    d = f"/root/testdata/sf{sf}"
    spark = local_session()
    if os.environ.get("HOT"):
        spark.conf.set("spark.stripweave.groupRows", "2")
        spark.conf.set("spark.stripweave.chunkRows", os.environ["HOT"])
    con = duck(d)
    texts = entry.oracle_sql()
    bad = []
    for name, q in entry.queries().items():
        if not any(re.search(p, name) for p in pats):
            continue
        t = time.time()
        try:
            if name in texts:
                n = compare(q(spark, d), con, texts[name])
                print(f"ok   {name:32s} {n:8d} rows {time.time() - t:6.2f}s", flush=True)
            else:
                n = q(spark, d).count()
                print(f"rows {name:32s} {n:8d} rows {time.time() - t:6.2f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            text = str(exc) if isinstance(exc, AssertionError) else "".join(traceback.format_exception_only(exc))
            print(f"FAIL {name:32s} {text[:700]}", flush=True)
    print("failed:", bad)
