"""Compare chosen queries (all by default) and print findings: run_compare.py [folder] [name ...]."""

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from compare import connect, differences  # noqa: E402

from tidemark.session import local_session  # noqa: E402
from tidemark.workload import ORACLE, QUERIES  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(QUERIES)
spark = local_session(8, "12g")
con = connect(folder)
bad = 0
for n in names:
    t0 = time.time()
    try:
        df = QUERIES[n](spark, folder)
        if n in ORACLE:
            diff = differences(df, con, ORACLE[n])
        else:
            rows = df.count()
            diff = [] if rows else ["no rows"]
            print(f"     {n}: rows only, {rows} rows")
        if diff:
            bad += 1
            print(f"FAIL {n}: {diff}")
    except Exception as e:  # noqa: BLE001
        bad += 1
        text = str(e).split("\n")[0][:400]
        print(f"ERR  {n}: {type(e).__name__} {text}")
        if "-v" in sys.argv:
            traceback.print_exc()
    dt = time.time() - t0
    if dt > 4:
        print(f"     {n} took {dt:.1f}s")
print(f"{len(names)} queries, {bad} bad")
