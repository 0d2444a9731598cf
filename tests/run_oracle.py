"""CLI: python tests/run_oracle.py [sf_dir] [name ...] -> one line per query."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from passkit.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    load_all()
    names = args or sorted(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            got = QUERIES[n](spark, sf).toPandas()
            if n in ORACLE:
                want = con.execute(ORACLE[n]).df()
                diff = compare(got, want)
            else:
                diff = None
            status = "OK " if diff is None else "BAD"
            bad += diff is not None
            print(f"{status} {n:32s} rows={len(got):6d} {'D' if n in ORACLE else 'R'} {time.time()-t:5.1f}s"
                  + ("" if diff is None else "\n    " + diff), flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:800]}", flush=True)
            traceback.print_exc(limit=2)
    print(f"{len(names) - bad}/{len(names)} ok")
