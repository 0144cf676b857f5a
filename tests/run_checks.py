"""python tests/run_checks.py [folder] [name-prefix ...]: compare catalogue queries with their SQL."""

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from compare import connect, differences  # noqa: E402

from __spark_entry__ import ALL_CHECKS as CHECKS  # noqa: E402
from __spark_entry__ import ALL_QUERIES as QUERIES  # noqa: E402
from tablekeep.session import build_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in CHECKS:
                problem, n = differences(spark, folder, run, CHECKS[name], con)
            else:
                problem, n = None, run(spark, folder).count()
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {time.time() - start:.2f}s {'' if name in CHECKS else '(rows only)'} {problem or ''}", flush=True)
    print("failures:", bad)
