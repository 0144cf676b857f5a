"""Time the headline queries on the given data and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma separated
names, or "all").
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from tablekeep.plans import QUERIES  # noqa: E402
from tablekeep.session import build_session  # noqa: E402

HEADLINE = [
    "c02_conform",
    "c07_assign_gid",
    "c01_standard_layouts",
    "c06_check_layout",
    "n11_check_tables",
    "n14_check_history_names",
    "k04_check_unique",
    "k05_check_foreign_key",
    "h03_history_from_snapshots",
    "h04_history_from_changes",
    "h05_apply_changes",
    "h09_restore_deleted",
    "h11_history_schema_diff",
    "g03_repeated_points",
    "g05_ring_self_intersections",
    "g07_hole_and_part_checks",
    "g08_explain_geometry",
    "g01_explode_wkt_vertices",
    "g13_drop_placeholders_rows",
    "m01_pending_from_log",
    "m05_missing_row_rules",
    "r02_role_drift",
    "r07_effective_roles",
    "t01_reconcile",
    "t03_suppress_alerts",
    "t07_classify_failures",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "tablekeep-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": pathlib.Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
