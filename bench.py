"""Time the headline jobs over the derived log lines and print one JSON line.

Every query runs in full and its rows are consumed by the no-op sink; the time is the
better of BENCH_RUNS runs in a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quietlog.plans import catalog  # noqa: E402
from quietlog.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINES = [
    "j1_totals", "r1_findings_cli", "r1_findings_web", "j1_findings_by_component", "a1_summary",
    "a2_dups_fixture", "a2_dups_documents", "a3_dups_per_file", "a3_dups_documents", "r10_concat",
    "r7_first_examples", "r7_first_examples_documents", "r8_ordered", "r9_ordered", "w1_line_numbers", "s1_text_scan",
    "f10_sensitive_documents", "s5_explode_lines", "s7_budget", "s9_test_listing",
    "r3_test_summary", "k4_history", "k1_report_rows_cli", "k2_dup_report_rows", "k5_result_json",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "quietlog-bench", f"local[{CPUS}]",
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quietlog-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINES
    consume(catalog.QUERIES["j1_totals"](spark, SF_DIR))  # warms the session up
    times: dict[str, float] = {}
    for name in chosen:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            consume(catalog.QUERIES[name](spark, SF_DIR))
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
