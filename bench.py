"""Time the registered queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name-prefix ...]

Each query is planned and run from the source tables to the ``noop`` sink: one run to warm up, then
the median of ``BENCH_RUNS`` (default 1) runs. ``value`` is the sum over the headline queries.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from circdesk.plans.registry import QUERIES
from circdesk.session import local_session

HEADLINE = (
    "f1_overdue_debt", "f2_stock_open4", "f3_fine_replacement", "f4_fine_additive",
    "f6_reader_open_loans", "q1_fine_report", "q2_stock_report", "q3_reader_loan_report",
    "q4_loans_per_book", "q7_requests_for_line", "q9_bulk_stock_decrement", "q10_bulk_status_set",
    "q11_append_lines", "n1_expired_card_notice", "n2_rarely_borrowed_notice", "t1_check_stock",
    "t2_restock_on_return", "t3_check_card", "t4_check_loan_limit", "t5_check_single_extension",
    "t6_check_unique_reader", "t1_t4_admit_statements", "s7_lock_overdue_cards", "s10_top_books",
    "s11_overdue_readers", "s12_revenue_by_month", "s13_category_status",
    "s14_damage_ratio_by_month", "p1_create_loans", "p2_apply_extensions", "p3_process_returns",
    "p4_ingest_books", "p5_patch_accounts", "p6_lines_after", "p7_cancel_cards",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    prefixes = tuple(sys.argv[1:])
    names = [n for n in QUERIES if n.startswith(prefixes)] if prefixes else HEADLINE
    spark = local_session()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
