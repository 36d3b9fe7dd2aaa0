"""Headline queries on one machine: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "spend_totals", "spend_by_category_periods", "spend_by_subcategory_periods", "receipt_subcategory_totals",
    "unknown_subcategory_items", "processing_timing", "recent_receipts", "price_baselines", "overpaid_items",
    "top_price_increases", "best_store_by_item", "restock_levels", "restock_candidates", "store_prices",
    "store_recommendation", "store_plan", "reconcile_shopping_list", "dedupe_by_content", "scan_receipt_files",
    "low_text_quality", "extract_total_documents", "extract_line_items", "unit_prices", "dedupe_stores",
    "semantic_duplicates", "export_counts", "stream_spend_by_week", "stream_ingest_files",
)

#: Runs shorter than this are repeated, and the median of three counts.
SHORT_S = 3.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    # Keep the one JSON line clean: everything else a run prints goes to stderr.
    out = os.fdopen(os.dup(1), "w")
    os.dup2(2, 1)
    from tillwise.plans.registry import QUERIES
    from tillwise.session import local_session

    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "16g")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed(names[0])  # warm-up: the first run loads and compiles
    timings = {}
    for name in names:
        runs = [timed(name)]
        if runs[0] < SHORT_S:
            runs += [timed(name), timed(name)]
        timings[name] = round(statistics.median(runs), 3)
    spark.stop()
    line = {"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf_dir.rsplit("sf", 1)[-1]}
    out.write(json.dumps(line) + "\n")
    out.flush()


if __name__ == "__main__":
    main()
