"""Time the headline queries; prints one JSON line.

Every query runs twice into a no-op sink: the first run is cold (code generation and
file listing included), the second is what is summed up.
"""

from __future__ import annotations

import json
import os
import time

from registry import QUERIES
from tests.session import get_spark

HEADLINE = (
    "a02_missing_by_column",
    "a04_duplicate_rows",
    "a06_unique_count",
    "a10_describe",
    "a18_column_profile",
    "a19_generate_metadata",
    "a21_outlier_ratio",
    "c08_standardize_dates",
    "c12_standardize_value",
    "v05_format_violations",
    "v07_auto_standardize",
    "v09_pattern_report",
    "v12_format_flags",
    "q13_quality_report",
    "l01_rule_suggestions",
    "l04_apply_plan",
    "l05_clean_until",
    "l06_basic_clean",
    "k02_fill_merged_cells",
    "k09_remove_special",
    "k35_near_duplicates",
    "k35_near_duplicates_minhash",
    "k40_forward_fill",
    "k51_fix_spelling",
    "k52_validate_totals",
    "k55_anomalies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"))
    cold, warm = {}, {}
    for name in HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
