"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query runs to the end into a no-op sink; the value of a
query is its second run, ``cold`` keeps the first.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dayweave.plans import load_queries  # noqa: E402
from dayweave.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_cycle_rates",
    "g17_parameter_sweep",
    "g01_smooth",
    "b07_resample_daily",
    "d06_median_ratio",
    "d09_elevation_gain",
    "d18_binned_summary",
    "e05_centred_median",
    "e07_rolling_minmax_shifted",
    "e10_ewm_adjusted",
    "f01_prorate_in_intervals",
    "f05_paint_samples",
    "f07_sum_in_intervals",
    "g19_best_shift",
    "i01_cross_correlation",
    "i02_sliding_windows",
    "j05_warning_sequences",
    "k04_overflow_carry",
    "k06_daily_body_load",
    "l04_period_plan",
    "m07_granger_matrix",
    "c14_text_categories",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    warm, cold = {}, {}
    for name in HEADLINE:
        for store in (cold, warm):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    total = round(sum(warm.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": warm, "cold": cold, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
