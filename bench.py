"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs once to warm up and then ``$BENCH_RUNS`` times; its median is reported, and ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkcohort.operators import resample  # noqa: E402
from sparkcohort.plans.catalog import QUERIES, table  # noqa: E402
from sparkcohort.session import local_session  # noqa: E402

HEADLINE = ("ranksum_by_stratum", "ranksum_pairwise_holm", "ranksum_vaccine_by_moment", "signedrank_pairwise_holm",
            "spearman_by_group", "deming_by_group", "quartiles_iqr", "numeric_profile", "table_one", "dose_interval_summary",
            "ols_by_group", "ols_global_test", "ols_diagnostics", "density_by_group", "chisq_status_priority", "narrow_ranksum",
            "deming_band", "bootstrap_geomean_exact", "bootstrap_geomean_compressed", "fisher_by_language", "fisher_three_rows")


def bootstrap_mean_quantity(spark, sf_dir):
    """Arithmetic mean: the full 10,000 replicates on measurements with few distinct values, which compress to few rows."""
    return resample.bootstrap_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 10_000)


def bootstrap_mean_totals(spark, sf_dir):
    """The full 10,000 replicates on mostly distinct values, which do not compress."""
    return resample.bootstrap_mean(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 10_000)


RESAMPLED = {f.__name__: f for f in (bootstrap_mean_quantity, bootstrap_mean_totals)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    work = {name: QUERIES[name] for name in HEADLINE} | RESAMPLED
    seconds = {}
    for name, query in work.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf_dir).collect()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
