"""What the benchmark has to cover."""

import bench
from pyspark.sql import functions as F
from sparkcohort.plans.catalog import QUERIES


def test_exact_methods_are_measured():
    assert {"bootstrap_geomean_exact", "fisher_three_rows"} <= set(bench.HEADLINE) <= set(QUERIES)
    assert "bootstrap_geomean_ci" not in bench.RESAMPLED


def test_one_bootstrap_does_not_compress(spark):
    orders = bench.table(spark, "/root/testdata/sf0.01", "orders")
    assert orders.agg(F.countDistinct("o_totalprice") / F.count("o_totalprice")).first()[0] > 0.9
    assert "bootstrap_mean_totals" in bench.RESAMPLED
