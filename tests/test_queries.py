"""Every catalog query against its SQL counterpart, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_points  # noqa: E402
from check_queries import compare, connect  # noqa: E402
from sparkcohort.plans.catalog import QUERIES  # noqa: E402
from sparkcohort.plans.oracles import oracle_queries  # noqa: E402

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Their SQL covers the branch taken by larger groups only.
NEEDS_MEDIUM = {"ranksum_second_assay", "table_one_tests", "exact_ranksum", "age_regression"}
ORACLE = oracle_queries()
# Its draws have no SQL form; tests/test_models.py holds them against their distribution.
WITHOUT_SQL = {"bootstrap_geomean_compressed"}


@pytest.fixture(scope="module")
def connections():
    return {d: connect(d) for d in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_matches_sql(spark, connections, name):
    directory = MEDIUM if name in NEEDS_MEDIUM else SMALL
    assert compare(entry_points.queries()[name](spark, directory), connections[directory], ORACLE[name]) == ""


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(ORACLE) == set(QUERIES) - WITHOUT_SQL
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert QUERIES["bootstrap_geomean_compressed"](spark, MEDIUM).where("lower < geo_mean AND geo_mean < upper").count() > 0
    assert entry_points.entry(spark).count() > 0


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ranksum_by_stratum", "ranksum_pairwise_holm", "signedrank_pairwise_holm", "quartiles_iqr",
                                  "spearman_by_group", "numeric_profile", "deming_by_group", "ols_by_group",
                                  "chisq_status_priority", "bootstrap_geomean_poisson"])
def test_main_path_stays_in_the_jvm(spark, name):
    plan = physical_plan(entry_points.queries()[name](spark, SMALL))
    for node in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_scans_are_pruned_and_windows_are_cut_into_cells(spark):
    plan = physical_plan(entry_points.queries()["ranksum_pairwise_holm"](spark, SMALL))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
    assert "PushedFilters: [In(l_returnflag, [A,N,R]), IsNotNull(l_extendedprice)]" in plan
    # the window over measurements is partitioned by cell, and rows are counted before they are shuffled
    assert "_cell#" in plan and plan.count("partial_sum") >= 2


@pytest.mark.parametrize("name", ["error_bars", "bootstrap_geomean_poisson"])
def test_no_row_for_every_row_and_replicate(spark, name):
    assert "explode(sequence(" not in entry_points.queries()[name](spark, SMALL)._jdf.queryExecution().analyzed().toString()
