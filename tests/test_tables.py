"""Sources, reshaping, completeness, frequency tables, profiles and contingency tests."""

import itertools
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.operators import contingency, describe, levels, ranktests, reshape, tableone
from sparkcohort.session import broadcast_if_small
from sparkcohort.sources import tables


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "a", 0.0, 50.0), (2, "b", 10.0, None), (3, None, 20.0, 30.0), (4, "a", None, None)]
    return spark.createDataFrame(rows, "id long, g string, m_1 double, m_2 double")


def test_conform_turns_bad_values_into_null(spark):
    df = spark.createDataFrame([("1", "2021-02-03", "x", "A1"), ("2", "no date", "2.5", None)], "k string, d string, v string, id string")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("d", T.TimestampType()),
                           T.StructField("v", T.DoubleType()), T.StructField("missing", T.LongType())])
    rows = tables.conform(df, schema).collect()
    assert tuple(rows[0]) == ("A1", datetime(2021, 2, 3), None, None)
    assert tuple(rows[1]) == (None, None, 2.5, None)
    assert tables.drop_null_keys(df, "id").count() == 1
    typed = tables.conform_positions(df, {0: T.LongType()})
    assert [f.dataType for f in typed.schema.fields][:2] == [T.LongType(), T.StringType()]


def test_odd_names_and_round_trip_through_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "Sí", 2.5)], ["ID", "Enf. Renal crónica", "Título_0"])
    named = tables.rename(df, {"Enf. Renal crónica": "kidney", "Título_0": "titre_0", "ID": "id"})
    path = str(tmp_path / "out")
    tables.write_result(named, path, "csv")
    back = tables.read_table(spark, path, "csv", T.StructType.fromDDL("id long, kidney string, titre_0 double"), key="id")
    assert back.collect() == named.collect()
    with pytest.raises(ValueError):
        tables.read_table(spark, path, "csv")


def test_column_selection(wide):
    assert reshape.columns_with_prefix(wide, "m_") == ["m_1", "m_2"]
    assert reshape.columns_at(wide, 2, 3) == ["g", "m_1"]
    assert reshape.numeric_columns(wide) == ["id", "m_1", "m_2"]
    assert reshape.string_columns(wide) == ["g"]
    assert [r["g"] for r in reshape.across(wide, ["g"], F.upper).orderBy("id").collect()] == ["A", "B", None, "A"]


def test_long_keeps_missing_cells_and_wide_inverts_it(wide):
    long = reshape.to_long(wide, ["id"], ["m_1", "m_2"], "m", "v")
    assert long.count() == 8
    back = reshape.to_wide(long, ["id"], "m", "v", {"m_1": "m_1", "m_2": "m_2"})
    assert sorted(map(str, back.collect())) == sorted(map(str, wide.select("id", "m_1", "m_2").collect()))


def test_complete_cases_both_ways(wide):
    assert sorted(r["id"] for r in reshape.complete_cases(wide, ["m_1", "m_2"]).collect()) == [1, 3]
    long = reshape.to_long(wide, ["id"], ["m_1", "m_2"], "m", "v")
    kept = reshape.complete_cases_long(long, "id", "v")
    assert {r["id"]: r["n"] for r in kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 3: 2}


def test_join_keeps_second_assay_values_once(spark, wide):
    assay = spark.createDataFrame([(1, 5.0), (3, 7.0), (9, 1.0)], "Id long, neu double")
    joined = reshape.join_assay(wide, assay, {"id": "Id"})
    assert joined.count() == wide.count()
    assert joined.where("neu IS NOT NULL").count() == 2
    doubled = assay.union(assay.where("Id = 1"))
    assert [(r["Id"], r["n"]) for r in reshape.duplicate_keys(doubled, ["Id"]).collect()] == [(1, 2)]


def test_drop_positions(spark):
    df = spark.createDataFrame([(k,) for k in "edcba"], "k string")
    assert sorted(r["k"] for r in reshape.drop_positions(df, ["k"], [1, 4]).collect()) == ["b", "c", "e"]
    assert reshape.drop_positions(df, ["k"], []).count() == 5


def test_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "g string")
    got = {r["g"]: r["o"] for r in levels.apply_levels(df, "g", ["b", "a"], "o").collect()}
    assert got == {"b": 1, "a": 2, None: None}
    assert levels.apply_levels(df, "g", ["b", "a"], drop_other=True).count() == 2
    labels = describe.count_labels(df, "g", "{label}\n(n = {n})", labels={"a": "A"}, levels=["a", "q"])
    assert {r["g"]: r["label"] for r in labels.collect()} == {"a": "A\n(n = 1)", "q": "q\n(n = 0)"}


def test_frequencies(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "x"), (None, "y"), ("a", "y"), ("b", None)], "r string, c string")
    one = {r["r"]: r for r in describe.oneway_frequency(df, "r").collect()}
    assert one["a"]["percent_text"] == "57.1%" and one[None]["valid_percent"] is None
    assert sum(r["percent"] for r in one.values()) == pytest.approx(1.0)
    cross = describe.crosstab(df, "r", "c").collect()
    for c in ("x", "y", None):
        assert sum(r["percent"] for r in cross if r["c"] == c) == pytest.approx(1.0)
    wide_table = {r["r"]: r for r in describe.crosstab_wide(df, "r", "c", ["x", "y", "none"]).collect()}
    assert wide_table["a"]["x"] == "75.0% (3)" and wide_table["b"]["y"] == "0.0% (0)"
    assert wide_table["a"]["none"] == "NA (0)"


def test_missing_pareto_and_profile(wide):
    got = {r["variable"]: r for r in describe.missing_pareto(wide).collect()}
    assert [got["m_2"]["position"], got["g"]["position"], got["m_1"]["position"], got["id"]["position"]] == [1, 2, 3, 4]
    assert got["m_2"]["ratio"] == 0.5 and got["id"]["cumulative"] == 1.0
    profile = {r["variable"]: r for r in describe.numeric_profile(wide, ["m_1", "m_2"]).collect()}
    assert profile["m_2"]["n_missing"] == 2 and profile["m_2"]["p50"] == 40.0
    assert profile["m_1"]["complete_rate"] == 0.75 and profile["m_1"]["sd"] == pytest.approx(10.0)
    grouped = describe.numeric_profile(wide, ["m_1", "m_2"], ["g"]).where("g = 'b' AND variable = 'm_2'").first()
    assert grouped["n_missing"] == 1 and grouped["p50"] is None


def matrix(spark, columns, name="t"):
    return spark.createDataFrame([(name, str(i), str(j), n) for j, col in enumerate(columns) for i, n in enumerate(col)],
                                 "t string, r string, c string, n long")


@pytest.mark.parametrize("columns,stat,df,p", [
    ([(28, 136), (33, 132), (161, 361)], 16.204683, 2, 3.0283e-4),
    ([(69, 57, 251), (95, 108, 271)], 9.721775, 2, 7.7436e-3),
    ([(80, 20), (80, 20), (80, 20)], 0.0, 2, 1.0)])
def test_chi_square_golden(spark, columns, stat, df, p):
    row = contingency.chi_square_counts(matrix(spark, columns), ["t"], "r", "c").first()
    assert row["statistic"] == pytest.approx(stat, abs=1e-6)
    assert row["df"] == df and row["p"] == pytest.approx(p, rel=1e-4)


def test_chi_square_empty_cells_and_correction(spark):
    counts = matrix(spark, [(10, 0, 5), (0, 8, 5)])
    row = contingency.chi_square_counts(counts.where("n > 0"), ["t"], "r", "c").first()
    table = [[10, 0], [0, 8], [5, 5]]
    n, rows, cols = 28, [10, 8, 10], [15, 13]
    want = sum((table[i][j] - rows[i] * cols[j] / n) ** 2 / (rows[i] * cols[j] / n) for i in range(3) for j in range(2))
    assert row["statistic"] == pytest.approx(want)
    # Yates: (|ad - bc| - n/2)^2 n / (product of margins)
    two = contingency.chi_square_counts(matrix(spark, [(12, 5), (7, 9)]), ["t"], "r", "c").first()
    assert two["statistic"] == pytest.approx((abs(12 * 9 - 7 * 5) - 33 / 2) ** 2 * 33 / (19 * 14 * 17 * 16))
    single = contingency.chi_square_counts(matrix(spark, [(12, 5)]), ["t"], "r", "c").first()
    assert single["df"] == 0 and single["p"] is None


def fisher_by_enumeration(table):
    """Sum of the probabilities of all 2 x c tables with the same margins that are not more likely than ``table``."""
    cols = [sum(c) for c in table]
    first = sum(c[0] for c in table)
    weight = lambda xs: math.prod(math.comb(c, x) for c, x in zip(cols, xs))
    options = [xs for xs in itertools.product(*[range(c + 1) for c in cols]) if sum(xs) == first]
    observed = weight([c[0] for c in table])
    return sum(weight(xs) for xs in options if weight(xs) <= observed * (1 + 1e-9)) / sum(map(weight, options))


def test_fisher_exact(spark):
    shapes = {"tea": [(3, 1), (1, 3)], "wide": [(0, 7), (3, 4), (2, 9)], "big": [(25, 30), (3, 41)]}
    counts = None
    for name, columns in shapes.items():
        part = matrix(spark, columns, name)
        counts = part if counts is None else counts.union(part)
    # a transposed table has the same p-value
    turned = matrix(spark, shapes["wide"]).select(F.lit("turned").alias("t"), F.col("c").alias("r"), F.col("r").alias("c"), "n")
    got = {r["t"]: r for r in contingency.fisher_exact_counts(counts.union(turned), ["t"], "r", "c").collect()}
    for name, columns in shapes.items():
        assert got[name]["p"] == pytest.approx(fisher_by_enumeration(columns), rel=1e-9)
    assert got["turned"]["p"] == pytest.approx(got["wide"]["p"])


def every_table(rows, cols):
    """All tables with these margins, row by row."""
    if len(rows) == 1:
        yield [list(cols)]
        return
    for first in itertools.product(*[range(c + 1) for c in cols]):
        if sum(first) == rows[0]:
            for rest in every_table(rows[1:], [c - x for c, x in zip(cols, first)]):
                yield [list(first), *rest]


def test_fisher_wider_tables(spark):
    shapes = {"three": [(3, 0, 1), (0, 4, 1), (1, 1, 3)], "four": [(2, 0, 1), (0, 3, 1), (1, 1, 2), (0, 1, 2)],
              "tall": [(4, 0, 0, 1), (1, 2, 3, 0), (0, 1, 0, 3)], "even": [(1, 1, 1), (1, 1, 1), (1, 1, 1)]}
    counts = None
    for name, columns in shapes.items():
        part = matrix(spark, columns, name)
        counts = part if counts is None else counts.union(part)
    exact = {r["t"]: r for r in contingency.fisher_exact_counts(counts, ["t"], "r", "c").collect()}
    drawn = {r["t"]: r for r in contingency.fisher_exact_counts(counts, ["t"], "r", "c", method="simulated").collect()}
    again = {r["t"]: r for r in contingency.fisher_exact_counts(counts.repartition(5), ["t"], "r", "c", method="simulated").collect()}
    for name, columns in shapes.items():
        cells = list(zip(*columns))
        weight = lambda table: -sum(math.lgamma(x + 1) for row in table for x in row)
        all_weights = [weight(t) for t in every_table([sum(r) for r in cells], [sum(c) for c in columns])]
        low = sum(math.exp(w) for w in all_weights if w <= weight(cells) + 1e-9)
        assert exact[name]["method"] == "exact" and exact[name]["p"] == pytest.approx(low / sum(map(math.exp, all_weights)), rel=1e-9)
        assert drawn[name]["method"] == "simulated" and drawn[name]["p"] == again[name]["p"] == pytest.approx(exact[name]["p"], abs=0.05)


def test_choice_of_test(spark):
    counts = matrix(spark, [(28, 136), (33, 132), (161, 361)], "large").union(matrix(spark, [(3, 1), (1, 3)], "small")).union(
        matrix(spark, [(3, 1)], "none"))
    got = {r["t"]: r for r in contingency.independence_test(counts, ["t"], "r", "c").collect()}
    assert got["large"]["test"] == "chi-square" and got["large"]["p"] == pytest.approx(3.0283e-4, rel=1e-4)
    assert got["small"]["test"] == "fisher exact" and got["small"]["p"] == pytest.approx(34 / 70)
    assert got["none"]["test"] is None and got["none"]["p"] is None


def test_baseline_table(spark):
    rows = [("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", None), ("x", None, 5.0), ("y", "a", 2.0), (None, "a", 9.0)]
    df = spark.createDataFrame(rows, "g string, c string, v double")
    got = {(r["variable"], r["level"], r["g"], r["kind"]): r for r in tableone.baseline_table(df, "g", ["c"], ["v"], number_digits=1).collect()}
    assert got["c", "a", "x", "categorical"]["text"] == "2 (67%)"
    assert got["c", None, "x", "unknown"]["n"] == 1
    assert got["c", "a", "x", "categorical"]["n_present"] == 4
    assert got["v", None, "x", "continuous"]["text"] == "3.0 (2.0, 4.0)"
    assert got["v", None, "x", "unknown"]["n"] == 1 and got["v", None, "x", "continuous"]["n_present"] == 4
    assert not any(g is None for _, _, g, _ in got)
    without = tableone.baseline_table(df, "g", ["c"], ["v"], missing=False)
    assert without.where("kind = 'unknown'").count() == 0


def test_nan_is_missing_in_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None)], "g string, v double")
    row = describe.numeric_profile(df).first()
    assert (row["n_missing"], row["mean"], row["p0"], row["p100"], row["p50"]) == (2, 2.0, 1.0, 3.0, 2.0)
    got = describe.geometric_mean(df, ["g"], "v").first()
    assert got["n"] == 2 and got["geo_mean"] == pytest.approx(math.sqrt(3))
    assert {r["variable"]: r["n_missing"] for r in describe.missing_pareto(df).collect()} == {"g": 0, "v": 2}
    assert describe.count_present(df, ["g"], ["v"]).first()["n_v"] == 2
    assert tuple(describe.range_and_mean(df, ["g"], ["v"]).first()) == ("a", 1.0, 3.0, 2.0)
    table = {r["kind"]: r for r in tableone.baseline_table(df, "g", [], ["v"]).collect()}
    assert table["unknown"]["n"] == 2 and {r["n_present"] for r in table.values()} == {2}


def test_drop_positions_counts_a_missing_key(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "k long")
    assert sorted(r["k"] for r in reshape.drop_positions(df, ["k"], [1, 2]).collect()) == [2, 3]


def test_duplicates_are_not_collapsed(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0)], "id long, level string, v double")
    with pytest.raises(Exception, match="several values"):
        reshape.to_wide(df, ["id"], "level", "v", {"a": "a", "b": "b"}).collect()


def test_wide_rows_are_not_broadcast(spark):
    keys = spark.range(40).select("id", F.expr("repeat('x', 1000000)").alias("name"))
    plan = lambda f: f._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan(broadcast_if_small(keys)).lower()
    assert "broadcast" in plan(broadcast_if_small(keys.select("id"))).lower()


def test_conform_counts_what_it_loses(spark):
    text = spark.createDataFrame([("1", "2.5", "x"), ("two", "3", "y"), (None, "z", None), ("4", None, "w")], "id string, `a.b` string, other string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("a.b", T.DoubleType()), T.StructField("absent", T.StringType())])
    kept, seen = tables.conform_observed(text, schema, "id")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 2.5, None), (4, None, None)]
    assert seen.get == {"rows": 4, "dropped": 2, "failed_id": 1, "failed_a.b": 1}


def test_publish_replaces_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(k, "ab"[k % 2], k % 3) for k in range(12)], "k long, g string, m int")
    for _ in range(2):      # running it again changes nothing
        tables.publish(rows, path, ["g", "m"])
    tables.publish(rows.where("g = 'a' AND m = 0").limit(1).selectExpr("-1L AS k", "g", "m"), path, ["g", "m"])
    got = sorted(tuple(r) for r in tables.read_table(spark, path).select("k", "g", "m").collect())
    assert got == sorted([(k, "ab"[k % 2], k % 3) for k in range(12) if not (k % 2 == 0 and k % 3 == 0)] + [(-1, "a", 0)])


def test_overall_column(spark):
    rows = [("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", None), ("x", None, 5.0), ("y", "a", 2.0), (None, "a", 9.0)]
    df = spark.createDataFrame(rows, "g string, c string, v double")
    key = lambda r: (r["variable"], r["level"], r["g"], r["kind"])
    plain = {key(r): r for r in tableone.baseline_table(df, "g", ["c"], ["v"]).collect()}
    both = tableone.baseline_table(df, "g", ["c"], ["v"], overall=True)
    got = {key(r): r for r in both.collect()}
    assert {k: r for k, r in got.items() if k[2] != "overall"} == plain
    assert got["c", "a", "overall", "categorical"]["text"] == "3 (75%)" and got["c", "a", "overall", "categorical"]["n_present"] == 4
    assert got["c", None, "overall", "unknown"]["n"] == 1 and got["v", None, "overall", "unknown"]["n"] == 1
    assert (got["v", None, "overall", "continuous"]["median"], got["v", None, "overall", "continuous"]["n_present"]) == (2.5, 4)
    assert tableone.baseline_table(df.limit(0), "g", ["c"], ["v"], overall=True).count() == 0
    tested = tableone.baseline_table_with_tests(df, "g", ["c"], overall=True)
    assert len({(r["test"], r["p"]) for r in tested.where("variable = 'c'").collect()}) == 1
    once = tableone.categorical_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "lang", ["source"], overall=True)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan


def test_stored_frame_is_read_without_a_shuffle(spark, tmp_path):
    rows = [(i, f"s{i % 2}", t, None if i % 7 == 0 and t == "b" else float(i + len(t))) for i in range(60) for t in ("a", "b")]
    df = spark.createDataFrame(rows, "id long, s string, t string, v double")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        for _ in range(2):
            stored = tables.store_bucketed(df, "stored_long", "id", 4, str(tmp_path / "long"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (lambda f: reshape.complete_cases_long(f, "id", "v"), lambda f: ranktests.paired_wide(f, ["s"], "id", "t", "v", ["a", "b"])):
            got, want = make(stored), make(df)
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" in want._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE stored_long")


def test_fisher_large_dense_tables(spark):
    # three rows and about 2,000 observations: far too many tables to complete one by one
    columns = [(60, 45, 380), (31, 32, 224), (39, 37, 210), (150, 90, 702)]
    counts = matrix(spark, columns, "dense")
    exact = contingency.fisher_exact_counts(counts, ["t"], "r", "c").collect()[0]["p"]
    cells = np.array(columns).T
    factorial = contingency._log_factorials(int(cells.sum()))
    score = -factorial[contingency._random_tables(cells.sum(1), cells.sum(0), 40_000, np.random.default_rng(7))].sum((1, 2))
    assert exact == pytest.approx(np.mean(score <= -factorial[cells].sum() + 1e-7), abs=5 * math.sqrt(exact * (1 - exact) / 40_000))
    # every table is low beside a limit of nothing, whatever the nodes it is counted by
    rows, cols = cells.sum(1), cells.sum(0)
    nodes = np.array([(a, b, cols[:2].sum() - a - b) for a in range(min(rows[0], cols[:2].sum()) + 1) for b in range(min(rows[1], cols[:2].sum()) + 1)
                      if 0 <= cols[:2].sum() - a - b <= rows[2]])
    assert contingency.low_mass(nodes, rows, cols[:2], cols[2:], 0.0, factorial) == pytest.approx(1.0, rel=1e-9)
