"""Rank tests: known values, brute force on random data, missing and degenerate strata."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkcohort.functions.exact import squared_distance_frequencies
from sparkcohort.operators import corr
from sparkcohort.operators import ranktests as rt

X = [.80, .83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, .73, 1.46]
Y = [1.15, .88, .90, .74, 1.21]
PAIRS = [(1.83, .878), (.50, .647), (1.62, .598), (2.48, 2.05), (1.68, 1.06), (1.88, 1.29), (1.55, 1.06), (3.06, 3.14),
         (1.30, 1.29)]


def two_samples(spark, x, y):
    return spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "g string, v double")


def paired(spark, pairs):
    rows = [(i, l, v) for i, p in enumerate(pairs) for l, v in zip("ab", p)]
    return spark.createDataFrame(rows, "id long, t string, v double")


def mid(values):
    return {v: sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in set(values)}


def test_rank_sum_known_values(spark):
    df = two_samples(spark, X, Y)
    exact = rt.rank_sum(df, [], "g", "v").first()
    assert (exact["statistic"], exact["n1"], exact["n2"]) == (35.0, 10, 5)
    assert exact["p"] == pytest.approx(0.254412, abs=1e-6)
    assert rt.rank_sum(df, [], "g", "v", exact=False).first()["p"] == pytest.approx(0.244624, abs=1e-6)


def test_rank_sum_exact_by_enumeration(spark):
    x, y = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]
    row = rt.rank_sum(two_samples(spark, x, y), [], "g", "v").first()
    ranks = sorted(x + y)
    w = [sum(ranks.index(v) + 1 for v in s) - 6 for s in itertools.combinations(ranks, 3)]
    observed = sum(ranks.index(v) + 1 for v in x) - 6
    low, high = sum(k <= observed for k in w) / len(w), sum(k >= observed for k in w) / len(w)
    assert row["statistic"] == observed
    assert row["p"] == pytest.approx(min(1.0, 2 * min(low, high)))


def test_signed_rank_known_values(spark):
    row = rt.signed_rank(paired(spark, PAIRS), [], "id", "t", "v").first()
    assert row["statistic"] == 40.0
    assert row["p"] == pytest.approx(0.0390625)


def test_pairwise_rank_sum_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(s, l, float(rng.choice([0, 50, 100, 200, 400, 800])) + (l == "c") * 25 * rng.random())
            for s in ("p", "q", None) for l in "abc" for _ in range(rng.randint(5, 60))]
    got = {(r["s"], r["group1"], r["group2"]): r for r in rt.pairwise_rank_sum(
        spark.createDataFrame(rows, "s string, l string, v double"), ["s"], "l", "v", ["c", "a", "b"], exact=False).collect()}
    assert len(got) == 9
    for (s, g1, g2), r in got.items():
        x, y = ([v for k, l, v in rows if k == s and l == g] for g in (g1, g2))
        ranks, n = mid(x + y), len(x) + len(y)
        w = sum(ranks[v] for v in x) - len(x) * (len(x) + 1) / 2
        ties = sum((x + y).count(v) ** 3 - (x + y).count(v) for v in set(x + y))
        sd = math.sqrt(len(x) * len(y) / 12 * (n + 1 - ties / (n * (n - 1))))
        centred = w - len(x) * len(y) / 2
        z = (centred - math.copysign(0.5, centred)) / sd if centred else 0.0
        assert r["statistic"] == w
        assert r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    for s in ("p", "q", None):
        ordered = sorted((r for k, r in got.items() if k[0] == s), key=lambda r: r["p"])
        running = 0.0
        for k, r in enumerate(ordered):
            running = max(running, min(1.0, (3 - k) * r["p"]))
            assert r["p_adj"] == pytest.approx(running)


def test_statistics_of_both_directions_add_up(spark):
    df = two_samples(spark, X + [1.0, 1.0], Y + [1.0])
    a = rt.rank_sum(df, [], "g", "v", ["x", "y"], exact=False).first()
    b = rt.rank_sum(df, [], "g", "v", ["y", "x"], exact=False).first()
    assert a["statistic"] + b["statistic"] == a["n1"] * a["n2"]
    assert a["p"] == pytest.approx(b["p"])


def test_pairwise_signed_rank_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.choice([0.0, 50.0, 100.0, 200.0]) if (i, t) != (3, "b") else None)
            for i in range(60) for t in "abc"]
    got = rt.pairwise_signed_rank(spark.createDataFrame(rows, "id long, t string, v double"), [], "id", "t", "v",
                                  list("abc"), exact=False).collect()
    value = {(i, t): v for i, t, v in rows}
    for r in got:
        d = [value[i, r["group1"]] - value[i, r["group2"]] for i in range(60)
             if None not in (value[i, r["group1"]], value[i, r["group2"]])]
        assert r["n1"] == len(d)
        d = [x for x in d if x]
        ranks = mid([abs(x) for x in d])
        assert r["statistic"] == sum(ranks[abs(x)] for x in d if x > 0)


def test_zero_variance_has_no_p_and_is_not_adjusted(spark):
    df = spark.createDataFrame([("m", g, 0.0) for g in "ab" for _ in range(4)] + [("m", "c", float(v)) for v in range(4)]
                               + [("m", "d", None)], "s string, g string, v double")
    got = {(r["group1"], r["group2"]): r for r in
           rt.pairwise_rank_sum(df, ["s"], "g", "v", list("abcd")).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}  # a level without values has no test
    assert got["a", "b"]["p"] is None and got["a", "b"]["p_adj"] is None and got["a", "b"]["p_adj_signif"] is None
    assert got["a", "c"]["p_adj"] == pytest.approx(min(1.0, 2 * got["a", "c"]["p"]))


def test_all_pairs_equal_in_signed_rank(spark):
    row = rt.signed_rank(paired(spark, [(1.0, 1.0), (2.0, 2.0)]), [], "id", "t", "v").first()
    assert (row["n1"], row["statistic"], row["p"]) == (2, 0.0, None)


def test_display_selection_after_adjustment(spark):
    rows = [(i, t, float((i * 7 + k * 3) % 11 + k)) for i in range(30) for k, t in enumerate("abcde")]
    df = spark.createDataFrame(rows, "id long, t string, v double")
    tests = rt.pairwise_signed_rank(df, [], "id", "t", "v", list("abcde"), exact=False)
    shown = rt.number_rows(rt.display_pairs(tests, rt.CONSECUTIVE_AND_FIRST_THIRD), ["position"]).orderBy("id").collect()
    assert [(r["group1"], r["group2"]) for r in shown] == [("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")]
    full = {(r["group1"], r["group2"]): r["p_adj"] for r in tests.collect()}
    assert len(full) == 10 and all(full[r["group1"], r["group2"]] == r["p_adj"] for r in shown)


def test_placeholder_rows(spark):
    tests = rt.pairwise_rank_sum(two_samples(spark, X, Y), [], "g", "v").withColumn("moment", F.lit("later"))
    out = rt.with_placeholder(tests, [{"moment": "baseline", "p_adj_signif": "ns"}])
    assert out.columns == tests.columns
    fixed = out.where("moment = 'baseline'").first()
    assert fixed["p_adj_signif"] == "ns" and fixed["p"] is None


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError):
        rt.rank_sum(spark.range(200).select(F.col("id").cast("string").alias("g"), F.col("id").cast("double").alias("v")),
                    [], "g", "v")


def two_sided(sums, observed):
    return min(1.0, 2 * min(sum(s <= observed for s in sums), sum(s >= observed for s in sums)) / len(sums))


def test_tied_rank_sum_is_the_permutation_test(spark):
    rng = random.Random(1)
    rows = [(s, l, float(rng.choice([0, 50, 50, 100, 400]))) for s in ("a", "b", None) for l in "xyz" for _ in range(rng.randint(1, 5))]
    rows += [("same", l, 7.0) for l in "xxyyz"] + [("a", "x", None), ("a", "y", float("nan"))]
    df = spark.createDataFrame(rows, "s string, l string, v double")
    got = rt.rank_sum(df, ["s"], "l", "v", exact="tied").collect()
    assert len(got) == 12
    for r in got:
        x, y = ([v for s, l, v in rows if s == r["s"] and l == r[g] and v is not None and v == v] for g in ("group1", "group2"))
        ranks = [mid(x + y)[v] for v in x + y]
        sums = [sum(c) for c in itertools.combinations(ranks, len(x))]
        assert r["p"] == pytest.approx(two_sided(sums, sum(ranks[:len(x)])), rel=1e-12)


def test_tied_signed_rank_tries_all_signs(spark):
    rng = random.Random(2)
    rows = [(s, i, l, float(rng.choice([0, 1, 1, 2, 4]))) for s in ("a", None) for i in range(8) for l in "xyz"]
    rows += [("zero", i, l, 3.0) for i in range(3) for l in "xyz"]
    df = spark.createDataFrame(rows, "s string, i long, l string, v double")
    for r in rt.signed_rank(df, ["s"], "i", "l", "v", exact="tied").collect():
        value = {(i, l): v for s, i, l, v in rows if s == r["s"]}
        d = [value[i, r["group1"]] - value[i, r["group2"]] for i in sorted({i for i, _ in value})]
        d = [x for x in d if x]
        ranks = [mid([abs(x) for x in d])[abs(x)] for x in d]
        sums = [sum(k for k, sign in zip(ranks, signs) if sign) for signs in itertools.product((0, 1), repeat=len(d))]
        assert r["p"] == pytest.approx(two_sided(sums, sum(k for k, x in zip(ranks, d) if x > 0)), rel=1e-12)


def test_tied_exact_without_ties_and_at_size(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([("xy"[k % 2], rng.random()) for k in range(61)], "l string, v double")
    assert rt.rank_sum(df, [], "l", "v", exact="tied").first()["p"] == pytest.approx(rt.rank_sum(df, [], "l", "v").first()["p"], rel=1e-10)
    large = spark.createDataFrame([("xy"[k % 2], float(k % 7 + (k % 20 == 1))) for k in range(300)], "l string, v double")
    near = rt.rank_sum(large, [], "l", "v", exact=False).first()["p"]
    assert rt.rank_sum(large, [], "l", "v", exact="tied", exact_below=1_000).first()["p"] == pytest.approx(near, rel=0.05)
    assert rt.rank_sum(large, [], "l", "v", exact="tied").first()["p"] == near     # above the bound, as documented
    shifted = rt.pairwise_rank_sum(large, [], "l", "v", exact="tied", exact_below=1_000).first()
    assert shifted["p_adj"] == shifted["p"]


def test_k_sample_from_average_ranks(spark):
    rng = random.Random(8)
    rows = [(s, l, float(rng.choice([0, 50, 100, 200, 400])) + (l == "c") * 30) for s in ("p", None) for l in "abcd" for _ in range(rng.randint(3, 25))]
    rows += [("one", "a", 1.0), ("one", "a", 2.0), ("tied", "a", 3.0), ("tied", "b", 3.0), ("p", None, 5.0), ("p", "a", None)]
    got = {r["s"]: r for r in rt.k_sample(spark.createDataFrame(rows, "s string, l string, v double"), ["s"], "l", "v").collect()}
    for s in ("p", None):
        data = [(l, v) for t, l, v in rows if t == s and l is not None and v is not None]
        ranks, n = mid([v for _, v in data]), len(data)
        sums = {l: [ranks[v] for k, v in data if k == l] for l in "abcd"}
        h = 12 / (n * (n + 1)) * sum(sum(x) ** 2 / len(x) for x in sums.values()) - 3 * (n + 1)
        values = [v for _, v in data]
        h /= 1 - sum(values.count(v) ** 3 - values.count(v) for v in set(values)) / (n ** 3 - n)
        assert (got[s]["n"], got[s]["groups"], got[s]["df"]) == (n, 4, 3)
        assert got[s]["statistic"] == pytest.approx(h)
        # three degrees of freedom: closed form of the tail
        tail = math.erfc(math.sqrt(h / 2)) + math.sqrt(2 * h / math.pi) * math.exp(-h / 2)
        assert got[s]["p"] == pytest.approx(tail, abs=1e-9)
    assert got["one"]["statistic"] is None and got["tied"]["statistic"] is None and got["tied"]["p"] is None


def test_spearman_exact_tries_all_orders(spark):
    rng = random.Random(8)
    groups = {n: rng.sample(range(n), n) for n in range(2, 9)}
    groups[9], groups[12] = list(range(9)), rng.sample(range(12), 12)
    rows = [(str(n), float(i), float(v)) for n, order in groups.items() for i, v in enumerate(order)]
    rows += [("tied", 1.0, 1.0), ("tied", 2.0, 1.0), ("tied", 3.0, 5.0), ("tied", 4.0, 2.0), ("tied", None, 2.0), ("one", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    exact = {r["g"]: r for r in corr.spearman(df, ["g"], "x", "y", exact_below=10).collect()}
    plain = {r["g"]: r for r in corr.spearman(df, ["g"], "x", "y").collect()}
    assert exact["2"].asDict().keys() == plain["2"].asDict().keys()
    for n in range(2, 9):
        observed = sum((i - v) ** 2 for i, v in enumerate(groups[n]))
        sums = [sum((i - v) ** 2 for i, v in enumerate(order)) for order in itertools.permutations(range(n))]
        assert exact[str(n)]["p"] == pytest.approx(two_sided(sums, observed), rel=1e-12)
    assert exact["9"]["p"] == pytest.approx(2 / math.factorial(9), rel=1e-9) and exact["9"]["rho"] == 1.0
    for kept in ("12", "tied", "one"):        # too large, tied, too small
        assert exact[kept]["p"] == plain[kept]["p"]
    with pytest.raises(ValueError):
        corr.spearman(df, ["g"], "x", "y", exact_below=16)
    assert corr.spearman(df.limit(0), ["g"], "x", "y", exact_below=10).collect() == []


def test_squared_distances_at_the_largest_size():
    ways = squared_distance_frequencies(14)
    assert ways.sum() == math.factorial(14) and ways[0] == ways[-1] == 1 and (ways == ways[::-1]).all() and ways[2] == 13


def mixed_strata():
    """Strata of 1 to 600 rows, under keys that may be missing, with values that may be."""
    rng = random.Random(9)
    rows = []
    for k, n in enumerate([1, 2, 3, 5, 7, 9, 10, 11, 13, 40, 90, 200, 255, 256, 257, 600]):
        values = [0.0, -0.0, 1.0, 1.0, 2.5, float("nan"), None] if k % 2 else [rng.uniform(-3, 3) for _ in range(4 + n // 2)]
        rows += [(None if k == 4 else k // 2, None if k % 2 else "odd", rng.choice("xyzu"), float(i), rng.choice(values), rng.choice(values)) for i in range(n)]
    return rows


def same_tests(spark, monkeypatch, run, key):
    got = {tuple(r[c] for c in key): r for r in run().collect()}
    monkeypatch.setattr(rt, "SMALL_STRATUM", 0)            # every stratum by cells
    want = {tuple(r[c] for c in key): r for r in run().collect()}
    assert got.keys() == want.keys() and len(got) > 12
    for k, r in want.items():
        assert got[k].asDict().keys() == r.asDict().keys()
        for c, v in r.asDict().items():
            assert got[k][c] == (v if v is None or not isinstance(v, float) else pytest.approx(v, rel=1e-9)), (k, c)


def test_tied_rank_sums_of_small_strata_equal_those_by_cells(spark, monkeypatch):
    df = spark.createDataFrame(mixed_strata(), "a long, b string, l string, i double, v double, w double").repartition(5)
    same_tests(spark, monkeypatch, lambda: rt.rank_sum(df, ["a", "b"], "l", "v", ["x", "y", "z"], exact="tied"), ["a", "b", "ord1", "ord2"])


def test_tied_signed_ranks_of_small_strata_equal_those_by_cells(spark, monkeypatch):
    df = spark.createDataFrame(mixed_strata(), "a long, b string, l string, i double, v double, w double").repartition(5)
    same_tests(spark, monkeypatch, lambda: rt.signed_rank_wide(df, ["a", "b"], {"v": "v", "w": "w", "i": "i"}, exact="tied"), ["a", "b", "ord1", "ord2"])


@pytest.mark.parametrize("name", ["tied_signedrank", "tied_ranksum"])
def test_tied_tests_of_small_strata_take_one_shuffle(spark, name):
    from sparkcohort.plans.catalog import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
