"""Significance tests, quantiles and histograms against brute force and published aggregates."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergescope.operators.quantiles import approximate_quantiles, box_stats, clip_at_quantile, histogram, quantiles, value_counts
from mergescope.operators.stats import (
    chi_square, chi_square_columns, chi_square_of_counts, exact_u_p, log_rank, mann_whitney, mann_whitney_counts, pair_counts,
)


def one(df):
    (row,) = df.collect()
    return row.asDict()


# Published counts (merged, total) of two groups and their rounded statistic.
PUBLISHED = [(38464, 48624, 245530, 300786, 175.14)]


@pytest.mark.parametrize("a,na,b,nb,chi2", PUBLISHED)
def test_chi_square_of_published_counts(spark, a, na, b, nb, chi2):
    row = one(spark.range(1).select(
        chi_square_columns(F.lit(a), F.lit(na), F.lit(b), F.lit(nb)).alias("yates"),
        chi_square_columns(F.lit(a), F.lit(na), F.lit(b), F.lit(nb), yates=False).alias("plain"),
    ))
    assert round(row["yates"], 2) == chi2
    assert round(row["plain"], 2) == 175.31


def test_chi_square_edges(spark):
    df = spark.createDataFrame(
        [("full", True, True)] * 3 + [("full", False, False)] * 2 + [("full", None, True)] + [("flat", True, True), ("flat", False, True)],
        "g string, side boolean, hit boolean",
    )
    rows = {r["g"]: r for r in chi_square(df, ["g"], F.col("side"), F.col("hit"), need_all_cells=True).collect()}
    assert (rows["full"]["hit_a"], rows["full"]["total_a"], rows["full"]["hit_b"], rows["full"]["total_b"]) == (3, 3, 0, 2)
    assert rows["full"]["chi2"] is None and rows["flat"]["chi2"] is None
    open_rows = {r["g"]: r for r in chi_square(df, ["g"], F.col("side"), F.col("hit")).collect()}
    # |3 - 1.8| = 1.2 in every cell, corrected to 0.7; expected counts 1.8, 1.2, 1.2, 0.8.
    assert open_rows["full"]["chi2"] == pytest.approx(0.49 * (1 / 1.8 + 1 / 1.2 + 1 / 1.2 + 1 / 0.8))
    assert open_rows["flat"]["chi2"] is None


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def frame(spark, a, b):
    rows = [(True, float(x)) for x in a] + [(False, float(x)) for x in b]
    return spark.createDataFrame(rows, "side boolean, x double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.integers(-5, 40), min_size=1, max_size=25), b=st.lists(st.integers(-5, 40), min_size=1, max_size=25))
def test_u_equals_pair_counting(spark, a, b):
    got = one(mann_whitney(frame(spark, a, b), [], F.col("side"), "x", exact_small=False))
    assert got["u"] == brute_u(a, b)
    n = len(a) + len(b)
    ties = sum(c**3 - c for c in pd.Series(a + b).value_counts())
    spread = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    if spread:
        z = (max(got["u"], len(a) * len(b) - got["u"]) - len(a) * len(b) / 2 - 0.5) / spread
        assert got["p"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-9)
    else:
        assert got["p"] == 1.0 and got["sig"] == "ns"


def test_u_of_one_side_only_is_absent(spark):
    assert mann_whitney(frame(spark, [1, 2], []), [], F.col("side"), "x").count() == 0


def test_small_untied_samples_use_all_arrangements(spark):
    a, b = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]
    u = brute_u(a, b)
    pooled = a + b
    extreme = max(u, len(a) * len(b) - u)
    hits = total = 0
    for chosen in itertools.combinations(range(7), 3):
        first = [pooled[i] for i in chosen]
        second = [pooled[i] for i in range(7) if i not in chosen]
        hits += brute_u(first, second) >= extreme
        total += 1
    got = one(mann_whitney(frame(spark, a, b), [], F.col("side"), "x"))
    assert got["p"] == pytest.approx(min(1.0, 2 * hits / total))
    tied = one(mann_whitney(frame(spark, [1, 1, 2], [1, 3]), [], F.col("side"), "x"))
    assert tied["p"] == pytest.approx(one(mann_whitney(frame(spark, [1, 1, 2], [1, 3]), [], F.col("side"), "x", exact_small=False))["p"])


def test_every_u_of_small_samples_has_its_permutation_value(spark):
    rows, expected = [], {}
    for m, n in ((1, 1), (1, 9), (2, 7), (8, 3), (5, 6), (8, 40)):
        if m + n < 15:  # all arrangements
            sums = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
            counts = {u: sums.count(u) for u in range(m * n + 1)}
        else:  # choices of the first k ranks, one rank after the other
            table = {(0, 0): 1}
            for rank in range(m + n):
                grown = dict(table)
                for (size, total), ways in table.items():
                    if size < m:
                        key = (size + 1, total + rank - size)
                        grown[key] = grown.get(key, 0) + ways
                table = grown
            counts = {u: table[m, u] for u in range(m * n + 1)}
        for u in range(m * n + 1):
            extreme = max(u, m * n - u)
            expected[m, n, u] = min(1.0, 2 * sum(counts[x] for x in range(extreme, m * n + 1)) / sum(counts.values()))
            rows.append((m, n, u, float(extreme)))
    df = spark.createDataFrame(rows, "m long, n long, u long, extreme double")
    for r in df.select("m", "n", "u", exact_u_p(F.col("extreme"), F.col("m"), F.col("n")).alias("p"), exact_u_p(F.col("extreme"), F.col("n"), F.col("m")).alias("q")).collect():
        assert r.p == pytest.approx(expected[r.m, r.n, r.u], rel=1e-9) and r.q == pytest.approx(r.p, rel=1e-12)


def test_a_tiny_sample_against_a_large_one_is_exact_in_the_tail(spark):
    rows = [(True, float(i)) for i in range(-3, 0)] + [(False, float(i)) for i in range(3000)]
    got = one(mann_whitney(spark.createDataFrame(rows, "side boolean, x double"), [], F.col("side"), "x"))
    assert (got["method"], got["u"]) == ("exact", 0.0) and got["p"] == pytest.approx(2 / math.comb(3003, 3), rel=1e-9)


def brute_log_rank(times, events, sides):
    observed = expected = variance = 0.0
    for t in sorted({t for t, e in zip(times, events) if e}):
        risk1 = sum(x >= t and s for x, s in zip(times, sides))
        risk = sum(x >= t for x in times)
        deaths = sum(x == t and e for x, e in zip(times, events))
        observed += sum(x == t and e and s for x, e, s in zip(times, events, sides))
        expected += deaths * risk1 / risk
        if risk > 1:
            variance += deaths * (risk1 / risk) * (1 - risk1 / risk) * (risk - deaths) / (risk - 1)
    return observed, expected, (observed - expected) ** 2 / variance


def test_log_rank_with_ties_and_censoring(spark):
    rng = np.random.default_rng(7)
    times = [float(x) for x in rng.integers(0, 60, 200)]
    events = [bool(x) for x in rng.integers(0, 2, 200)]
    sides = [bool(x) for x in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(list(zip(times, events, sides)), "t double, e boolean, s boolean")
    observed, expected, chi2 = brute_log_rank(times, events, sides)
    got = one(log_rank(df, [], F.col("s"), "t", F.col("e")))
    assert (got["n1"], got["n2"], got["observed"]) == (sum(sides), 200 - sum(sides), observed)
    assert got["expected"] == pytest.approx(expected) and got["chi2"] == pytest.approx(chi2)


def test_log_rank_with_a_censored_only_group(spark):
    df = spark.createDataFrame([(1.0, True, True), (2.0, True, True), (3.0, False, False), (4.0, False, False)], "t double, e boolean, s boolean")
    observed, expected, chi2 = brute_log_rank([1, 2, 3, 4], [1, 1, 0, 0], [1, 1, 0, 0])
    got = one(log_rank(df.withColumn("g", F.lit("x")), ["g"], F.col("s"), "t", F.col("e")))
    assert got["chi2"] == pytest.approx(chi2) and got["expected"] == pytest.approx(expected)


def test_pairs_from_counts_equal_the_direct_tests(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), bool(f)) for g, x, f in zip(rng.choice(["A", "B", "Human"], 300), rng.integers(0, 30, 300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "g string, x double, hit boolean")
    counts = value_counts(df, ["g"], ["x", "hit"])
    pairs = pair_counts(counts, "g", [("A", "A", "Human"), ("B", "B", "Human")])
    ranked = {(r["comparison"], r["metric"]): r for r in mann_whitney_counts(pairs, ["comparison", "metric"]).collect()}
    rates = {r["comparison"]: r for r in chi_square_of_counts(pairs, ["comparison"], "hit").collect()}
    for name in ("A", "B"):
        side = F.when(F.col("g") == name, True).when(F.col("g") == "Human", False)
        assert ranked[name, "x"]["u"] == one(mann_whitney(df, [], side, "x"))["u"]
        assert rates[name]["chi2"] == pytest.approx(one(chi_square(df, [], side, F.col("hit")))["chi2"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame([(g, x, None if x is None else x * 2) for g, x in rows], "g string, x double, y double")
    got = {r["g"]: r for r in quantiles(df, ["g"], low=("x", 0.05), mid=("x", 0.5), high=("y", 0.95)).collect()}
    for g in {g for g, x in rows if x is not None}:
        xs = [x for k, x in rows if k == g and x is not None]
        assert got[g]["low"] == pytest.approx(np.quantile(xs, 0.05), abs=1e-6)
        assert got[g]["mid"] == pytest.approx(np.quantile(xs, 0.5), abs=1e-6)
        assert got[g]["high"] == pytest.approx(np.quantile([2 * x for x in xs], 0.95), abs=1e-6)
    assert set(got) == {g for g, x in rows if x is not None}


def test_quantiles_of_one_hot_group(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), (F.rand(5) * F.rand(6) * 1000).alias("x"))
    xs = np.array([r[0] for r in df.select("x").collect()])
    row = one(quantiles(df, ["g"], mid=("x", 0.5), top=("x", 0.999)))
    assert row["mid"] == pytest.approx(np.median(xs)) and row["top"] == pytest.approx(np.quantile(xs, 0.999))
    near = one(approximate_quantiles(df, ["g"], mid=("x", 0.5)))["mid"]
    assert near == pytest.approx(np.median(xs), rel=0.01)


def test_box_and_clip(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, x double")
    box = one(box_stats(df, ["g"], "x"))
    assert (box["n"], box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"], box["outliers"]) == (5, 2, 3, 4, 1, 4, 1)
    capped = sorted(r["c"] for r in clip_at_quantile(df, ["g"], "x", 0.5, "c").collect() if r["c"] is not None)
    assert capped == [1, 2, 3, 3, 3]


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(5, 2, 500).round(3), [0.0, 10.0, 10.0]])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r["bin"]: r["rows"] for r in histogram(df, "x").collect()}
    want, _ = np.histogram(xs, bins=20)
    assert [got.get(i, 0) for i in range(20)] == list(want)
    flat = {r["bin"]: r["rows"] for r in histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").collect()}
    want, _ = np.histogram([3.0] * 4, bins=20)
    assert [flat.get(i, 0) for i in range(20)] == list(want)


def test_infinite_and_undefined_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (-inf, 1.0, 2.0, 3.0, inf)], "x double")
    assert one(quantiles(df, [], m=("x", 0.5)))["m"] == 2.0
    sides = spark.createDataFrame([(True, 1.0, True), (True, float("nan"), True), (False, 2.0, True), (False, inf, False)], "side boolean, t double, e boolean")
    plain = sides.where("NOT isnan(t)")
    assert one(log_rank(sides, [], F.col("side"), "t", F.col("e"))) == one(log_rank(plain, [], F.col("side"), "t", F.col("e")))


def test_method_of_small_samples(spark):
    rows = [(True, float(x)) for x in (1, 4, 6, 9, 11)] + [(False, float(x)) for x in (2, 3, 5, 12, 13, 14)]
    small = one(mann_whitney(spark.createDataFrame(rows, "side boolean, x double"), [], F.col("side"), "x"))
    tied = one(mann_whitney(spark.createDataFrame([*rows, (True, 2.0)], "side boolean, x double"), [], F.col("side"), "x"))
    assert (small["method"], tied["method"]) == ("exact", "normal")
