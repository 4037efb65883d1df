"""Arithmetic relations between published monthly tables, replayed through the operators."""

import pytest
from pyspark.sql import functions as F

from mergescope.operators.aggregates import pivot_measure, share, with_total_row
from mergescope.operators.stats import chi_square_columns

AGENTS = ("Claude_Code", "Copilot", "Cursor", "Devin")

# Monthly fix counts, published shares of the month, and published merge rates, in the order of AGENTS.
MONTHS = {
    "2024-12": ((1389, 69, 1228, 238), (47.5, 2.36, 42.0, 8.14), (83.37, 91.3, 94.54, 57.98)),
    "2025-01": ((1410, 72, 1284, 392), (44.65, 2.28, 40.66, 12.41), (83.48, 91.67, 96.18, 59.18)),
    "2025-02": ((1703, 72, 1297, 768), (44.35, 1.88, 33.78, 20.0), (83.38, 95.83, 93.6, 59.64)),
    "2025-03": ((2230, 86, 1525, 1013), (45.94, 1.77, 31.42, 20.87), (78.43, 95.35, 94.16, 46.5)),
    "2025-04": ((2181, 101, 1400, 1359), (43.27, 2.0, 27.77, 26.96), (84.55, 93.07, 94.07, 70.64)),
    "2025-05": ((3016, 1068, 2143, 1232), (40.43, 14.32, 28.73, 16.52), (84.65, 73.5, 88.85, 75.81)),
    "2025-06": ((5381, 2942, 3586, 820), (42.27, 23.11, 28.17, 6.44), (87.62, 78.35, 88.68, 70.49)),
    "2025-07": ((7389, 8036, 9071, 858), (29.14, 31.7, 35.78, 3.38), (88.12, 78.26, 89.32, 69.46)),
    "2025-08": ((3853, 3272, 3313, 364), (35.67, 30.29, 30.67, 3.37), (88.84, 79.68, 86.93, 77.75)),
    "2025-09": ((2898, 1697, 2329, 199), (40.69, 23.82, 32.7, 2.79), (82.75, 73.48, 88.45, 65.83)),
    "2025-10": ((2379, 1749, 2024, 244), (37.2, 27.35, 31.64, 3.81), (86.55, 76.67, 88.98, 65.57)),
    "2025-11": ((2219, 1951, 1834, 150), (36.06, 31.7, 29.8, 2.44), (85.31, 77.65, 87.3, 52.67)),
    "2025-12": ((2329, 1568, 1689, 230), (40.04, 26.96, 29.04, 3.95), (89.7, 76.28, 89.58, 74.35)),
    "2026-01": ((2516, 1947, 2061, 327), (36.72, 28.42, 30.08, 4.77), (89.67, 75.5, 88.69, 77.06)),
    "2026-02": ((2966, 2044, 2271, 229), (39.49, 27.22, 30.24, 3.05), (89.21, 75.1, 87.45, 69.0)),
}
# Published totals and overall merge rates, in the order of AGENTS.
TOTALS = (43859, 26674, 37055, 8423)
OVERALL_RATES = (86.4, 77.5, 89.6, 66.5)


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(month, a, n, rate) for month, (ns, _, rates) in MONTHS.items() for a, n, rate in zip(AGENTS, ns, rates)]
    return spark.createDataFrame(rows, "month string, agent string, n long, rate double")


def test_shares_of_the_month(counts):
    wide = pivot_measure(share(counts, ["month"], "n", digits=2), "month", "agent", AGENTS, "share_pct")
    assert {r["month"]: tuple(r[a] for a in AGENTS) for r in wide.collect()} == {m: shares for m, (_, shares, _) in MONTHS.items()}


def test_totals(counts):
    totals = counts.groupBy("agent").agg(F.sum("n").alias("n"))
    got = {r["agent"]: r["n"] for r in with_total_row(totals, "agent", "ALL", ("n",)).collect()}
    assert got == dict(zip(AGENTS, TOTALS)) | {"ALL": 116011}


def test_weighted_rates(counts):
    weighted = counts.groupBy("agent").agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("r"))
    for row in weighted.collect():
        assert row["r"] == pytest.approx(OVERALL_RATES[AGENTS.index(row["agent"])], abs=0.06)


# Published (merged, total) of the agent and the human side, and the statistic.
@pytest.mark.parametrize("a,na,b,nb,chi2", [(97374, 116011, 98822, 116011, 69.12), (1367, 2620, 2261, 2620, 714.50)])
def test_sample_statistics(spark, a, na, b, nb, chi2):
    value = spark.range(1).select(chi_square_columns(F.lit(a), F.lit(na), F.lit(b), F.lit(nb))).first()[0]
    assert round(value, 2) == chi2
