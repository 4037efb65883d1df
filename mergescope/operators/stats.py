"""Two-group significance tests from value counts.

Ranks and at-risk counts come from prefix sums in two levels: over order-preserving cells per comparison, a bounded
number of rows, and over the values inside one cell. No window spans a whole comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergescope.functions.numeric import chi_square_p, normal_two_sided_p, order_cell, ratio, stars

# Both samples above this size, or any tie, select the normal approximation of the U test.
EXACT_SAMPLE = 8


def chi_square_columns(hit_a: Column, total_a: Column, hit_b: Column, total_b: Column, yates: bool = True) -> Column:
    """Chi-square statistic of a 2x2 table given by hits and totals; NULL when an expected count is zero."""
    a, b = hit_a.cast("double"), hit_b.cast("double")
    na, nb = total_a.cast("double"), total_b.cast("double")
    n = na + nb
    statistic = None
    for observed, rows, columns in (
        (a, na, a + b), (na - a, na, n - a - b), (b, nb, a + b), (nb - b, nb, n - a - b),
    ):
        expected = rows * columns / n
        gap = F.abs(observed - expected)
        if yates:
            gap = gap - F.least(F.lit(0.5), gap)
        term = F.try_divide(gap * gap, expected)
        statistic = term if statistic is None else statistic + term
    return F.when(n > 0, statistic)


def chi_square(
    df: DataFrame, by: Sequence[str], side: Column, flag: Column, yates: bool = True, need_all_cells: bool = False
) -> DataFrame:
    """Test of a rate between two sides: counts, rates, statistic, p and stars from one conditional aggregate.

    ``side`` is true for the first group and false for the second; rows where it is NULL are left out.
    """
    counts = df.groupBy(*by).agg(
        F.count_if(side & flag).alias("hit_a"),
        F.count_if(side).alias("total_a"),
        F.count_if(~side & flag).alias("hit_b"),
        F.count_if(~side).alias("total_b"),
    )
    return _tested_rates(counts, yates, need_all_cells)


def _tested_rates(counts: DataFrame, yates: bool, need_all_cells: bool = False) -> DataFrame:
    cells = [F.col("hit_a"), F.col("total_a") - F.col("hit_a"), F.col("hit_b"), F.col("total_b") - F.col("hit_b")]
    statistic = chi_square_columns(F.col("hit_a"), F.col("total_a"), F.col("hit_b"), F.col("total_b"), yates)
    if need_all_cells:
        statistic = F.when(F.least(*cells) > 0, statistic)
    return (
        counts.withColumns(
            {
                "rate_a": ratio(F.col("hit_a"), F.col("total_a")) * 100,
                "rate_b": ratio(F.col("hit_b"), F.col("total_b")) * 100,
                "chi2": statistic,
            }
        )
        .withColumn("p", chi_square_p(F.col("chi2")))
        .withColumn("sig", stars(F.col("p")))
    )


def _before(window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(_before(window)), F.lit(0).cast("long"))


def exact_u_p(extreme: Column, n1: Column, n2: Column) -> Column:
    """Two-sided permutation p of the larger U, for untied samples.

    The ways to get each U are the coefficients of a product over the smaller sample: of (1 - q^(n+i)) / (1 - q^i) for i
    from 1 to its size, n being the larger one's. It is folded over i, and a division is a doubling: adding an array to
    itself moved on by i, 2i, 4i and so on adds up every i-th term. Only the coefficients of the lower tail are kept, which
    by symmetry has the weight of the upper one; none of them depends on later ones, so nothing large is taken from nothing
    small.
    """
    m, n = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    last = F.floor(n1.cast("double") * n2.cast("double") - extreme).cast("int")
    size = last + 1

    def moved(ways: Column, by: Column) -> Column:
        step = F.least(by, size)
        return F.concat(F.array_repeat(F.lit(0.0), step), F.slice(ways, F.lit(1), size - step))

    def grown(ways: Column, i: Column) -> Column:
        less = F.zip_with(ways, moved(ways, n + i), lambda w, v: w - v)
        doublings = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(last, F.lit(1)))).cast("int"))
        return F.aggregate(doublings, less, lambda w, k: F.zip_with(w, moved(w, F.least(i * F.pow(F.lit(2.0), k), size.cast("double")).cast("int")), lambda x, y: x + y))

    one = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), last))
    tail = F.aggregate(F.aggregate(F.sequence(F.lit(1), m), one, grown), F.lit(0.0), lambda total, w: total + w)
    choices = F.aggregate(F.sequence(F.lit(1), m), F.lit(1.0), lambda c, i: c * (n + i) / i)
    return F.least(F.lit(1.0), 2 * tail / choices)


def mann_whitney(df: DataFrame, by: Sequence[str], side: Column, x: str, exact_small: bool = True) -> DataFrame:
    """U of the first side with mid-ranks, tie-corrected z, two-sided p and stars.

    When one sample has at most eight values and there are no ties, however large the other is, p is the permutation value;
    ``method`` says how each row's p was computed. Without ``exact_small`` all are the normal approximation.
    """
    by = list(by)
    counts = (
        df.select(*by, side.alias("side"), F.col(x).cast("double").alias("value"))
        .where(F.col("side").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "value")
        .agg(F.count_if("side").alias("n1"), F.count_if(~F.col("side")).alias("n2"))
    )
    return mann_whitney_counts(counts, by, exact_small)


def mann_whitney_counts(counts: DataFrame, by: Sequence[str], exact_small: bool = True) -> DataFrame:
    """The U test from (by, value, n1, n2), one row per distinct value."""
    by = list(by)
    celled = counts.withColumn("cell", order_cell(F.col("value")))
    below = _sum_before("n2", Window.partitionBy(*by, "cell").orderBy("value"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    tied = n1 + n2
    cells = (
        celled.withColumn("below", below)
        .groupBy(*by, "cell")
        .agg(
            F.sum(n1 * (F.col("below") + n2 / 2)).alias("u_inside"),
            F.sum(tied * tied * tied - tied).alias("ties"),
            F.sum("n1").alias("n1"),
            F.sum("n2").alias("n2"),
        )
        .withColumn("below", _sum_before("n2", Window.partitionBy(*by).orderBy("cell")))
    )
    sums = cells.groupBy(*by).agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.sum(F.col("u_inside") + F.col("n1").cast("double") * F.col("below")).alias("u"),
        F.sum("ties").alias("ties"),
    )
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = a + b
    spread = F.sqrt(a * b / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    extreme = F.greatest(F.col("u"), a * b - F.col("u"))
    tested = (
        sums.where((F.col("n1") > 0) & (F.col("n2") > 0))
        .withColumn("z", F.try_divide(extreme - a * b / 2 - F.lit(0.5), spread))
        # Samples that hold one common value only have no spread and do not differ.
        .withColumn("p", F.coalesce(normal_two_sided_p(F.col("z")), F.lit(1.0)))
    )
    tiny = F.lit(exact_small) & (F.least("n1", "n2") <= EXACT_SAMPLE) & (F.col("ties") == 0)
    tested = tested.withColumns(
        {"p": F.when(tiny, exact_u_p(extreme, F.col("n1"), F.col("n2"))).otherwise(F.col("p")), "method": F.when(tiny, "exact").otherwise("normal")}
    )
    return tested.withColumn("sig", stars(F.col("p")))


def pair_counts(counts: DataFrame, group: str, pairs: Sequence[tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Value counts of named comparisons: (by, metric, comparison, value, n1, n2) from (by, group, metric, value, rows).

    Each pair is (name, first group, second group). Only counts are repeated, once per pair a group takes part in.
    """
    member = F.col(group)
    roles = F.array(
        *[
            F.struct(F.lit(name).alias("comparison"), (member == a).alias("is_first"), (member == b).alias("is_second"))
            for name, a, b in pairs
        ]
    )
    taking_part = F.filter(roles, lambda r: r["is_first"] | r["is_second"])
    rows = counts.select(*by, "metric", F.inline(taking_part), "value", "rows")
    nothing = F.lit(0).cast("long")
    return rows.groupBy(*by, "metric", "comparison", "value").agg(
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("rows"))), nothing).alias("n1"),
        F.coalesce(F.sum(F.when(F.col("is_second"), F.col("rows"))), nothing).alias("n2"),
    )


def chi_square_of_counts(pairs: DataFrame, by: Sequence[str], metric: str, yates: bool = True) -> DataFrame:
    """The rate test from (by, metric, value, n1, n2) of a flag metric whose value is one or zero.

    The metric is picked inside the sums: a filter would be pushed below the shared value counts and split their shuffle.
    """
    wanted = F.col("metric") == metric
    hit = wanted & (F.col("value") == 1.0)

    def total(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    counts = pairs.groupBy(*by).agg(
        total(hit, "n1").alias("hit_a"), total(wanted, "n1").alias("total_a"),
        total(hit, "n2").alias("hit_b"), total(wanted, "n2").alias("total_b"),
    )
    return _tested_rates(counts, yates)


def log_rank(df: DataFrame, by: Sequence[str], side: Column, duration: str, event: Column) -> DataFrame:
    """Two-group log-rank test: observed and expected events of the first side, statistic, p and stars."""
    by = list(by)
    counts = (
        df.select(*by, side.alias("side"), F.col(duration).cast("double").alias("value"), event.alias("event"))
        .where(F.col("side").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "value")
        .agg(
            F.count_if("side").alias("n1"),
            F.count_if(~F.col("side")).alias("n2"),
            F.count_if(F.col("side") & F.col("event")).alias("d1"),
            F.count_if(F.col("event")).alias("d"),
        )
        .withColumn("cell", order_cell(F.col("value")))
    )
    per_cell = counts.groupBy(*by, "cell").agg(F.sum("n1").alias("c1"), F.sum("n2").alias("c2"))
    # A suffix sum over cells: everyone whose duration falls in this cell or later.
    later = Window.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    staying = per_cell.select(*by, "cell", F.sum("c1").over(later).alias("s1"), F.sum("c2").over(later).alias("s2"))
    inside = Window.partitionBy(*by, "cell").orderBy("value")
    at_risk = (
        counts.withColumns({"gone1": _sum_before("n1", inside), "gone2": _sum_before("n2", inside)})
        .where(F.col("d") > 0)
        .join(staying, [*by, "cell"])
        .withColumns(
            {
                "r1": (F.col("s1") - F.col("gone1")).cast("double"),
                "r2": (F.col("s2") - F.col("gone2")).cast("double"),
            }
        )
    )
    d, r1, r2 = F.col("d").cast("double"), F.col("r1"), F.col("r2")
    r = r1 + r2
    variance = F.coalesce(F.try_divide(d * (r1 / r) * (r2 / r) * (r - d), r - 1), F.lit(0.0))
    # Totals come from all durations, also those without an event.
    sizes = per_cell.groupBy(*by).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    sums = at_risk.groupBy(*by).agg(
        F.sum("d1").alias("observed"),
        F.sum(d * r1 / r).alias("expected"),
        F.sum(variance).alias("variance"),
    )
    gap = F.col("observed") - F.col("expected")
    joined = sizes.join(sums, by, "left") if by else sums.withColumns(
        {"n1": sizes.select("n1").scalar(), "n2": sizes.select("n2").scalar()}
    )
    return (
        joined.withColumn("chi2", F.try_divide(gap * gap, F.col("variance")))
        .withColumn("p", chi_square_p(F.col("chi2")))
        .withColumn("sig", stars(F.col("p")))
    )
