"""Grouped aggregates: counts, rates, outcome tables, pivots, margins and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergescope.functions.numeric import percent
from mergescope.operators.filters import min_size

def is_merged() -> Column:
    return F.col("is_merged")


def value_totals(df: DataFrame, column: str, alias: str = "n") -> DataFrame:
    """Rows per value, NULL values left out, largest first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(alias))
    return counted.orderBy(F.desc(alias), column)


def sum_or_zero(column: Column) -> Column:
    """Sum that is zero for a group without values."""
    return F.coalesce(F.sum(column), F.lit(0).cast("long"))


def distinct_count(df: DataFrame, by: Sequence[str], column: str, alias: str) -> DataFrame:
    """Exact distinct values per group in two combined steps, so a hot group spreads over its values."""
    by = list(by)
    values = df.where(F.col(column).isNotNull()).select(*by, column).distinct()
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias(alias))


#: Log2 of a sketch's cells; the standard error of its estimate is about 1.04 / sqrt(cells).
SKETCH_CELLS = 12


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str, cells: int = SKETCH_CELLS) -> DataFrame:
    """A sketch of each group's distinct values, of fixed size; sketches of finer groups add up to those of coarser ones."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(column, cells).alias("sketch"))


def sketched_count(sketches: DataFrame, by: Sequence[str], alias: str) -> DataFrame:
    """Estimated distinct values per coarser group from stored sketches, without the rows they were made from."""
    merged = F.hll_union_agg("sketch")
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(merged).alias(alias))


def outcome_columns(flag: Column | None = None) -> list[Column]:
    flag = is_merged() if flag is None else flag
    return [F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("merged")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Rejected count and acceptance rate of (total, merged)."""
    return counts.withColumns(
        {"rejected": F.col("total") - F.col("merged"), "acceptance_rate": percent(F.col("merged"), F.col("total"))}
    )


def acceptance(df: DataFrame, by: str, overall: str | None = None, flag: Column | None = None) -> DataFrame:
    """Outcome counts and acceptance rate per group, with an overall row when a label is stated.

    The overall row is rolled up from the groups' counts; rates are computed after, never averaged.
    """
    kept = df.where(F.col(by).isNotNull())
    per_group = kept.groupBy(by).agg(*outcome_columns(flag))
    if overall is None:
        return with_rates(per_group)
    return with_rates(with_total_row(per_group, by, overall, ("total", "merged")))


def with_total_row(counts: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """Append one row that sums the count columns over all keys."""
    rolled = counts.rollup(key).agg(
        F.grouping(key).alias("is_total__"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]
    )
    return rolled.withColumn(key, F.when(F.col("is_total__") == 1, F.lit(label)).otherwise(F.col(key))).drop("is_total__")


def grouped_rate(df: DataFrame, by: Sequence[str], flag: Column | None = None, min_rows: int = 0) -> DataFrame:
    """Counts and rate over several keys, the rate NULL below a minimum size."""
    flag = is_merged() if flag is None else flag
    kept = df.where(all_known(by))
    rate = percent(F.count_if(flag), F.count(F.lit(1)))
    return kept.groupBy(*by).agg(*outcome_columns(flag), min_size(rate, min_rows).alias("rate"))


def all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str], fill: int | None = 0) -> DataFrame:
    """Row counts with one column per listed value."""
    kept = df.where(all_known([row, column]))
    wide = kept.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    if fill is None:
        return wide.select(row, *[F.nullif(F.col(v), F.lit(0)).alias(v) for v in values])
    return wide


def most_common(df: DataFrame, column: str, most: int) -> list:
    """The most common values of a column by exact counts, at most so many; ties fall to the smaller value."""
    return [r[0] for r in value_totals(df, column).limit(most).collect()]


def pivot_common(df: DataFrame, row: str, column: str, most: int, unlisted: str = "Unlisted", total: str = "Total") -> DataFrame:
    """Row counts with one column for each of the most common values, one for all others, and one for their sum.

    A column's values may be very many; how wide the table gets is stated by the caller.
    """
    kept = df.where(all_known([row, column]))
    values = most_common(kept, column, most)
    rest = ~F.col(column).isin(*values) if values else F.lit(True)
    return kept.groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(str(v)) for v in values], F.count_if(rest).alias(unlisted), F.count(F.lit(1)).alias(total)
    )


def pivot_measure(df: DataFrame, row: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """Spread an already grouped measure, one column per listed value, NULL where a group is absent."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(measure))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], margin: str = "Total") -> DataFrame:
    """Contingency counts with a margin row and a margin column; values that are not listed count as Unlisted."""
    wide = df.where(all_known([row, column])).groupBy(row).agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in values],
        F.count_if(~F.col(column).isin(*values)).alias("Unlisted"), F.count(F.lit(1)).alias(margin),
    )
    return with_total_row(wide, row, margin, [*values, "Unlisted", margin])


def share(df: DataFrame, part: Sequence[str], count: str, alias: str = "share_pct", digits: int | None = None) -> DataFrame:
    """Each row's percentage of its partition's sum; input is already grouped, so the window is small."""
    whole = F.sum(count).over(Window.partitionBy(*part))
    return df.withColumn(alias, percent(F.col(count), whole, digits))


def share_of_all(df: DataFrame, count: str, alias: str = "percentage", digits: int | None = None) -> DataFrame:
    """Each row's percentage of the grand total, taken as a scalar subquery."""
    return df.withColumn(alias, percent(F.col(count), df.agg(F.sum(count)).scalar(), digits))


def period_change(df: DataFrame, by: str, period: str, measure: str, first: str, second: str) -> DataFrame:
    """Measure in two periods side by side and the change in points."""
    wide = df.groupBy(by).agg(
        F.max(F.when(F.col(period) == first, F.col(measure))).alias(first),
        F.max(F.when(F.col(period) == second, F.col(measure))).alias(second),
    )
    return wide.withColumn("change_pp", F.col(second) - F.col(first))


def top_k(df: DataFrame, by: str, k: int, *extra: Column) -> DataFrame:
    """The k largest groups with further measures from the same pass; ties fall to the smaller key."""
    counted = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("total"), *extra)
    return counted.orderBy(F.desc("total"), by).limit(k)


def work_list(wanted: DataFrame, done: DataFrame, key: str, alias: str = "expected") -> DataFrame:
    """Keys not yet done, with the number of wanted rows, most first."""
    return value_totals(wanted.join(done.select(key), key, "left_anti"), key, alias)
