"""Exact quantiles, box statistics and histograms that no single task has to hold.

``percentile`` keeps every distinct value of a group in one task. Here the group is first reduced to value counts,
spread over (group, value); counts per order-preserving cell locate the few cells that contain the wanted ranks, and
only the values of those cells are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergescope.config import HISTOGRAM_BINS
from mergescope.functions.numeric import order_cell
from mergescope.operators.joins import attach_groups


def value_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, metric, value, rows) of several numeric columns; NULL and NaN values and NULL group keys are left out."""
    stacked = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        df.dropna(subset=list(by))
        .select(*by, F.inline(stacked))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*by, "metric", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def rows_of(metric: str, condition: Column | None = None) -> Column:
    """Aggregate over value counts: the rows of one metric, of those values that meet the condition."""
    wanted = F.col("metric") == metric
    if condition is not None:
        wanted = wanted & condition
    return F.coalesce(F.sum(F.when(wanted, F.col("rows"))), F.lit(0).cast("long"))


def quantiles(df: DataFrame, by: Sequence[str], **wanted: tuple[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles: ``quantiles(df, by, median_h=("hours", 0.5))``.

    Groups whose columns hold no value are absent; join the result to the group list.
    """
    columns = sorted({column for column, _ in wanted.values()})
    return quantiles_of_counts(value_counts(df, by, columns), by, **wanted)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], **wanted: tuple[str, float]) -> DataFrame:
    """Quantiles from value counts that other results share."""
    by = list(by)
    counts = counts.withColumn("cell", order_cell(F.col("value")))

    group = [*by, "metric"]
    ordered = Window.partitionBy(*group).orderBy("cell")
    asks = F.array(
        *[
            F.struct(F.lit(alias).alias("ask"), F.lit(column).alias("of"), F.lit(float(q)).alias("q"))
            for alias, (column, q) in wanted.items()
        ]
    )
    spot = F.col("q") * (F.col("total") - 1)
    targets = (
        counts.groupBy(*group, "cell")
        .agg(F.sum("rows").alias("in_cell"))
        .withColumn("upto", F.sum("in_cell").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("total", F.sum("in_cell").over(Window.partitionBy(*group)))
        .select("*", F.inline(asks))
        .where(F.col("of") == F.col("metric"))
        .withColumns({"low": F.floor(spot), "high": F.ceil(spot), "part": spot - F.floor(spot)})
        .withColumn("before", F.col("upto") - F.col("in_cell"))
        .where((F.col("upto") > F.col("low")) & (F.col("before") <= F.col("high")))
        .select(*group, "cell", "ask", "low", "high", "part", "before")
    )

    inside = Window.partitionBy(*group, "ask", "cell").orderBy("value")
    hits = counts.join(targets, [*group, "cell"]).withColumn(
        "end", F.col("before") + F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )

    def at(alias: str, rank: str) -> Column:
        here = (F.col("ask") == alias) & (F.col(rank) < F.col("end")) & (F.col(rank) >= F.col("end") - F.col("rows"))
        return F.max(F.when(here, F.col("value")))

    picked = hits.groupBy(*by).agg(
        *[at(alias, rank).alias(f"{alias}__{rank}") for alias in wanted for rank in ("low", "high")],
        *[F.max(F.when(F.col("ask") == alias, F.col("part"))).alias(f"{alias}__part") for alias in wanted],
    )

    def interpolated(alias: str) -> Column:
        low, high = F.col(f"{alias}__low"), F.col(f"{alias}__high")
        return (low + (high - low) * F.col(f"{alias}__part")).alias(alias)

    return picked.select(*by, *[interpolated(alias) for alias in wanted])


def approximate_quantiles(df: DataFrame, by: Sequence[str], accuracy: int = 10_000, **wanted: tuple[str, float]) -> DataFrame:
    """Single-shuffle quantiles within a stated rank error, for exploratory use."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(column, q, accuracy).cast("double").alias(alias) for alias, (column, q) in wanted.items()]
    )


def clip_at_quantile(df: DataFrame, by: Sequence[str], column: str, q: float, alias: str) -> DataFrame:
    """Add the column bounded by its own group's upper quantile."""
    bounds = quantiles(df, by, bound__=(column, q))
    capped = F.when(F.col(column) > F.col("bound__"), F.col("bound__")).otherwise(F.col(column))
    # Spread by the whole row: one value may be very frequent.
    return attach_groups(df, bounds, by, df.columns, "left").withColumn(alias, capped).drop("bound__")


def box_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Quartiles, the extreme values inside 1.5 IQR of the box, and the number of values outside."""
    by = list(by)
    counts = value_counts(df, by, [column])
    boxes = quantiles_of_counts(counts, by, q1=(column, 0.25), median=(column, 0.5), q3=(column, 0.75))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    x, rows = F.col("value"), F.col("rows")
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach_groups(counts, boxes, by, "value")
        .groupBy(*by)
        .agg(
            F.sum(rows).alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(rows)).alias("outliers"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Row counts of equal-width bins over [min, max]; the last bin holds the maximum.

    Works on value counts, so the range lookup joins distinct values, not rows.
    """
    by = list(by)
    counts = value_counts(df, by, [column]).drop("metric")
    if by:
        limits = counts.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        ranged = attach_groups(counts, limits, by, "value")
    else:
        ranged = counts.withColumns(
            {"low": counts.agg(F.min("value")).scalar(), "high": counts.agg(F.max("value")).scalar()}
        )
    # A constant column is drawn in a range of one around its value.
    flat = F.col("low") == F.col("high")
    low = F.when(flat, F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))
    width = (high - low) / F.lit(float(bins))
    index = F.least(F.floor((F.col("value") - low) / width).cast("int"), F.lit(bins - 1))
    return (
        ranged.withColumns({"bin": index, "bin_low": low + index * width, "bin_high": low + (index + 1) * width})
        .groupBy(*by, "bin", "bin_low", "bin_high")
        .agg(F.sum("rows").alias("rows"))
    )
