"""Exact-size samples without replacement, the same on every run.

Rows are ordered by a hash of their id. The hash that closes each stratum's sample is found from counts per hash
prefix, then every row is kept or dropped by comparing its own hash: nothing is sorted or limited as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergescope.config import SEED
from mergescope.operators.joins import attach_few

PREFIX = 4  # hex digits: at most 65,536 prefixes per stratum


def draw_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def sample_strata(pool: DataFrame, strata: Sequence[str], targets: DataFrame | Column, id_col: str, seed: int = SEED) -> DataFrame:
    """Rows of ``pool``: in each stratum the wanted number, or all when the pool is short.

    ``targets`` is a (strata..., target) table, or one number as a column when there are no strata. Strata without a
    target give no rows. ``id_col`` must identify the rows of the pool.
    """
    strata = list(strata)
    keyed = pool.withColumn("draw__", draw_key(id_col, seed)).withColumn("prefix__", F.substring("draw__", 1, PREFIX))
    running = Window.partitionBy(*strata).orderBy("prefix__").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        keyed.groupBy(*strata, "prefix__")
        .agg(F.count(F.lit(1)).alias("n__"))
        .withColumn("upto__", F.sum("n__").over(running))
    )
    counts = counts.withColumn("target__", targets.cast("long")) if isinstance(targets, Column) else counts.join(
        targets.withColumnRenamed("target", "target__"), strata
    )
    reached = F.col("upto__") >= F.col("target__")
    before = F.col("upto__") - F.col("n__")
    edge = counts.where(reached & (before < F.col("target__"))).select(
        *strata, "prefix__", (F.col("target__") - before).alias("need__")
    )
    nth = Window.partitionBy(*strata, "prefix__").orderBy("draw__")
    cuts = (
        keyed.select(*strata, "prefix__", "draw__")
        .join(edge, [*strata, "prefix__"])
        .withColumn("rank__", F.row_number().over(nth))
        .where(F.col("rank__") == F.col("need__"))
        .groupBy(*strata)
        .agg(F.max("draw__").alias("cut__"))
    )
    if not strata:
        limit = cuts.select("cut__").scalar()
        # No cut exists when the target is zero or the pool is short.
        kept = keyed.where(F.when(targets <= 0, F.lit(False)).otherwise(F.col("draw__") <= F.coalesce(limit, F.lit("g"))))
    else:
        wanted = targets.where(F.col("target") > 0).select(*strata).join(cuts, strata, "left")
        # The rows stay where they are when the strata are few enough to broadcast.
        kept = attach_few(keyed, wanted, strata, "draw__", targets).where(F.col("draw__") <= F.coalesce(F.col("cut__"), F.lit("g")))
    return kept.select(*pool.columns)


def sample_n(df: DataFrame, n: int | Column, id_col: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows, or all of a smaller table."""
    return sample_strata(df, [], n if isinstance(n, Column) else F.lit(n), id_col, seed)


def stratum_sizes(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("target"))


def matched(cohort: DataFrame, pool: DataFrame, strata: Sequence[str], id_col: str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """A sample of the pool with the cohort's size in every stratum, and the shortfall per stratum."""
    strata = list(strata)
    if not strata:
        size = cohort.agg(F.count(F.lit(1)).alias("target"))
        picked = sample_n(pool, size.scalar(), id_col, seed)
        report = size.withColumn("available", pool.agg(F.count(F.lit(1))).scalar())
    else:
        size = stratum_sizes(cohort, strata)
        picked = sample_strata(pool, strata, size, id_col, seed)
        available = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
        report = size.join(available, strata, "left").na.fill(0, ["available"])
    short = F.greatest(F.col("target") - F.col("available"), F.lit(0))
    return picked, report.withColumn("shortfall", short)
