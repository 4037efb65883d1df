"""Joins on keys of which a few may hold much of a table.

Heavy keys are found by a frequent-items sketch: every task counts into a sketch of fixed size, sketches are merged, and
what comes out is a list of at most twice as many keys as there are shuffle tasks. Rows of these keys are dealt over all
tasks, and the other side's row of such a key is repeated for each of them; all other keys are joined plainly. The list is
a scalar subquery, so it is part of the plan and no job runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, on: Sequence[str], share: float | None = None) -> DataFrame:
    """One row with `heavy`: hashes of the keys that hold at least the given share of the rows.

    The default share is half of an even shuffle task's. The sketch tracks eight times as many keys as can hold that share,
    so its error is below it: no heavier key is missed, and keys somewhat lighter may be listed too.
    """
    share = share or 1 / (2 * _tasks(df))
    most = max(1, round(1 / share))
    tracked = 1 << max(5, (8 * most - 1).bit_length())
    found = df.select(F.xxhash64(*on).alias("key")).agg(
        F.expr(f"approx_top_k(key, {most}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    heavy = F.filter("top", lambda x: x["count"] >= F.col("rows") * share)
    return found.select(F.transform(heavy, lambda x: x["item"]).alias("heavy"))


def split_join(df: DataFrame, single: DataFrame, on: Sequence[str], how: str = "left", spread_by: Sequence[str] | None = None) -> DataFrame:
    """Join to a table with one row per key, with the rows of heavy keys spread over all shuffle tasks.

    Rows are spread by a hash of the stated columns, or of all, so a retried task deals them out as before; NULL keys match
    nothing and are spread like any other. The result has the rows of the plain join.
    """
    on, tasks = list(on), _tasks(df)
    heavy = heavy_keys(df, on)

    def is_heavy() -> Column:
        return F.array_contains(heavy.scalar(), F.xxhash64(*on))

    columns = spread_by or [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    salt = F.when(is_heavy(), F.pmod(F.xxhash64(F.lit(tasks), *columns), F.lit(tasks)).cast("int")).otherwise(0)
    salts = F.when(is_heavy(), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    left = df.withColumn("salt__", salt)
    right = single.withColumn("salts__", salts).withColumn("salt__", F.explode("salts__")).drop("salts__")
    return left.join(right, [*on, "salt__"], how).drop("salt__")
