"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergescope.config import SHA_BATCH_SIZE
from mergescope.operators.joins import first_known

PREFIX = 4  # hex digits


def hashed_row_number(df: DataFrame, by: Sequence[str], id_col: str, alias: str, salt: str = "") -> DataFrame:
    """Number the rows of each group from one, in the order of a hash of their id.

    Counts per hash prefix give each prefix its offset, and rows are ordered only inside (group, prefix), so a group
    holding much of the table is numbered by many tasks.
    """
    by = list(by)
    keyed = df.withColumn("hash__", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(salt)))).withColumn(
        "prefix__", F.substring("hash__", 1, PREFIX)
    )
    earlier = Window.partitionBy(*by).orderBy("prefix__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "prefix__")
        .agg(F.count(F.lit(1)).alias("n__"))
        .withColumn("offset__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)))
        .drop("n__")
    )
    inside = Window.partitionBy(*by, "prefix__").orderBy("hash__", id_col)
    return (
        keyed.join(offsets, [*by, "prefix__"])
        .withColumn(alias, F.col("offset__") + F.row_number().over(inside))
        .select(*df.columns, alias)
    )


def sha_batches(commits: DataFrame, prs: DataFrame, order: Sequence[str], size: int = SHA_BATCH_SIZE) -> DataFrame:
    """Work list (repo, sha, batch): each commit once, under the first pull request whose repository is known."""
    links = commits.select("sha", "pr_id", *[c for c in order if c not in ("sha", "pr_id")])
    repos = first_known(links, prs.select(F.col("id").alias("pr_id"), "repo_name"), "pr_id", "sha", "repo_name", order)
    numbered = hashed_row_number(repos, ["repo_name"], "sha", "position")
    batch = F.floor((F.col("position") - 1) / F.lit(size)).cast("long")
    return numbered.select("repo_name", "sha", batch.alias("batch"))


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
