"""Revision effort: what changed after a pull request's first commit.

Every step groups or joins on (pr_id, sha) or (pr_id, filename) and combines before its shuffle, so a pull request with
very many commits is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergescope.functions.numeric import pct_modification


def change_size(details: DataFrame) -> DataFrame:
    """Distinct files and line totals per pull request."""
    per_file = details.groupBy("pr_id", "filename").agg(
        F.sum("additions").alias("added"), F.sum("deletions").alias("deleted")
    )
    return per_file.groupBy("pr_id").agg(
        F.count("filename").alias("files_changed"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("deleted"), F.lit(0)).alias("lines_deleted"),
    )


def commits_per_pr(commits: DataFrame) -> DataFrame:
    return commits.groupBy("pr_id").agg(F.count(F.lit(1)).alias("num_commits"))


def first_commits(commits: DataFrame, order: Sequence[str]) -> DataFrame:
    """First commit and number of commits per pull request in the stated order."""
    return commits.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("num_commits"), F.min_by("sha", F.struct(*order)).alias("first_sha")
    )


def first_vs_rest(commits: DataFrame, details: DataFrame, order: Sequence[str], compat: bool = False) -> DataFrame:
    """Lines and files of the first commit and of the later ones, per pull request with details.

    By default a commit is first or later within its own pull request. ``compat`` instead treats a commit that is first
    in any pull request as first in all of them.
    """
    firsts = first_commits(commits, order).select("pr_id", F.col("first_sha").alias("sha"))
    mark = F.lit(True).alias("is_first")
    if compat:
        flagged = details.join(firsts.select("sha").distinct().select("sha", mark), "sha", "left")
    else:
        flagged = details.join(firsts.select("pr_id", "sha", mark), ["pr_id", "sha"], "left")
    first = F.coalesce(F.col("is_first"), F.lit(False))
    per_file = flagged.groupBy("pr_id", "filename").agg(
        F.bool_or(first).alias("in_first"),
        F.bool_or(~first).alias("in_rest"),
        F.sum(F.when(first, F.col("additions"))).alias("first_added"),
        F.sum(F.when(first, F.col("deletions"))).alias("first_deleted"),
        F.sum(F.when(~first, F.col("additions"))).alias("rest_added"),
        F.sum(F.when(~first, F.col("deletions"))).alias("rest_deleted"),
    )
    named = F.col("filename").isNotNull()
    zero = F.lit(0)
    return per_file.groupBy("pr_id").agg(
        F.bool_or("in_first").alias("has_first"),
        F.bool_or("in_rest").alias("has_rest"),
        F.count_if(F.col("in_first") & named).alias("init_files"),
        F.coalesce(F.sum("first_added"), zero).alias("init_added"),
        F.coalesce(F.sum("first_deleted"), zero).alias("init_deleted"),
        F.count_if(F.col("in_rest") & named).alias("rev_files"),
        F.coalesce(F.sum("rest_added"), zero).alias("rev_lines_added"),
        F.coalesce(F.sum("rest_deleted"), zero).alias("rev_lines_deleted"),
    )


def revision_effort(commits: DataFrame, details: DataFrame, order: Sequence[str], missing: str = "zero",
                    compat: bool = False) -> DataFrame:
    """Number of commits and revision lines per pull request.

    A pull request without revision details counts as zero lines, or is left out with ``missing='drop'``.
    """
    if missing not in ("zero", "drop"):
        raise ValueError(f"missing must be 'zero' or 'drop', not {missing!r}")
    sizes = first_vs_rest(commits, details, order, compat).where("has_rest")
    joined = commits_per_pr(commits).join(
        sizes.select("pr_id", "rev_files", "rev_lines_added", "rev_lines_deleted", "init_added", "init_deleted", "has_first"),
        "pr_id", "left" if missing == "zero" else "inner",
    )
    return joined.na.fill(0, ["rev_files", "rev_lines_added", "rev_lines_deleted"]).withColumn(
        "pct_modification",
        F.when(
            F.col("has_first"),
            pct_modification(
                F.col("rev_lines_added") + F.col("rev_lines_deleted"), F.col("init_added") + F.col("init_deleted")
            ),
        ),
    ).drop("init_added", "init_deleted", "has_first")
