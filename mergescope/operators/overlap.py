"""Agreement of two collections of keys: one tagged union and one aggregate, never two joined key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergescope.functions.numeric import percent, ratio


def tag(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of both tables with membership flags; keys with a NULL part never match and are left out."""
    key = list(key)
    flagged = [
        df.select(*key, F.lit(in_a).alias("in_a"), F.lit(in_b).alias("in_b")).dropna(subset=key)
        for df, in_a, in_b in ((a, True, False), (b, False, True))
    ]
    return flagged[0].unionByName(flagged[1]).groupBy(*key).agg(
        F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b")
    )


def overlap_counts(tagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tagged.groupBy(*by).agg(
        F.count_if("in_a").alias("a_keys"),
        F.count_if("in_b").alias("b_keys"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("overlap"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
        F.count(F.lit(1)).alias("union_keys"),
    )


def with_coverage(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Jaccard index and coverage of each side by the other."""
    return counts.withColumns(
        {
            "jaccard": ratio(F.col("overlap"), F.col("union_keys"), empty=0.0),
            "pct_of_a": percent(F.col("overlap"), F.col("a_keys"), digits),
            "pct_of_b": percent(F.col("overlap"), F.col("b_keys"), digits),
        }
    )


def overlap(a: DataFrame, b: DataFrame, key: str, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Overlap counts, Jaccard index and coverage both ways, for all keys or per group."""
    by = list(by)
    return with_coverage(overlap_counts(tag(a, b, [*by, key]), by), digits)


def dual_match(b: DataFrame, a: DataFrame, b_commits: DataFrame, a_commits: DataFrame, keys: Sequence[str],
               id_col: str = "id", pr_col: str = "pr_id", sha: str = "sha") -> DataFrame:
    """Ids of ``b`` that match ``a`` by the metadata keys or by a shared commit, as a union of two semi-joins."""
    keys = list(keys)
    by_keys = b.join(a.select(*keys), keys, "left_semi").select(id_col)
    by_sha = b_commits.join(a_commits.select(sha), sha, "left_semi").select(F.col(pr_col).alias(id_col))
    return by_keys.union(by_sha).distinct()


def agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How often two flags or labels of the same key agree, and in which direction boolean flags differ."""
    same = F.col(left).eqNullSafe(F.col(right))
    columns = [
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(same).alias("agree"),
        F.count_if(~same).alias("disagree"),
    ]
    if dict(pairs.dtypes)[left] == "boolean":
        columns += [
            F.count_if(F.col(left) & ~F.col(right)).alias("only_left_true"),
            F.count_if(~F.col(left) & F.col(right)).alias("only_right_true"),
        ]
    return pairs.agg(*columns).withColumn("agree_pct", percent(F.col("agree"), F.col("pairs")))
