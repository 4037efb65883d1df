"""Join shapes the analyses use; physical strategy is left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.operators.filters import after_end_of, within_range_of
from mergescope.operators.hotkeys import split_join

BROADCAST_ROWS = 50_000


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first_non_null: bool = False) -> DataFrame:
    """One row per key, the first in the stated order.

    An aggregate, so candidates are combined before the shuffle and a hot key never sits in one sorted window. With
    ``first_non_null`` every column takes its own first value that is not NULL.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    if first_non_null:
        picks = [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
        return df.groupBy(*keys).agg(*picks)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("row__"))
    return best.select(*keys, "row__.*").select(*df.columns)


def lookup(
    df: DataFrame, dimension: DataFrame, on: Sequence[str], order: Sequence[Column], defaults: Mapping[str, object] | None = None,
    split_hot: bool = True,
) -> DataFrame:
    """Left join to a dimension reduced to one row per key; later rows in the order win, as in a dictionary.

    Keys that hold much of the table are split over tasks, unless ``split_hot`` is off because no key can.
    """
    on = list(on)
    rest = [c for c in dimension.columns if c not in on]
    unique = (
        dimension.groupBy(*on).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row__")).select(*on, "row__.*")
    )
    joined = split_join(df, unique, on) if split_hot else df.join(unique, on, "left")
    return joined if defaults is None else joined.na.fill(dict(defaults))


def membership(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str, split_hot: bool = True) -> DataFrame:
    """Add a boolean column telling whether the row's key occurs in the other table; heavy keys as in ``lookup``."""
    on = list(on)
    known = keys.select(*on).distinct().withColumn("member__", F.lit(True))
    joined = split_join(df, known, on) if split_hot else df.join(known, on, "left")
    return joined.withColumn(flag, F.col("member__").isNotNull()).drop("member__")


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Rename every column that is not a key."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def paired(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], order: Sequence[str],
           prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Rows of two tables with the same key side by side, each table first reduced to one row per key."""
    sides = []
    for df, prefix in zip((a, b), prefixes):
        ranked = keep_first(df.select(key, *columns, *[c for c in order if c not in columns]), [key], [F.col(c) for c in order])
        sides.append(prefixed(ranked.select(key, *columns), [key], prefix))
    return sides[0].join(sides[1], key)


def in_shared_repos(df: DataFrame, other: DataFrame, repo: str = "repo_name") -> DataFrame:
    return df.join(other.select(repo), repo, "left_semi")


def scope(a: DataFrame, b: DataFrame, repo: str = "repo_name", ts: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the repositories they share, and the first one to the second one's time range."""
    return within_range_of(in_shared_repos(a, b, repo), b, ts), in_shared_repos(b, a, repo)


def rest_period(a: DataFrame, b: DataFrame, repos: DataFrame, until: str | None = None, repo: str = "repo_name",
                ts: str = "created_at") -> DataFrame:
    """Rows of ``a`` in the given repositories after the last instant of ``b``."""
    return after_end_of(in_shared_repos(a, repos, repo), b, ts, until)


def outer_counts(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Full outer alignment of per-key counts, absent counts as zero."""
    joined = frames[0]
    for frame in frames[1:]:
        joined = joined.join(frame, list(key), "outer")
    return joined.na.fill(0, [c for c in joined.columns if c not in key])


def attach_groups(df: DataFrame, groups: DataFrame, on: Sequence[str], spread_by: str | Sequence[str], how: str = "inner",
                  salts: int | None = None) -> DataFrame:
    """Join one row per group to all rows of the group.

    The few group rows are repeated per salt and the many rows take theirs from a hash, so a group that holds much of the
    table is shared by many tasks, also when an aggregate on the group follows. There are as many salts as shuffle tasks
    unless stated.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    salted = groups.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = df.withColumn("salt__", F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*on, "salt__"], how).drop("salt__")


def attach_few(df: DataFrame, groups: DataFrame, on: Sequence[str], spread_by: str, keys: DataFrame) -> DataFrame:
    """``attach_groups`` that leaves the rows in place when the group list is known to be short.

    ``keys`` holds at least the groups' keys and is cheap to count; up to BROADCAST_ROWS of them are broadcast.
    """
    if keys.select(*on).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(groups), list(on))
    return attach_groups(df, groups, on, spread_by)


def fan_out(commit_rows: DataFrame, holders: DataFrame, sha: str = "sha", pr: str = "pr_id") -> DataFrame:
    """Repeat each commit's rows for every pull request that holds the commit; unknown commits keep a NULL id.

    An inner join and the rows it leaves out, because only an inner join can be split on both sides when one commit is
    held by very many pull requests.
    """
    held = holders.select(sha, pr).distinct()
    columns = commit_rows.columns if pr in commit_rows.columns else [*commit_rows.columns, pr]
    rows = commit_rows.drop(pr)
    unknown = rows.join(held.select(sha), sha, "left_anti").withColumn(pr, F.lit(None).cast(dict(holders.dtypes)[pr]))
    return rows.join(held, sha).select(*columns).unionByName(unknown)


def first_known(links: DataFrame, dimension: DataFrame, on: str, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Per key, the value of the first linked row that has one."""
    known = links.join(dimension.select(on, value).where(F.col(value).isNotNull()), on)
    return known.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))
