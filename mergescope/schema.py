"""Explicit table schemas and the boundary that brings loose inputs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergescope.config import HUMAN, REPO_API_PREFIX
from mergescope.functions.clock import parse_utc
from mergescope.functions.text import match_key, remove_prefix


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


LONG, TEXT, BOOL, STAMP = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType()

PULL_REQUESTS = _struct(
    id=LONG, number=LONG, title=TEXT, body=TEXT, user=TEXT, user_id=LONG, state=TEXT, created_at=STAMP,
    closed_at=STAMP, merged_at=STAMP, repo_id=LONG, repo_url=TEXT, repo_name=TEXT, html_url=TEXT, is_agent=BOOL,
    agent=TEXT,
)
COMMITS = _struct(sha=TEXT, pr_id=LONG, author=TEXT, committer=TEXT, message=TEXT, seq=LONG)
COMMIT_DETAILS = _struct(
    sha=TEXT, pr_id=LONG, author=TEXT, committer=TEXT, message=TEXT, filename=TEXT, status=TEXT, additions=LONG,
    deletions=LONG, changes=LONG, patch=TEXT, commit_stats_total=LONG, commit_stats_additions=LONG,
    commit_stats_deletions=LONG,
)
REPOSITORIES = _struct(id=LONG, url=TEXT, license=TEXT, full_name=TEXT, language=TEXT, forks=LONG, stars=LONG)
TASK_TYPES = _struct(id=LONG, agent=TEXT, title=TEXT, reason=TEXT, type=TEXT, confidence=T.IntegerType())
RUN_STATUS = T.StructType(
    [T.StructField(n, T.ArrayType(TEXT), True) for n in ("errors", "not_found", "done_repos")]
    + [T.StructField(n, LONG, True) for n in ("total_prs", "batches_written")]
)


def safe_cast(column: Column, kind: T.DataType) -> Column:
    """Cast that turns values it cannot read into NULL."""
    if isinstance(kind, T.TimestampType):
        return parse_utc(column)
    return column.try_cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, casting safely and adding missing ones as NULL."""
    present = dict(df.dtypes)
    columns = []
    for field in schema:
        if field.name not in present:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif present[field.name] == field.dataType.simpleString():
            columns.append(F.col(field.name))
        else:
            columns.append(safe_cast(F.col(field.name), field.dataType).alias(field.name))
    return df.select(*columns)


def normalize_prs(df: DataFrame, source: str | None = None) -> DataFrame:
    """Bring a pull-request table to the common shape and add the derived columns every query uses."""
    prs = conform(df, PULL_REQUESTS)
    repo = F.coalesce(F.col("repo_name"), remove_prefix(F.col("repo_url"), REPO_API_PREFIX))
    origin = F.lit(source) if source else F.when(F.coalesce(F.col("is_agent"), F.lit(False)), "agent").otherwise(HUMAN)
    return prs.withColumns(
        {
            "repo_name": repo,
            "match_key": match_key(repo, F.col("number")),
            "source": origin,
            "is_merged": F.col("merged_at").isNotNull(),
        }
    )
