"""Labelling jobs over whole tables: titles, incremental work, model answers and author attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergescope.config import HUMAN
from mergescope.functions.text import (
    COMMIT_TYPES, DEFAULT_REASON, TITLE_LABEL_CONFIDENCE, TITLE_LABEL_REASON, classify_title, conventional_label,
    json_object, strip,
)
from mergescope.operators.joins import lookup


def classify_table(prs: DataFrame, source: str | None = None) -> DataFrame:
    """Add the fix/other label, and the source when stated."""
    labelled = prs.withColumn("type", classify_title(F.col("title")))
    return labelled if source is None else labelled.withColumn("source", F.lit(source))


def fixes_with_commits(classified: DataFrame, commits: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fix pull requests and the commits and file rows that belong to them."""
    fixes = classified.where(F.col("type") == "fix")
    ids = fixes.select(F.col("id").alias("pr_id"))
    return fixes, commits.join(ids, "pr_id", "left_semi"), details.join(ids, "pr_id", "left_semi")


def label_by_title(prs: DataFrame) -> DataFrame:
    """Commit-type label with its reason and confidence, all NULL when the title names no type."""
    named = prs.withColumn("label", conventional_label(F.col("title")))
    has = F.col("label").isNotNull()
    return named.withColumns(
        {"reason": F.when(has, TITLE_LABEL_REASON), "confidence": F.when(has, TITLE_LABEL_CONFIDENCE)}
    )


def label_incremental(prs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label the rows whose id is not done yet: (labelled, queue for the external labeller)."""
    key = F.col("id").cast("string").alias("done_id__")
    todo = prs.join(done.select(key), prs["id"].cast("string") == F.col("done_id__"), "left_anti")
    named = label_by_title(todo.withColumn("title", F.coalesce(F.col("title"), F.lit(""))))
    queue = named.where(F.col("label").isNull()).drop("label", "reason", "confidence")
    return named.where(F.col("label").isNotNull()), queue


def parse_responses(df: DataFrame, raw: str) -> DataFrame:
    """Read label, confidence and reason from model answers; ``problem`` names the first rule a row breaks.

    A fraction is cut off where it is a number, and a problem where it is text; true and false are problems.
    """
    answered = df.withColumn("answer__", json_object(F.col(raw)))
    label = F.lower(strip(F.coalesce(F.col("answer__.output"), F.lit(""))))
    number = strip(F.coalesce(F.col("answer__.confidence"), F.lit("0")))
    whole = number.rlike(r"^[+-]?[0-9]+$")
    quoted = F.col(raw).rlike(r'"confidence"\s*:\s*"')
    confidence = F.when(whole, number.try_cast("int")).when(~quoted, number.try_cast("double").try_cast("int"))
    reason = F.coalesce(F.nullif(strip(F.coalesce(F.col("answer__.reason"), F.lit(""))), F.lit("")), F.lit(DEFAULT_REASON))
    answer = F.coalesce(F.col("answer__.output"), F.col("answer__.confidence"), F.col("answer__.reason"))
    parsed = answered.withColumns({"label": label, "confidence": confidence, "reason": reason})
    problem = (
        F.when(answer.isNull(), "no object")
        .when(~F.col("label").isin(*COMMIT_TYPES), "label")
        .when(F.col("confidence").isNull(), "confidence")
        .when(~F.col("confidence").between(1, 10), "confidence range")
    )
    return parsed.withColumn("problem", problem).drop("answer__")


def validate_responses(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Split model answers into valid labels and a quarantine that keeps the raw text."""
    parsed = parse_responses(df, raw)
    return parsed.where(F.col("problem").isNull()).drop("problem"), parsed.where(F.col("problem").isNotNull())


def attribute(prs: DataFrame, users: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mark authors known as agents; anyone else is human. Of several entries per user the last in the order wins."""
    known = users.select("user", F.struct(*order).alias("rank__"), "agent")
    joined = lookup(prs.drop("agent", "is_agent"), known, ["user"], [F.col("rank__")]).drop("rank__")
    return joined.withColumns(
        {"is_agent": F.col("agent").isNotNull(), "agent": F.coalesce(F.col("agent"), F.lit(HUMAN))}
    )
