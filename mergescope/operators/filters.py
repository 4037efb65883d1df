"""Row filters and the predicates they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.config import AGENTS, EXCLUDED_AGENT, HUMAN_GROUP, MIN_GROUP_SIZE


def differs(column: Column, value: object) -> Column:
    """Inequality that keeps rows whose value is NULL."""
    return ~column.eqNullSafe(F.lit(value))


def closed_fixes(df: DataFrame, exclude_agent: str | None = EXCLUDED_AGENT, type_col: str = "type") -> DataFrame:
    """Closed pull requests labelled as fixes, without one agent when stated."""
    kept = df.where((F.col(type_col) == "fix") & (F.col("state") == "closed"))
    return kept if exclude_agent is None else kept.where(differs(F.col("agent"), exclude_agent))


def in_window(
    df: DataFrame, ts: str, low: Column | None = None, high: Column | None = None, closed: str = "both"
) -> DataFrame:
    """Rows inside a time window; ``closed`` is 'both', 'left', 'right' or 'neither'.

    Bounds are literals or scalar subqueries, so no bound is ever collected to the driver.
    """
    column, out = F.col(ts), df
    if low is not None:
        out = out.where(column >= low if closed in ("both", "left") else column > low)
    if high is not None:
        out = out.where(column <= high if closed in ("both", "right") else column < high)
    return out


def within_range_of(df: DataFrame, other: DataFrame, ts: str = "created_at") -> DataFrame:
    """Rows of ``df`` between the first and last instant seen in ``other``."""
    return in_window(df, ts, other.agg(F.min(ts)).scalar(), other.agg(F.max(ts)).scalar())


def after_end_of(df: DataFrame, other: DataFrame, ts: str = "created_at", until: str | None = None) -> DataFrame:
    """Rows of ``df`` later than the last instant of ``other``, up to an inclusive literal bound."""
    later = in_window(df, ts, low=other.agg(F.max(ts)).scalar(), closed="neither")
    return later if until is None else in_window(later, ts, high=F.lit(until).cast("timestamp"))


def min_size(metric: Column, n: int = MIN_GROUP_SIZE, rows: Column | None = None) -> Column:
    """The aggregate, or NULL when its group has fewer than ``n`` rows."""
    return F.when((F.count(F.lit(1)) if rows is None else rows) >= n, metric)


def studied_group(agents: tuple[str, ...] = AGENTS) -> Column:
    """Agent name for agent rows of the studied agents, 'Human' for the rest of the sources, else NULL."""
    return F.when(F.col("source") != "agent", HUMAN_GROUP).when(F.col("agent").isin(*agents), F.col("agent"))
