"""Acceptance, timing, size, revision and trend reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.config import AGENTS, HUMAN_GROUP
from mergescope.functions.numeric import np_round, percent
from mergescope.operators.aggregates import (
    acceptance, grouped_rate, is_merged, period_change, pivot_counts, pivot_measure, share, top_k,
    value_totals, with_rates, with_total_row,
)
from mergescope.operators.filters import min_size
from mergescope.operators.quantiles import (
    box_stats, clip_at_quantile, quantiles, quantiles_of_counts, rows_of, value_counts,
)
from mergescope.operators.revisions import change_size, commits_per_pr, first_vs_rest, revision_effort
from mergescope.operators.stats import (
    chi_square, chi_square_of_counts, log_rank, mann_whitney, mann_whitney_counts, pair_counts,
)
from mergescope.sources.warehouse import COMMIT_ORDER, Warehouse

GROUPS = (*AGENTS, HUMAN_GROUP)


def agent_side() -> Column:
    return F.col("source") == "agent"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: np_round(F.col(c), digits) for c in columns})


def categories() -> Column:
    """Report rows a pull request counts in: all agents and its own agent, or Human."""
    return F.when(agent_side(), F.array(F.lit("All agents"), F.col("agent"))).otherwise(F.array(F.lit(HUMAN_GROUP)))


def by_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("pr_id", "id")


# Overview and acceptance


def dataset_overview(w: Warehouse) -> DataFrame:
    fixes = w.prs.where("type = 'fix'")
    per_repo = fixes.groupBy("repo_name").agg(
        F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count(F.lit(1)).alias("n"),
        F.count_if("is_agent").alias("agents"),
    )
    ids = fixes.select(F.col("id").alias("pr_id"))
    authors = w.commits.join(ids, "pr_id", "left_semi").groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return per_repo.agg(
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_day"),
        F.sum("n").alias("total_prs"),
        F.sum("agents").alias("agent_prs"),
        (F.sum("n") - F.sum("agents")).alias("human_prs"),
        F.count("repo_name").alias("repositories"),
    ).withColumns(
        {
            "commits": authors.agg(F.sum("n")).scalar(),
            "committers": authors.agg(F.count("author")).scalar(),
        }
    )


def overview_agents(w: Warehouse) -> DataFrame:
    return value_totals(w.prs.where("type = 'fix' AND is_agent"), "agent")


def acceptance_by_agent(w: Warehouse) -> DataFrame:
    table = acceptance(w.fixes.where("is_agent"), "agent", "Overall")
    return rounded(table, 4, "acceptance_rate").orderBy(F.desc("acceptance_rate"), "agent")


def acceptance_all_agents(w: Warehouse) -> DataFrame:
    everyone = w.prs.where("type = 'fix' AND state = 'closed' AND is_agent")
    table = acceptance(everyone, "agent", "TOTAL").withColumn("rejection_rate", F.lit(100.0) - F.col("acceptance_rate"))
    return rounded(table, 4, "acceptance_rate", "rejection_rate")


def outcomes_and_hours(rows: DataFrame) -> DataFrame:
    """Outcome counts, acceptance rate and median hours to merge per report row, from one table of value counts."""
    counts = value_counts(rows, ["category"], ["is_merged", "hours_to_merge"])
    table = counts.groupBy("category").agg(
        rows_of("is_merged").alias("total"), rows_of("is_merged", F.col("value") == 1.0).alias("merged")
    )
    return with_rates(table).join(quantiles_of_counts(counts, ["category"], median_hours=("hours_to_merge", 0.5)), "category", "left")


def acceptance_time_table(w: Warehouse) -> DataFrame:
    rows = w.timed_fixes.select(F.explode(categories()).alias("category"), "is_merged", "hours_to_merge")
    return rounded(outcomes_and_hours(rows), 4, "acceptance_rate", "median_hours")


def agent_vs_human_acceptance(w: Warehouse) -> DataFrame:
    tested = chi_square(w.fixes, [], agent_side(), is_merged(), need_all_cells=True)
    return rounded(rounded(tested, 4, "rate_a", "rate_b", "chi2"), 6, "p")


def time_to_merge(w: Warehouse) -> DataFrame:
    merged = w.timed_fixes.where("is_merged AND group IS NOT NULL").select("group", "hours_to_merge")
    plain = quantiles(merged, ["group"], median_hours=("hours_to_merge", 0.5), p95_hours=("hours_to_merge", 0.95))
    clipped = clip_at_quantile(merged, ["group"], "hours_to_merge", 0.95, "clipped_hours")
    boxes = box_stats(clipped, ["group"], "clipped_hours").drop("median")
    return rounded(plain.join(boxes, "group"), 4, "median_hours", "p95_hours", "q1", "q3", "whisker_low", "whisker_high")


# Change size and description


def change_size_medians(w: Warehouse) -> DataFrame:
    sized = w.prs.where("type = 'fix'").select("id", "source").join(by_id(change_size(w.details)), "id")
    return quantiles(
        sized, ["source"], files_changed=("files_changed", 0.5), lines_added=("lines_added", 0.5),
        lines_deleted=("lines_deleted", 0.5),
    )


def description_words(w: Warehouse) -> DataFrame:
    """Median words per source, a missing description counting as none, and of the described ones alone."""
    worded = w.described(w.prs.where("type = 'fix'").select("id", "source"))
    all_rows = worded.select("source", F.coalesce("body_words", F.lit(0)).alias("words"))
    known = worded.where("body_words IS NOT NULL").select(F.concat("source", F.lit(" with text")).alias("source"), F.col("body_words").alias("words"))
    return quantiles(all_rows.unionByName(known), ["source"], median_words=("words", 0.5), p95_words=("words", 0.95))


def monthly_description_words(w: Warehouse) -> DataFrame:
    worded = w.described(w.fixes.select("id", "month", "group")).withColumn("words", F.coalesce("body_words", F.lit(0)))
    medians = quantiles(worded, ["month", "group"], median_words=("words", 0.5))
    return pivot_measure(medians, "month", "group", GROUPS, "median_words")


# Revisions


def _merged_commit_counts(w: Warehouse) -> DataFrame:
    merged = w.fixes.where("is_merged").select("id", "source", "agent", "group", "month")
    return merged.join(by_id(commits_per_pr(w.commits)), "id")


def unrevised_share(w: Warehouse) -> DataFrame:
    counted = _merged_commit_counts(w).withColumn("revised", F.when(F.col("num_commits") > 1, F.col("num_commits")))
    counts = value_counts(counted, ["source"], ["num_commits", "revised"])
    table = counts.groupBy("source").agg(
        rows_of("num_commits", F.col("value") == 1.0).alias("single"), rows_of("num_commits").alias("merged"),
        rows_of("revised").alias("revised"),
    ).withColumn("single_pct", percent(F.col("single"), F.col("merged")))
    medians = quantiles_of_counts(counts, ["source"], median_commits=("revised", 0.5))
    return rounded(table.join(medians, "source", "left"), 4, "single_pct")


def revision_count_test(w: Warehouse) -> DataFrame:
    tested = mann_whitney(_merged_commit_counts(w).where("num_commits > 1"), [], agent_side(), "num_commits")
    return rounded(tested.select("n1", "n2", "u", "z", "p", "sig", "method"), 6, "z", "p")


def _revised_effort(w: Warehouse, compat: bool = False) -> DataFrame:
    merged = w.fixes.where("is_merged").select("id", "source", "group", "month")
    effort = by_id(revision_effort(w.commits, w.details, COMMIT_ORDER, missing="drop", compat=compat))
    return merged.join(effort.where("num_commits > 1"), "id")


def _effort_medians(effort: DataFrame) -> DataFrame:
    return quantiles(
        effort, ["source"], rev_files=("rev_files", 0.5), rev_lines_added=("rev_lines_added", 0.5),
        rev_lines_deleted=("rev_lines_deleted", 0.5),
    )


def revision_effort_medians(w: Warehouse) -> DataFrame:
    return _effort_medians(_revised_effort(w))


def revision_effort_shared_first(w: Warehouse) -> DataFrame:
    """Effort when a commit that opens any merged fix counts as first in all of them."""
    merged = w.fixes.where("is_merged").select("id", "source")
    ids = merged.select(F.col("id").alias("pr_id"))
    commits = w.commits.join(ids, "pr_id", "left_semi")
    sizes = first_vs_rest(commits, w.details.join(ids, "pr_id", "left_semi"), COMMIT_ORDER, compat=True).where("has_rest")
    return _effort_medians(merged.join(by_id(sizes), "id"))


def code_modification(w: Warehouse) -> DataFrame:
    counts = value_counts(_revised_effort(w), ["source"], ["num_commits", "pct_modification"])
    table = counts.groupBy("source").agg(
        rows_of("num_commits").alias("revised"), rows_of("pct_modification").alias("with_initial_lines")
    )
    medians = quantiles_of_counts(counts, ["source"], median_pct=("pct_modification", 0.5))
    return rounded(table.join(medians, "source", "left"), 4, "median_pct")


# Volume and trends


def state_breakdown(w: Warehouse) -> DataFrame:
    return w.prs.where("type = 'fix'").groupBy("source", "state").agg(F.count(F.lit(1)).alias("n")).orderBy(
        "source", F.desc("n"), "state"
    )


def monthly_volume(w: Warehouse) -> DataFrame:
    wide = w.fixes.groupBy("month").agg(
        F.count_if(agent_side()).alias("agent"), F.count_if(~agent_side()).alias("human"), F.count(F.lit(1)).alias("total")
    )
    return wide.withColumn("agent_pct", percent(F.col("agent"), F.col("total"), 1)).orderBy("month")


def monthly_volume_by_agent(w: Warehouse) -> DataFrame:
    return pivot_counts(w.fixes, "month", "group", GROUPS).orderBy("month")


def monthly_market_share(w: Warehouse) -> DataFrame:
    counts = w.fixes.where(F.col("agent").isin(*AGENTS)).groupBy("month", "agent").agg(F.count(F.lit(1)).alias("n"))
    return pivot_measure(share(counts, ["month"], "n", digits=2), "month", "agent", AGENTS, "share_pct").orderBy("month")


def monthly_merge_rate(w: Warehouse) -> DataFrame:
    rates = rounded(grouped_rate(w.fixes, ["month", "group"], min_rows=5), 1, "rate")
    return pivot_measure(rates, "month", "group", GROUPS, "rate").orderBy("month")


def monthly_acceptance_by_source(w: Warehouse) -> DataFrame:
    return rounded(grouped_rate(w.fixes, ["month", "source"]), 4, "rate").orderBy("month", "source")


def _gated_monthly_median(df: DataFrame, column: str, digits: int, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    # A constant column counts the rows of a group next to its values.
    counts = value_counts(df.withColumn("row", F.lit(1)), ["month", "group"], [column, "row"])
    sizes = counts.groupBy("month", "group").agg(rows_of("row").alias("n"))
    medians = quantiles_of_counts(counts, ["month", "group"], median=(column, 0.5))
    gated = sizes.join(medians, ["month", "group"], "left").withColumn(
        "median", min_size(np_round(F.col("median"), digits), rows=F.col("n"))
    )
    return pivot_measure(gated, "month", "group", groups, "median").orderBy("month")


def monthly_time_to_merge(w: Warehouse) -> DataFrame:
    return _gated_monthly_median(w.timed_fixes.where("is_merged").select("month", "group", "hours_to_merge"), "hours_to_merge", 2)


def monthly_patch_size(w: Warehouse) -> DataFrame:
    sized = w.fixes.select("id", "month", "group").join(by_id(change_size(w.details)), "id", "left")
    return _gated_monthly_median(sized.select("month", "group", "lines_added"), "lines_added", 1)


def _merged_effort(w: Warehouse) -> DataFrame:
    merged = w.fixes.where("is_merged").select("id", "source", "group", "month")
    return merged.join(by_id(revision_effort(w.commits, w.details, COMMIT_ORDER)), "id")


def monthly_revision_rate(w: Warehouse) -> DataFrame:
    counted = _merged_commit_counts(w).where(F.col("group").isin(*AGENTS))
    rates = rounded(grouped_rate(counted, ["month", "group"], F.col("num_commits") > 1, min_rows=5), 1, "rate")
    return pivot_measure(rates, "month", "group", AGENTS, "rate").orderBy("month")


def monthly_revision_effort(w: Warehouse) -> DataFrame:
    revised = _merged_effort(w).where((F.col("num_commits") > 1) & F.col("group").isin(*AGENTS))
    return _gated_monthly_median(revised.select("month", "group", "rev_lines_added"), "rev_lines_added", 1, AGENTS)


# Group comparisons


def agent_leaderboard(w: Warehouse) -> DataFrame:
    """All measures of a group and its tests against Human, from one table of value counts."""
    effort = by_id(revision_effort(w.commits, w.details, COMMIT_ORDER)).select("id", "num_commits", "rev_lines_added", "rev_lines_deleted")
    base = w.timed_fixes.where("group IS NOT NULL").select("id", "group", "is_merged", "hours_to_merge").join(effort, "id", "left")
    revised = F.col("is_merged") & (F.col("num_commits") > 1)
    measured = base.withColumns(
        {
            "is_revised": F.when(F.col("is_merged") & F.col("num_commits").isNotNull(), F.col("num_commits") > 1),
            "added": F.when(revised, F.col("rev_lines_added")),
            "deleted": F.when(revised, F.col("rev_lines_deleted")),
        }
    )
    counts = value_counts(measured, ["group"], ["is_merged", "is_revised", "hours_to_merge", "added", "deleted"])

    hit = F.col("value") == 1.0
    table = counts.groupBy("group").agg(
        rows_of("is_merged").alias("total"), rows_of("is_merged", hit).alias("merged"),
        percent(rows_of("is_merged", hit), rows_of("is_merged")).alias("rate"),
        percent(rows_of("is_revised", hit), rows_of("is_revised")).alias("revised_pct"),
    )
    medians = quantiles_of_counts(
        counts, ["group"], median_hours=("hours_to_merge", 0.5), median_rev_added=("added", 0.5), median_rev_deleted=("deleted", 0.5)
    )
    pairs = pair_counts(counts, "group", [(a, a, HUMAN_GROUP) for a in AGENTS]).withColumnRenamed("comparison", "group")
    rate_test = chi_square_of_counts(pairs, ["group"], "is_merged").select(
        "group", "chi2", F.col("sig").alias("rate_sig")
    )
    ranked = mann_whitney_counts(pairs, ["group", "metric"])
    times, lines = F.col("metric") == "hours_to_merge", F.col("metric") == "added"
    rank_tests = ranked.groupBy("group").agg(
        F.max(F.when(times, F.col("u"))).alias("time_u"), F.max(F.when(times, F.col("sig"))).alias("time_sig"),
        F.max(F.when(times, F.col("method"))).alias("time_method"), F.max(F.when(lines, F.col("method"))).alias("lines_method"),
        F.max(F.when(lines, F.col("u"))).alias("lines_u"), F.max(F.when(lines, F.col("sig"))).alias("lines_sig"),
    )
    for part in (medians, rate_test, rank_tests):
        table = table.join(part, "group", "left")
    return rounded(table, 4, "rate", "median_hours", "revised_pct", "chi2").orderBy("group")


def before_after_by_agent(w: Warehouse) -> DataFrame:
    agents = w.timed_fixes.where(F.col("agent").isin(*AGENTS))
    counts = value_counts(agents, ["agent", "period"], ["is_merged", "hours_to_merge"])
    pairs = pair_counts(counts, "period", [("periods", "before", "after")], ["agent"])
    rates = chi_square_of_counts(pairs, ["agent"], "is_merged").where("total_a >= 5 AND total_b >= 5")
    rates = rates.withColumn("change_pp", F.col("rate_b") - F.col("rate_a")).select(
        "agent", "total_a", "rate_a", "total_b", "rate_b", "change_pp", "chi2", "p", "sig"
    )
    medians = quantiles_of_counts(counts, ["agent", "period"], median_hours=("hours_to_merge", 0.5))
    hours = period_change(medians, "agent", "period", "median_hours", "before", "after").select(
        "agent", F.col("before").alias("hours_before"), F.col("after").alias("hours_after")
    )
    ranked = mann_whitney_counts(pairs, ["agent", "metric"]).where("n1 >= 5 AND n2 >= 5")
    hours_row = F.col("metric") == "hours_to_merge"
    times = ranked.groupBy("agent").agg(
        *[F.max(F.when(hours_row, F.col(c))).alias(f"time_{c}") for c in ("u", "p", "sig", "method")]
    )
    table = rates.join(hours, "agent", "left").join(times, "agent", "left")
    return rounded(rounded(table, 4, "rate_a", "rate_b", "change_pp", "chi2", "hours_before", "hours_after"), 6, "p", "time_p")


def before_after_with_total(w: Warehouse) -> DataFrame:
    """Totals and rates in both periods per agent and for all agents together, and the change in points."""
    counts = w.fixes.where(F.col("agent").isin(*AGENTS)).groupBy("agent").agg(
        F.count_if(F.col("period") == "before").alias("before_total"),
        F.count_if((F.col("period") == "before") & is_merged()).alias("before_merged"),
        F.count_if(F.col("period") == "after").alias("after_total"),
        F.count_if((F.col("period") == "after") & is_merged()).alias("after_merged"),
    )
    full = with_total_row(counts, "agent", "ALL AGENTS", ("before_total", "before_merged", "after_total", "after_merged"))
    rates = full.withColumns(
        {
            "before_rate": percent(F.col("before_merged"), F.col("before_total"), empty=0.0),
            "after_rate": percent(F.col("after_merged"), F.col("after_total"), empty=0.0),
        }
    ).withColumn("diff_pp", F.col("after_rate") - F.col("before_rate"))
    return rounded(rates, 4, "before_rate", "after_rate", "diff_pp")


def top_repositories(w: Warehouse) -> DataFrame:
    top = top_k(
        w.prs.where("type = 'fix'"), "repo_name", 10, F.count_if("is_agent").alias("agent"), F.count_if(is_merged()).alias("merged")
    )
    return top.withColumn("rate", percent(F.col("merged"), F.col("total"), 1))


def survival_comparison(w: Warehouse) -> DataFrame:
    tested = log_rank(w.timed_fixes.select("source", "hours_open", "is_merged"), [], agent_side(), "hours_open", is_merged())
    return rounded(rounded(tested.drop("variance"), 4, "expected", "chi2"), 6, "p")


PLANS = {
    "q01_dataset_overview": dataset_overview,
    "q01_overview_agents": overview_agents,
    "q02_acceptance_by_agent": acceptance_by_agent,
    "q02_acceptance_all_agents": acceptance_all_agents,
    "q03_acceptance_time_table": acceptance_time_table,
    "q04_agent_vs_human_chi_square": agent_vs_human_acceptance,
    "q05_time_to_merge_boxes": time_to_merge,
    "q06_change_size_medians": change_size_medians,
    "q07_description_words": description_words,
    "q07_monthly_description_words": monthly_description_words,
    "q08_unrevised_share": unrevised_share,
    "q08_revision_count_test": revision_count_test,
    "q09_revision_effort_medians": revision_effort_medians,
    "q09_revision_effort_shared_first": revision_effort_shared_first,
    "q10_code_modification": code_modification,
    "q11_state_breakdown": state_breakdown,
    "q12_monthly_volume": monthly_volume,
    "q13_monthly_volume_by_agent": monthly_volume_by_agent,
    "q13_monthly_market_share": monthly_market_share,
    "q14_monthly_merge_rate": monthly_merge_rate,
    "q14_monthly_acceptance_by_source": monthly_acceptance_by_source,
    "q15_monthly_time_to_merge": monthly_time_to_merge,
    "q16_monthly_patch_size": monthly_patch_size,
    "q17_monthly_revision_rate": monthly_revision_rate,
    "q17_monthly_revision_effort": monthly_revision_effort,
    "q18_agent_leaderboard": agent_leaderboard,
    "q19_before_after_by_agent": before_after_by_agent,
    "q19_before_after_with_total": before_after_with_total,
    "q20_top_repositories": top_repositories,
    "q37_survival_log_rank": survival_comparison,
}
