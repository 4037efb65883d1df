"""Two collections compared: overlap, coverage, gaps, and cohorts drawn from one to match the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.config import AGENTS, EXCLUDED_AGENT, HUMAN
from mergescope.functions.numeric import np_round, percent, ratio
from mergescope.functions.text import canonical_url, recover_name, shorten
from mergescope.operators.aggregates import (
    acceptance, crosstab, is_merged, outcome_columns, share_of_all, with_rates, with_total_row, work_list,
)
from mergescope.operators.filters import closed_fixes, differs, within_range_of
from mergescope.operators.joins import (
    in_shared_repos, keep_first, lookup, membership, outer_counts, paired,
)
from mergescope.operators.overlap import agreement, dual_match, overlap, overlap_counts, tag, with_coverage
from mergescope.operators.quantiles import histogram, quantiles_of_counts, rows_of, value_counts
from mergescope.operators.revisions import commits_per_pr
from mergescope.operators.sampling import matched
from mergescope.operators.stats import chi_square, log_rank
from mergescope.plans.reports import agent_side, categories, rounded
from mergescope.session import stored
from mergescope.sources.warehouse import Warehouse

KEY = "match_key"

# Two status labels that carry an explanation.
NO_TARGET = "no_target_agent_prs (only OpenAI_Codex or other)"
NOT_ATTEMPTED = "not_attempted (repo not in our collection scope)"


# Overlap of keys


def dataset_overlap(w: Warehouse) -> DataFrame:
    """Agent and human collections compared by key."""
    agents = overlap(w.ours_agents, w.theirs, KEY).withColumn("scope", F.lit("agent"))
    humans = overlap(w.ours_human, w.theirs_human, KEY).withColumn("scope", F.lit("human"))
    return rounded(agents.unionByName(humans), 4, "jaccard", "pct_of_a", "pct_of_b")


def repository_overlap(w: Warehouse) -> DataFrame:
    return rounded(overlap(w.ours, w.theirs, "repo_name"), 4, "jaccard", "pct_of_a", "pct_of_b")


def overlap_by_agent(w: Warehouse) -> DataFrame:
    """Rows of each side by agent and how many of them the other side has."""

    def side(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        flagged = membership(df, other, [KEY], "in_other", split_hot=False)
        return flagged.groupBy("agent").agg(
            F.count(F.lit(1)).alias("total"), F.count_if("in_other").alias("in_other")
        ).withColumn("side", F.lit(name))

    both = side(w.ours_agents, w.theirs, "ours").unionByName(side(w.theirs, w.ours, "theirs"))
    return both.withColumns(
        {"not_in_other": F.col("total") - F.col("in_other"), "overlap_pct": percent(F.col("in_other"), F.col("total"), 1)}
    )


def _per_repo(w: Warehouse) -> DataFrame:
    per_repo = overlap_counts(tag(w.ours, w.theirs, ["repo_name", KEY]), ["repo_name"])
    shared = per_repo.where("a_keys > 0 AND b_keys > 0")
    return with_coverage(shared, 1).drop("jaccard", "union_keys")


def overlap_per_group(w: Warehouse) -> DataFrame:
    """Keys compared inside each agent, so a key the sides label differently is missing from both."""
    return rounded(overlap(w.ours_agents, w.theirs, KEY, ["agent"]), 4, "jaccard", "pct_of_a", "pct_of_b")


def overlap_by_repo(w: Warehouse) -> DataFrame:
    return _per_repo(w).orderBy(F.desc("b_keys"), "repo_name")


def repo_overlap_histogram(w: Warehouse) -> DataFrame:
    return histogram(_per_repo(w), "pct_of_b")


def overlap_by_month(w: Warehouse) -> DataFrame:
    """Keys are compared inside each month, so a key dated differently by the two sides counts as missing twice."""
    monthly = overlap_counts(tag(w.ours, w.theirs, ["month", KEY]), ["month"])
    return with_coverage(monthly, 1).drop("jaccard", "union_keys")


def missing_repositories(w: Warehouse) -> DataFrame:
    """Repositories with the most keys that only the other side has, for both sides."""

    def side(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        only = df.join(other.select(KEY), KEY, "left_anti").select("repo_name", KEY).distinct()
        top = only.groupBy("repo_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repo_name").limit(20)
        return top.withColumn("side", F.lit(name))

    return side(w.theirs, w.ours, "theirs only").unionByName(side(w.ours, w.theirs, "ours only"))


def exclusive_time_ranges(w: Warehouse) -> DataFrame:
    """First and last day of both sides and of their exclusive and shared parts."""
    tagged = membership(w.ours, w.theirs, [KEY], "in_other", split_hot=False).select("created_at", F.lit("ours").alias("side"), "in_other")
    other = membership(w.theirs, w.ours, [KEY], "in_other", split_hot=False).select("created_at", F.lit("theirs").alias("side"), "in_other")
    both = tagged.unionByName(other)
    part = F.when(F.col("in_other"), "shared").otherwise("exclusive")
    return both.groupBy("side", part.alias("part")).agg(
        F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_day"),
        F.count(F.lit(1)).alias("rows"),
    )


# Labels and states of shared keys


def _pairs(w: Warehouse) -> DataFrame:
    return paired(w.ours, w.theirs, KEY, ["agent", "state", "is_merged"], ["id"], ("ours_", "theirs_"))


def agent_crosstab(w: Warehouse) -> DataFrame:
    return crosstab(_pairs(w), "ours_agent", "theirs_agent", AGENTS)


def state_crosstab(w: Warehouse) -> DataFrame:
    return crosstab(_pairs(w), "ours_state", "theirs_state", ("closed", "open"))


def label_agreement(w: Warehouse) -> DataFrame:
    return rounded(agreement(_pairs(w), "ours_agent", "theirs_agent"), 4, "agree_pct")


def merge_agreement(w: Warehouse) -> DataFrame:
    return rounded(agreement(_pairs(w), "ours_is_merged", "theirs_is_merged"), 4, "agree_pct")


# Comparison in a common scope


def _scoped(w: Warehouse) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Agent and human rows of both sides: shared repositories, the other side's date range."""
    ours, theirs = w.ours_agents, w.theirs
    repos = w.ours
    a = within_range_of(in_shared_repos(ours, theirs), theirs)
    b = in_shared_repos(theirs, repos)
    ha, hb = w.ours_human, w.theirs_human
    return a, b, within_range_of(in_shared_repos(ha, hb), theirs), in_shared_repos(hb, ha)


def coverage_by_agent(w: Warehouse) -> DataFrame:
    """Coverage per agent in the common scope with a total row over distinct keys."""
    a, b, _, _ = _scoped(w)
    per_agent = overlap_counts(tag(a, b, ["agent", KEY]), ["agent"])
    total = overlap_counts(tag(a, b, [KEY])).withColumn("agent", F.lit("TOTAL"))
    table = per_agent.unionByName(total).select(
        "agent", "a_keys", "b_keys", "overlap", (F.col("b_keys") - F.col("overlap")).alias("missed"),
        percent(F.col("overlap"), F.col("b_keys"), empty=0.0).alias("coverage_pct"),
    )
    return rounded(table, 4, "coverage_pct")


def coverage_summary(w: Warehouse) -> DataFrame:
    """Agent, human and total coverage in the common scope, both ways."""
    a, b, ha, hb = _scoped(w)
    parts = overlap_counts(tag(a, b, [KEY])).withColumn("category", F.lit("Agent PRs")).unionByName(
        overlap_counts(tag(ha, hb, [KEY])).withColumn("category", F.lit("Human PRs"))
    ).select("category", "a_keys", "b_keys", "overlap")
    table = with_total_row(parts, "category", "TOTAL", ("a_keys", "b_keys", "overlap"))
    return rounded(
        table.withColumns(
            {"a_covers_b": percent(F.col("overlap"), F.col("b_keys")), "b_covers_a": percent(F.col("overlap"), F.col("a_keys"))}
        ), 4, "a_covers_b", "b_covers_a",
    )


def missed_and_extra(w: Warehouse) -> DataFrame:
    """Rows only one side has in the common scope, by agent."""
    a, b, _, _ = _scoped(w)

    def side(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        only = df.join(other.select(KEY), KEY, "left_anti")
        return only.groupBy("agent").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))

    return side(b, a, "missed").unionByName(side(a, b, "extra"))


def missed_repositories(w: Warehouse) -> DataFrame:
    """Repositories with missed rows: those we cover in part, and those we have nothing from."""
    a, b, _, _ = _scoped(w)
    missed = b.join(a.select(KEY), KEY, "left_anti").select("repo_name").distinct()
    known = membership(missed, a, ["repo_name"], "partly")
    return known.agg(F.count_if("partly").alias("partly_missing"), F.count_if(~F.col("partly")).alias("wholly_missing"))


# Three collections per repository and per month


def _tagged_repos(w: Warehouse) -> DataFrame:
    """Every repository of the other side with its counts in all collections, in one grouped aggregate."""

    def part(df: DataFrame, origin: str) -> DataFrame:
        return df.select("repo_name", "id", KEY, "agent", F.lit(origin).alias("origin"))

    stacked = part(w.theirs_all, "theirs").unionByName(part(w.prev.where(differs(F.col("agent"), HUMAN)), "prev"))
    stacked = stacked.unionByName(part(w.new, "new"))
    theirs, ours = F.col("origin") == "theirs", F.col("origin") != "theirs"
    per_key = stacked.groupBy("repo_name", KEY).agg(
        F.max(F.when(theirs, F.col("agent"))).alias("agent"),
        F.bool_or(theirs).alias("theirs"),
        F.bool_or(ours).alias("ours"),
        F.bool_or(F.col("origin") == "prev").alias("prev"),
        F.bool_or(F.col("origin") == "new").alias("new"),
    )
    target = F.col("agent").isin(*AGENTS)
    return per_key.groupBy("repo_name").agg(
        F.count_if("theirs").alias("their_prs"),
        F.count_if(F.col("theirs") & target).alias("their_target_prs"),
        *[F.count_if(F.col("theirs") & (F.col("agent") == a)).alias(f"their_{a}") for a in (*AGENTS, EXCLUDED_AGENT)],
        F.count_if(F.col("theirs") & F.col("ours")).alias("overlap_count"),
        F.count_if("prev").alias("prev_prs"),
        F.count_if("new").alias("new_prs"),
        F.count_if(F.col("ours")).alias("our_distinct_prs"),
    ).where("their_prs > 0")


def _with_status(w: Warehouse, repos: DataFrame) -> DataFrame:
    lists = w.run_status.groupBy("repo_name").agg(
        F.bool_or(F.col("list") == "errors").alias("failed"),
        F.bool_or(F.col("list") == "not_found").alias("gone"),
        F.bool_or(F.col("list") == "done_repos").alias("done"),
    )
    flagged = repos.join(lists, "repo_name", "left").na.fill(False, ["failed", "gone", "done"])
    target, got = F.col("their_target_prs"), F.col("our_total")
    status = (
        F.when((target > 0) & (got >= target), "fully_collected")
        .when(F.col("failed"), "error_accessing_repo")
        .when(F.col("gone"), "repo_not_found_or_deleted")
        .when(target == 0, NO_TARGET)
        .when(F.col("done") & (got > 0), "partially_collected")
        .when(F.col("done") & (got == 0), "processed_but_no_matching_prs_found")
        .when(~F.col("done"), NOT_ATTEMPTED)
        .otherwise("unknown")
    )
    return flagged.withColumn("status", status).drop("failed", "gone", "done")


def repo_coverage(w: Warehouse) -> DataFrame:
    """Per-repository coverage with its status; a pull request held by two of our runs counts twice in the sum."""
    repos = _tagged_repos(w).withColumn("our_total", F.col("prev_prs") + F.col("new_prs"))
    rated = repos.withColumns(
        {
            "overlap_pct": percent(F.col("overlap_count"), F.col("their_prs"), 1),
            "pct_of_target": percent(F.col("our_total"), F.col("their_target_prs"), 1),
            "pct_of_all": percent(F.col("our_total"), F.col("their_prs"), 1),
        }
    )
    return _with_status(w, rated).orderBy(F.desc("their_prs"), "repo_name")


def ordered_status(w: Warehouse) -> DataFrame:
    return repo_coverage(w).select("repo_name", "status")


def status_breakdown(w: Warehouse) -> DataFrame:
    counts = repo_coverage(w).groupBy("status").agg(F.count(F.lit(1)).alias("repo_count"))
    return share_of_all(counts, "repo_count", digits=2)


def _ours_merged(w: Warehouse) -> DataFrame:
    """Base run and incremental run without humans, one row per key, the base run first."""
    base = w.prev.where(differs(F.col("agent"), HUMAN)).withColumn("run", F.lit(0))
    extra = w.new.withColumn("run", F.lit(1))
    return keep_first(
        base.unionByName(extra).select(KEY, "run", "id", "agent", "month", "repo_name"), [KEY], [F.col("run"), F.col("id")]
    )


def merged_runs(w: Warehouse) -> DataFrame:
    return _ours_merged(w).groupBy("run").agg(F.count(F.lit(1)).alias("kept"))


def monthly_coverage(w: Warehouse) -> DataFrame:
    """Both sides per month, with one column per agent and a total row that sums the months."""
    gone = w.run_status.where(F.col("list") != "done_repos").select("repo_name").distinct()
    theirs = membership(w.theirs_all, gone, ["repo_name"], "unreachable")
    stacked = theirs.select("month", KEY, "agent", "unreachable", F.lit(True).alias("is_theirs")).unionByName(
        _ours_merged(w).select("month", KEY, "agent", F.lit(False).alias("unreachable"), F.lit(False).alias("is_theirs"))
    )
    t, o = F.col("is_theirs"), ~F.col("is_theirs")
    target = F.col("agent").isin(*AGENTS)
    # Rows are reduced per (month, key) first; sums of those counts are the monthly row counts.
    per_key = stacked.groupBy("month", KEY).agg(
        F.count_if(t).alias("t"), F.count_if(o).alias("o"), F.count_if(t & target).alias("t_target"),
        F.count_if(t & F.col("unreachable")).alias("t_gone"),
        *[F.count_if(t & (F.col("agent") == a)).alias(f"t_{a}") for a in (*AGENTS, EXCLUDED_AGENT)],
        *[F.count_if(o & (F.col("agent") == a)).alias(f"o_{a}") for a in AGENTS],
    )
    monthly = per_key.groupBy("month").agg(
        F.sum("t").alias("their_prs"),
        F.sum("t_target").alias("their_target_prs"),
        (F.sum("t") - F.sum("t_target")).alias("their_out_of_scope"),
        F.sum("t_gone").alias("their_unreachable"),
        F.sum("o").alias("our_prs"),
        F.count_if((F.col("t") > 0) & (F.col("o") > 0)).alias("overlap"),
        F.count_if((F.col("t") == 0) & (F.col("o") > 0)).alias("our_unique"),
        F.count_if((F.col("t_target") > 0) & (F.col("o") == 0)).alias("target_missed"),
        *[F.sum(f"t_{a}").alias(f"their_{a}") for a in (*AGENTS, EXCLUDED_AGENT)],
        *[F.sum(f"o_{a}").alias(f"our_{a}") for a in AGENTS],
    )
    return with_total_row(monthly, "month", "TOTAL", [c for c in monthly.columns if c != "month"])


def agent_coverage(w: Warehouse) -> DataFrame:
    """Share of the other side's rows per agent that any of our runs has."""
    flagged = membership(w.theirs_all, _ours_merged(w), [KEY], "in_ours", split_hot=False)
    return flagged.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("in_ours").alias("overlap")
    ).withColumn("overlap_pct", percent(F.col("overlap"), F.col("total"), 1))


# Matching by metadata or by shared commit

DEEP_MONTH = "1997-07"


def _matched_ids(w: Warehouse) -> DataFrame:
    held = w.commits.select("sha", "pr_id")
    a_commits = held.join(w.ours.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    b_commits = held.join(w.theirs_all.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    return dual_match(w.theirs_all, w.ours, b_commits, a_commits, ["repo_id", "number"])


def key_or_commit_match(w: Warehouse) -> DataFrame:
    return _matched_ids(w)


def dual_key_overlap(w: Warehouse) -> DataFrame:
    flagged = membership(w.theirs_all.select("id", "month"), _matched_ids(w), ["id"], "hit", split_hot=False)
    theirs = flagged.groupBy("month").agg(F.count(F.lit(1)).alias("their_prs"), F.count_if("hit").alias("overlap"))
    ours = w.ours.groupBy("month").agg(F.count(F.lit(1)).alias("our_prs"))
    monthly = outer_counts([ours, theirs], ["month"])
    full = with_total_row(monthly, "month", "TOTAL", ("our_prs", "their_prs", "overlap"))
    return full.withColumn("overlap_pct", percent(F.col("overlap"), F.col("their_prs"), 1, empty=0.0))


def dual_key_deep_dive(w: Warehouse) -> DataFrame:
    """Per-repository overlap in one month with names from the metadata."""
    month = w.theirs_all.where(F.col("month") == DEEP_MONTH).select("id", "repo_id")
    flagged = membership(month, _matched_ids(w), ["id"], "hit", split_hot=False)
    stats = flagged.groupBy("repo_id").agg(F.count(F.lit(1)).alias("their_total"), F.count_if("hit").alias("overlap_count"))
    named = lookup(stats, w.repositories.select("repo_id", "full_name"), ["repo_id"], [F.col("full_name")], {"full_name": "Unknown"})
    return named.select(
        "repo_id", "their_total", "overlap_count", shorten(F.col("full_name")).alias("repo_name"),
        percent(F.col("overlap_count"), F.col("their_total"), 1).alias("overlap_pct"),
    )


def shared_commit_pairs(w: Warehouse) -> DataFrame:
    """Commits of one month's pull requests that our side also holds, with the pull requests holding them."""
    month = w.theirs_all.where(F.col("month") == DEEP_MONTH).select(F.col("id").alias("pr_id"))
    theirs = w.commits.select("sha", "pr_id").join(month, "pr_id", "left_semi").distinct()
    ours = w.commits.select("sha", "pr_id").join(w.ours.select(F.col("id").alias("pr_id")), "pr_id", "left_semi")
    return theirs.join(ours.select("sha"), "sha", "left_semi").select("sha", "pr_id")


# Why acceptance rates differ


def _their_fixes(w: Warehouse) -> DataFrame:
    """The other side's closed fixes by its own labels."""
    return closed_fixes(w.theirs_all.withColumn("type", F.col("task_type")))


def _our_fixes(w: Warehouse) -> DataFrame:
    return closed_fixes(w.ours_agents)


def gap_agent_mix(w: Warehouse) -> DataFrame:
    """Share and rate of each agent on both sides."""

    def side(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy("agent").agg(*outcome_columns())
        rated = share_of_all(counts, "total", f"{name}_pct", 1).withColumn(
            f"{name}_rate", percent(F.col("merged"), F.col("total"), 1)
        )
        return rated.select("agent", f"{name}_pct", f"{name}_rate")

    return side(_their_fixes(w), "their").join(side(_our_fixes(w), "our"), "agent", "outer").na.fill(0.0)


def gap_cuts(w: Warehouse) -> DataFrame:
    """Counts and rates of both sides in every cut of the gap study, one aggregate per side."""
    ours, theirs = _our_fixes(w), _their_fixes(w)
    first, last = (theirs.agg(f("created_at")).scalar() for f in (F.min, F.max))

    def flagged(df: DataFrame, other: DataFrame) -> DataFrame:
        rows = df.select(KEY, "repo_name", "created_at", "is_merged")
        return membership(membership(rows, other, [KEY], "same_key", split_hot=False), other, ["repo_name"], "shared_repo")

    def counted(df: DataFrame, cuts: dict[str, Column]) -> DataFrame:
        totals = df.agg(
            *[F.struct(F.lit(name).alias("cut"), F.count_if(keep).alias("total"), F.count_if(keep & is_merged()).alias("merged")).alias(f"c{i}")
              for i, (name, keep) in enumerate(cuts.items())]
        )
        return totals.select(F.inline(F.array(*totals.columns)))

    both, shared, everything = F.col("same_key"), F.col("shared_repo"), F.lit(True)
    their_cuts = counted(flagged(theirs, ours), {"their all": everything, "their shared repos": shared, "their same keys": both})
    our_rows = flagged(ours, theirs).withColumns({"within": F.col("created_at").between(first, last), "beyond": F.col("created_at") > last})
    our_cuts = counted(
        our_rows,
        {
            "our all": everything, "our within their range": F.col("within"), "our beyond their range": F.col("beyond"),
            "our shared repos": shared, "our same keys": both, "our other keys": ~both,
        },
    )
    return their_cuts.unionByName(our_cuts).withColumn("rate", percent(F.col("merged"), F.col("total"), 4))


def gap_exclusive_agents(w: Warehouse) -> DataFrame:
    ours = _our_fixes(w).join(_their_fixes(w).select(KEY), KEY, "left_anti")
    return rounded(acceptance(ours, "agent"), 4, "acceptance_rate")


def gap_disagreement(w: Warehouse) -> DataFrame:
    pairs = paired(_their_fixes(w), _our_fixes(w), KEY, ["is_merged"], ["id"], ("their_", "our_"))
    return rounded(agreement(pairs, "their_is_merged", "our_is_merged"), 4, "agree_pct")


def column_values(w: Warehouse) -> DataFrame:
    """Value counts of the label columns, one row per (column, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("type", "source", "agent", "state")])
    return w.prs.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


# Repository dimension and work lists


def repository_export(w: Warehouse) -> DataFrame:
    """Pull requests per repository with metadata where known and names recovered from addresses elsewhere."""
    per_repo = w.theirs_all.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("pr_count"),
        F.min_by("repo_url", F.when(F.col("repo_url").isNotNull(), F.col("id"))).alias("repo_url"),
        F.min_by("html_url", F.when(F.col("html_url").isNotNull(), F.col("id"))).alias("html_url"),
    )
    joined = per_repo.join(w.repositories.withColumn("in_metadata", F.lit(True)), "repo_id", "left")
    return joined.select(
        "repo_id",
        recover_name(F.col("full_name"), F.col("html_url"), F.col("repo_url")).alias("repository"),
        "pr_count",
        F.coalesce("in_metadata", F.lit(False)).alias("in_metadata"),
        "language", "license", "stars", "forks", "repo_url",
        canonical_url(F.col("html_url")).alias("html_url"),
    ).orderBy(F.desc("pr_count"), "repository")


def repository_export_stats(w: Warehouse) -> DataFrame:
    table = overlap(w.theirs_all.select("repo_id"), w.repositories.select("repo_id"), "repo_id")
    exported = repository_export(w)
    recovered = exported.where("repository <> 'Unknown' AND NOT in_metadata").agg(F.count(F.lit(1))).scalar()
    return table.select(
        F.col("b_keys").alias("in_metadata"), F.col("a_keys").alias("with_prs"), "overlap", F.col("only_a").alias("missing"),
        np_round(F.col("pct_of_a"), 4).alias("coverage_pct"),
    ).withColumn("recovered", recovered)


def missing_work_list(w: Warehouse) -> DataFrame:
    """Repositories with target-agent rows on the other side that we have not collected, most expected rows first."""
    wanted = w.theirs_all.where(F.col("agent").isin(*AGENTS))
    return work_list(wanted.dropna(subset=["repo_name"]), w.prev.where("is_agent"), "repo_name")


def one_month_validation(w: Warehouse) -> DataFrame:
    """Coverage of the other side's agent repositories by one month of ours."""
    month = w.ours.where(F.col("month") == "1996-01")
    counts = month.agg(F.count(F.lit(1)).alias("total_prs"), F.count_if("is_agent").alias("agent_prs"))
    repos = overlap(month.where("is_agent"), w.theirs_all, "repo_id")
    return repos.select(
        F.col("a_keys").alias("our_repos"), F.col("b_keys").alias("their_repos"), "overlap",
        percent(F.col("overlap"), F.col("b_keys"), 4, empty=0.0).alias("coverage_pct"),
    ).withColumns({c: counts.select(c).scalar() for c in ("total_prs", "agent_prs")})


# Matched cohorts


COHORT = ("id", "source", "agent", "created_at", "state", "is_merged")


def _cohort_report(w: Warehouse, cohort: DataFrame) -> DataFrame:
    """Outcome, timing and revision summary of a cohort per report row."""
    timed = w.closed(stored(cohort.select(*COHORT), "cohort"))
    commits = commits_per_pr(w.commits).withColumnRenamed("pr_id", "id")
    rows = timed.join(commits, "id", "left").select(
        F.explode(categories()).alias("category"), "is_merged", "hours_to_merge",
        F.when(F.col("is_merged"), F.col("num_commits")).alias("num_commits"),
    )
    counts = value_counts(rows, ["category"], ["is_merged", "hours_to_merge", "num_commits"])
    table = counts.groupBy("category").agg(
        rows_of("is_merged").alias("total"), rows_of("is_merged", F.col("value") == 1.0).alias("merged"),
        percent(rows_of("num_commits", F.col("value") == 1.0), rows_of("num_commits")).alias("single_pct"),
    )
    medians = quantiles_of_counts(counts, ["category"], median_hours=("hours_to_merge", 0.5))
    return rounded(with_rates(table).join(medians, "category", "left"), 4, "acceptance_rate", "median_hours", "single_pct")


def _size_matched(w: Warehouse) -> DataFrame:
    agents = w.fixes.where(agent_side())
    humans, _ = matched(agents, w.fixes.where(~agent_side()), [], "id")
    return agents.unionByName(humans)


def matched_report(w: Warehouse) -> DataFrame:
    return _cohort_report(w, _size_matched(w))


def matched_tests(w: Warehouse) -> DataFrame:
    cohort = stored(_size_matched(w).select(*COHORT), "cohort")
    rate = chi_square(cohort, [], agent_side(), is_merged()).select(F.lit("acceptance").alias("test"), "chi2", "p", "sig")
    time = log_rank(w.closed(cohort), [], agent_side(), "hours_open", is_merged()).select(
        F.lit("merge time").alias("test"), "chi2", "p", "sig"
    )
    return rounded(rounded(rate.unionByName(time), 4, "chi2"), 6, "p")


def _month_matched(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Agents: labelled by the other side in its months, by our classifier in later ones; humans matched per month."""
    ours = closed_fixes(w.ours)
    agents = ours.where(agent_side())
    by_key = agents.join(_their_fixes(w).select(KEY), KEY, "left_semi")
    months = by_key.select("month").distinct()
    later = agents.join(months, "month", "left_anti")
    columns = [*COHORT, "month", "repo_name"]
    cohort = stored(by_key.select(*columns).unionByName(later.select(*columns)), "agents")
    pool = in_shared_repos(ours.where(~agent_side()), cohort)
    humans, shortfall = matched(cohort, pool, ["month"], "id")
    return cohort.unionByName(humans.select(*columns)), shortfall


def month_matched_report(w: Warehouse) -> DataFrame:
    return _cohort_report(w, _month_matched(w)[0])


def month_matched_shortfall(w: Warehouse) -> DataFrame:
    return _month_matched(w)[1]


def _placed_fixes(w: Warehouse) -> DataFrame:
    """Our fixes with everything the cohorts differ in, stored once: shared key, shared repository, and time."""
    ours, theirs = _our_fixes(w), _their_fixes(w)
    first, last = (theirs.agg(f("created_at")).scalar() for f in (F.min, F.max))
    rows = ours.select("id", "agent", "is_merged", "created_at", "repo_name", KEY)
    placed = membership(membership(rows, theirs, [KEY], "same_key", split_hot=False), theirs, ["repo_name"], "their_repo")
    until = F.lit("2001-02-28").cast("timestamp")
    timed = placed.withColumn(
        "time",
        F.when(F.col("created_at").between(first, last), "period").when((F.col("created_at") > last) & (F.col("created_at") <= until), "rest"),
    )
    return stored(timed.drop("created_at", KEY), "placed")


def _matched_rest(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a shared key, and later rows of the repositories those are in."""
    same = placed.where("same_key")
    return same, in_shared_repos(placed.where("time = 'rest'"), same).select(*placed.columns)


def cohort_ladder(w: Warehouse) -> DataFrame:
    """Acceptance per agent and overall in cohorts that each change one thing from the one before."""
    placed = _placed_fixes(w)
    same, later = _matched_rest(placed)
    cohorts = {
        "matched keys": same,
        "period in their repos": placed.where("their_repo AND time = 'period'"),
        "rest in their repos": placed.where("their_repo AND time = 'rest'"),
        "rest in matched repos": later,
        "rest with matched mix": matched(same, later, ["agent"], "id")[0],
    }
    parts = [acceptance(df, "agent", "OVERALL").withColumn("cohort", F.lit(name)) for name, df in cohorts.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return rounded(table, 4, "acceptance_rate")


def stratified_shortfall(w: Warehouse) -> DataFrame:
    same, later = _matched_rest(_placed_fixes(w))
    return matched(same, later, ["agent"], "id")[1]


def own_vs_external(w: Warehouse) -> DataFrame:
    """Totals and rates per agent on both sides and the difference in points."""
    stacked = _their_by_title(w).select("agent", "is_merged", F.lit("their").alias("side")).unionByName(
        _our_fixes(w).select("agent", "is_merged", F.lit("our").alias("side"))
    ).where(F.col("agent").isin(*AGENTS))

    def count(side: str, extra: Column = F.lit(True)) -> Column:
        return F.count_if((F.col("side") == side) & extra)

    counts = stacked.groupBy("agent").agg(
        count("their").alias("their_total"), count("their", is_merged()).alias("their_merged"),
        count("our").alias("our_total"), count("our", is_merged()).alias("our_merged"),
    )
    full = with_total_row(counts, "agent", "ALL AGENTS", ("their_total", "their_merged", "our_total", "our_merged"))
    rated = full.withColumns(
        {
            "their_rate": percent(F.col("their_merged"), F.col("their_total"), empty=0.0),
            "our_rate": percent(F.col("our_merged"), F.col("our_total"), empty=0.0),
        }
    ).withColumn("diff_pp", F.col("our_rate") - F.col("their_rate"))
    return rounded(rated, 4, "their_rate", "our_rate", "diff_pp")


def _their_by_title(w: Warehouse) -> DataFrame:
    return closed_fixes(w.theirs_all)


def id_overlap_rates(w: Warehouse) -> DataFrame:
    """Id overlap of both sides' fixes and each side's acceptance on the shared ids, from one tagged aggregate."""
    stacked = _their_by_title(w).select("id", "is_merged", F.lit(False).alias("mine")).unionByName(
        _our_fixes(w).select("id", "is_merged", F.lit(True).alias("mine"))
    )
    per_id = stacked.groupBy("id").agg(
        F.count_if("mine").alias("a"), F.count_if(~F.col("mine")).alias("b"),
        F.count_if(F.col("mine") & is_merged()).alias("am"), F.count_if(~F.col("mine") & is_merged()).alias("bm"),
    )
    both = (F.col("a") > 0) & (F.col("b") > 0)

    def over_both(column: str) -> Column:
        return F.sum(F.when(both, F.col(column)))

    return per_id.agg(
        F.count_if(F.col("b") > 0).alias("their_ids"), F.count_if(F.col("a") > 0).alias("our_ids"),
        F.count_if(both).alias("overlap"), F.count_if(F.col("a") == 0).alias("only_their"),
        F.count_if(F.col("b") == 0).alias("only_our"),
        np_round(ratio(over_both("bm"), over_both("b")) * 100, 4).alias("their_rate"),
        np_round(ratio(over_both("am"), over_both("a")) * 100, 4).alias("our_rate"),
    )


PLANS = {
    "q21_dataset_overlap": dataset_overlap,
    "q21_repository_overlap": repository_overlap,
    "q22_overlap_by_agent": overlap_by_agent,
    "q22_overlap_by_repo": overlap_by_repo,
    "q22_repo_overlap_histogram": repo_overlap_histogram,
    "q22_overlap_by_month": overlap_by_month,
    "q22_missing_repositories": missing_repositories,
    "q22_exclusive_time_ranges": exclusive_time_ranges,
    "q23_agent_crosstab": agent_crosstab,
    "q23_state_crosstab": state_crosstab,
    "q23_label_agreement": label_agreement,
    "q23_merge_agreement": merge_agreement,
    "q24_coverage_by_agent": coverage_by_agent,
    "q24_coverage_summary": coverage_summary,
    "q25_missed_and_extra": missed_and_extra,
    "q25_missed_repositories": missed_repositories,
    "q26_repo_coverage": repo_coverage,
    "q26_status_breakdown": status_breakdown,
    "f13_ordered_status": ordered_status,
    "j12_key_or_commit_match": key_or_commit_match,
    "e06_overlap_per_group": overlap_per_group,
    "q27_monthly_coverage": monthly_coverage,
    "q27_merged_runs": merged_runs,
    "q28_agent_coverage": agent_coverage,
    "q29_dual_key_overlap": dual_key_overlap,
    "q29_dual_key_deep_dive": dual_key_deep_dive,
    "q29_shared_commit_pairs": shared_commit_pairs,
    "q30_gap_agent_mix": gap_agent_mix,
    "q30_gap_cuts": gap_cuts,
    "q30_gap_exclusive_agents": gap_exclusive_agents,
    "q30_gap_disagreement": gap_disagreement,
    "q30_column_values": column_values,
    "q31_repository_export": repository_export,
    "q31_repository_export_stats": repository_export_stats,
    "q32_matched_report": matched_report,
    "q32_matched_tests": matched_tests,
    "q32_month_matched_report": month_matched_report,
    "q32_month_matched_shortfall": month_matched_shortfall,
    "q33_cohort_ladder": cohort_ladder,
    "q33_stratified_shortfall": stratified_shortfall,
    "q34_own_vs_external": own_vs_external,
    "q34_id_overlap_rates": id_overlap_rates,
    "q35_missing_work_list": missing_work_list,
    "q36_one_month_validation": one_month_validation,
}
