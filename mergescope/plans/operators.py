"""One query per operator that the reports do not already show on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.config import AGENTS, EXCLUDED_AGENT, HUMAN, HUMAN_GROUP
from mergescope.functions.clock import day_text, hours_between, month_text, parse_utc, period_of
from mergescope.functions.numeric import chi_square_p, clip, log10_scale, np_round, pct_modification, percent, ratio, stars
from mergescope.functions.text import match_key, remove_prefix
from mergescope.operators.aggregates import (
    SKETCH_CELLS, acceptance, crosstab, distinct_count, distinct_sketches, grouped_rate, period_change, pivot_common, pivot_counts,
    share, share_of_all, sketched_count, sum_or_zero, top_k, value_totals, with_total_row, work_list,
)
from mergescope.operators.filters import closed_fixes, differs, in_window, min_size
from mergescope.operators.joins import fan_out, first_known, keep_first, lookup, membership, outer_counts, prefixed
from mergescope.operators.overlap import tag
from mergescope.operators.quantiles import approximate_quantiles, box_stats, clip_at_quantile, histogram, quantiles
from mergescope.operators.ranking import hashed_row_number, top_rows
from mergescope.operators.revisions import first_commits
from mergescope.operators.sampling import matched, sample_n
from mergescope.operators.stats import chi_square, log_rank, mann_whitney
from mergescope.plans.reports import rounded
from mergescope.schema import normalize_prs
from mergescope.session import stored
from mergescope.sources.readers import explode_status, load_table, only_values, status_documents, status_entries
from mergescope.sources.sinks import compact, report, report_rows, schema_diff, write_by_source, write_csv, write_preview
from mergescope.sources.warehouse import COMMIT_ORDER, CUTOFF, Warehouse
from mergescope.streaming.incremental import run_folder



def n() -> Column:
    return F.count(F.lit(1)).alias("n")


# Scans and sinks


def pruned_scan(w: Warehouse) -> DataFrame:
    return w.table("lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(
        n(), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )


def pushed_in_list(w: Warehouse) -> DataFrame:
    return only_values(w.table("customer"), "c_mktsegment", ("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


def filtered_scan(w: Warehouse) -> DataFrame:
    """The closed-fix rows of the whole table in one pass over its splits."""
    return closed_fixes(w.prs).groupBy("agent", "month").agg(n())


def status_document(w: Warehouse) -> DataFrame:
    """Status lists exploded from one small document per customer."""
    balance = F.col("c_acctbal")
    name = F.col("c_name")

    def listed(condition: Column) -> Column:
        return F.array_compact(F.array(F.when(condition, name)))

    document = w.table("customer").select(
        listed(balance < -500).alias("errors"), listed(balance > 9000).alias("not_found"), listed(balance > 0).alias("done_repos")
    )
    return explode_status(document).groupBy("list").agg(n())


def status_documents_read(w: Warehouse) -> DataFrame:
    """Status documents of a thousand customers at most, written as JSON over several lines and read again.

    Their fields drift: errors are names, or objects with a name and a reason, and a list of one is a bare name. Documents
    of two nations are cut off and go to the side.
    """
    balance, name, nation = F.col("c_acctbal"), F.col("c_name"), F.col("c_nationkey")

    def listed(condition: Column) -> Column:
        return F.collect_list(F.when(condition, name))

    described = F.collect_list(F.when(balance < -500, F.struct(name.alias("name"), F.lit("timeout").alias("reason"))))
    lists = w.table("customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        listed(balance < -500).alias("errors"), described.alias("described"), listed(balance > 9000).alias("not_found"), listed(balance > 0).alias("done_repos")
    )
    plain = F.to_json(F.struct("errors", "not_found", "done_repos", F.size("done_repos").alias("total_prs")), {"pretty": "true"})
    other = F.to_json(
        F.struct(F.col("described").alias("errors"), F.element_at(F.concat("not_found", F.array(F.lit(None).cast("string"))), 1).alias("not_found"), "done_repos"),
        {"pretty": "true"},
    )
    text = F.when(nation % 12 == 5, F.substring(plain, 1, 20)).when(nation % 2 == 0, plain).otherwise(other)
    folder = run_folder(w.spark, "status")
    lists.select(text.alias("text"), "c_nationkey", "part").write.partitionBy("c_nationkey", "part").text(folder)
    good, bad = status_documents(w.spark, folder)
    counted = status_entries(good).groupBy("list").agg(n())
    return counted.unionByName(bad.select(F.lit("unreadable").alias("list"), F.lit(1).alias("one")).groupBy("list").agg(n()))


def csv_by_suffix(w: Warehouse) -> DataFrame:
    """The closed fixes written as CSV and read back through the suffix of their path."""
    path = f"{run_folder(w.spark, 'csv')}/fixes.csv"
    write_csv(w.fixes.select("id", "agent", "title", (F.col("amount") / 7).alias("amount")), path, ["id"], {"amount": 2})
    back = load_table(w.spark, path, ["agent", "title", "amount"])
    return back.groupBy("agent").agg(n(), F.min("title").alias("first_title"), F.max(F.col("amount").cast("double")).alias("amount"))


def compacted(w: Warehouse) -> DataFrame:
    """Many small files of two schemas rewritten under the unified one."""
    folder = run_folder(w.spark, "chunks")
    chunks = w.prs.select("id", "agent", "month", "amount")
    chunks.where("amount < 250000").drop("amount").repartition(8).write.parquet(f"{folder}/chunks/part=1")
    chunks.where("amount >= 250000").repartition(8).write.parquet(f"{folder}/chunks/part=2")
    compact(w.spark, f"{folder}/chunks", f"{folder}/one")
    return w.spark.read.parquet(f"{folder}/one").groupBy("agent").agg(n(), F.count("amount").alias("with_amount"), F.max("month").alias("last_month"))


def split_by_source(w: Warehouse) -> DataFrame:
    """One write split by source, of which only the agent folder is read back."""
    folder = run_folder(w.spark, "split")
    write_by_source(w.prs.select("id", "agent", "source"), folder)
    return w.spark.read.parquet(folder).where("source = 'agent'").groupBy("source", "agent").agg(n(), F.sum("id").alias("ids"))


def preview(w: Warehouse) -> DataFrame:
    folder = run_folder(w.spark, "preview")
    write_preview(w.prs.select("id", "title"), folder, "id")
    return w.spark.read.csv(folder, header=True, schema="id long, title string")


def schema_difference(w: Warehouse) -> DataFrame:
    """Columns of two tables that share some names."""
    return schema_diff(w.table("documents"), w.table("labels"))


def report_long(w: Warehouse) -> DataFrame:
    by_agent = acceptance(w.fixes, "agent")
    by_source = acceptance(w.fixes, "source", "all")
    return rounded(
        report([
            report_rows("agents", by_agent, "agent", ("total", "merged", "acceptance_rate")),
            report_rows("sources", by_source, "source", ("total", "rejected")),
        ]), 4, "value",
    )


def normalized(w: Warehouse) -> DataFrame:
    """Loose text columns brought to the common schema: bad numbers and times become NULL."""
    loose = w.table("orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lit("x12")).otherwise(F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("https://api.github.com/repos/acme/"), F.col("o_custkey").cast("string")).alias("repo_url"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon").alias("merged_at"),
        (F.col("o_orderstatus") == "O").alias("is_agent"),
    )
    return normalize_prs(loose).groupBy("source", "is_merged").agg(
        n(), F.count("id").alias("ids"), F.count("merged_at").alias("merged"), F.min("match_key").alias("first_key"),
        F.count("title").alias("titles"), F.sum("id").alias("id_sum"),
    )


# Filters and predicates


def equality_filter(w: Warehouse) -> DataFrame:
    return w.prs.where("type = 'fix' AND state = 'closed'").groupBy("agent").agg(n())


def _with_missing_agent(w: Warehouse) -> DataFrame:
    return w.prs.withColumn("agent", F.when(F.col("state") == "open", F.lit(None)).otherwise(F.col("agent")))


def differs_keeps_null(w: Warehouse) -> DataFrame:
    return _with_missing_agent(w).where(differs(F.col("agent"), EXCLUDED_AGENT)).groupBy("agent").agg(n())


def in_and_not_in(w: Warehouse) -> DataFrame:
    return w.prs.groupBy("state").agg(
        F.count_if(F.col("agent").isin(*AGENTS)).alias("studied"), F.count_if(~F.col("agent").isin(*AGENTS)).alias("others")
    )


def outcome_flag(w: Warehouse) -> DataFrame:
    timed = w.closed(w.prs).withColumn("accepted", F.col("merged_at").isNotNull())
    return timed.groupBy("accepted", "state").agg(n())


def inclusive_window(w: Warehouse) -> DataFrame:
    low, high = F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")
    return in_window(w.prs, "created_at", low, high).groupBy("month").agg(n())


def open_start_window(w: Warehouse) -> DataFrame:
    last = w.theirs.agg(F.max("created_at")).scalar()
    after = in_window(w.ours, "created_at", low=last, high=F.lit("2000-02-28").cast("timestamp"), closed="right")
    return after.groupBy("agent").agg(n())


def text_date_window(w: Warehouse) -> DataFrame:
    """Dates as ISO text compared as text."""
    text = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return w.prs.withColumn("text", text).where("text >= '1997-03-01' AND text <= '1997-05-31T23:59:59Z'").groupBy("month").agg(n())


def size_gate(w: Warehouse) -> DataFrame:
    """Rate per repository, NULL under eight rows."""
    rate = percent(F.count_if("is_merged"), F.count(F.lit(1)))
    return w.prs.groupBy("repo_name").agg(n(), np_round(min_size(rate, 8), 4).alias("rate"))


def filled_nulls(w: Warehouse) -> DataFrame:
    joined = w.prs.select("id", "repo_id").join(w.repositories, "repo_id", "left").na.fill({"full_name": "Unknown", "stars": 0})
    return joined.groupBy("full_name").agg(n(), F.sum("stars").alias("stars"))


def safe_casts(w: Warehouse) -> DataFrame:
    """Text of which some rows hold no number or no time."""
    rows = w.table("events").select(
        "event_type",
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("user_id").cast("string")).try_cast("bigint").alias("number"),
        parse_utc(F.when(F.col("event_type") == "view", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("time"),
    )
    return rows.groupBy("event_type").agg(n(), F.sum("number").alias("numbers"), F.count("time").alias("times"), day_text(F.max("time")).alias("last_day"))


def two_branch_label(w: Warehouse) -> DataFrame:
    return w.prs.select(F.when(F.col("source") == "agent", F.col("agent")).otherwise(HUMAN_GROUP).alias("group")).groupBy("group").agg(n())


def period_buckets(w: Warehouse) -> DataFrame:
    return w.prs.groupBy(period_of(F.col("created_at"), CUTOFF).alias("period")).agg(n(), day_text(F.max("created_at")).alias("last_day"))


def prefixed_columns(w: Warehouse) -> DataFrame:
    return prefixed(w.table("nation").withColumnRenamed("n_nationkey", "key").drop("n_regionkey"), ["key"], "our_")


def rows_with_key(w: Warehouse) -> DataFrame:
    joined = w.prs.select("repo_id").join(w.repositories, "repo_id", "left")
    return joined.dropna(subset=["full_name"]).groupBy("language").agg(n())


def clipped_values(w: Warehouse) -> DataFrame:
    fixed = w.timed_fixes.withColumn("capped", clip(F.col("hours_to_merge"), low=24.0, high=480.0))
    return rounded(
        quantiles(fixed.where("group IS NOT NULL"), ["group"], low=("capped", 0.0), median=("capped", 0.5), high=("capped", 1.0)),
        4, "median", "low", "high",
    )


def clipped_at_quantile(w: Warehouse) -> DataFrame:
    capped = clip_at_quantile(w.timed_fixes.where("is_merged AND group IS NOT NULL").select("group", "hours_to_merge"), ["group"], "hours_to_merge", 0.95, "capped")
    return rounded(capped.groupBy("group").agg(n(), F.max("capped").alias("largest")), 4, "largest")


def safe_ratios(w: Warehouse) -> DataFrame:
    """Merged per open pull request; repositories without an open one give NULL, or zero when filled."""
    counts = w.prs.groupBy("repo_id").agg(F.count_if("is_merged").alias("merged"), F.count_if(F.col("state") == "open").alias("open"))
    return counts.select(
        "repo_id", np_round(ratio(F.col("merged"), F.col("open")), 6).alias("ratio"),
        np_round(ratio(F.col("merged"), F.col("open"), empty=0.0), 6).alias("ratio_or_zero"),
    )


# Joins


def inner_join_labels(w: Warehouse) -> DataFrame:
    labels = w.prs.select("id", F.col("task_type").alias("label")).where("label = 'fix'")
    return w.prs.join(labels, "id").groupBy("agent", "state").agg(n())


def left_join_metrics(w: Warehouse) -> DataFrame:
    per_pr = w.details.groupBy(F.col("pr_id").alias("id")).agg(F.sum("additions").alias("added"))
    joined = w.prs.select("id", "agent").join(per_pr, "id", "left")
    return joined.groupBy("agent").agg(n(), F.count("added").alias("with_lines"), F.sum("added").alias("added"))


def semi_join_keys(w: Warehouse) -> DataFrame:
    return w.ours.join(w.theirs.select("match_key"), "match_key", "left_semi").groupBy("agent").agg(n())


def anti_join_keys(w: Warehouse) -> DataFrame:
    return w.ours.join(w.theirs.select("match_key"), "match_key", "left_anti").groupBy("agent").agg(n())


def composite_semi_join(w: Warehouse) -> DataFrame:
    return w.theirs_all.join(w.ours.select("repo_id", "number"), ["repo_id", "number"], "left_semi").groupBy("agent").agg(n())


def dictionary_lookup(w: Warehouse) -> DataFrame:
    names = lookup(w.prs.select("id", "repo_id"), w.repositories.select("repo_id", "full_name"), ["repo_id"], [F.col("full_name")], {"full_name": "Unknown"})
    return names.groupBy("full_name").agg(n())


def star_of_aggregates(w: Warehouse) -> DataFrame:
    """Per-repository counts of several kinds from one conditional aggregate."""
    return w.prs.groupBy("repo_name").agg(
        n(), F.count_if("is_agent").alias("agents"), F.count_if("is_merged").alias("merged"), F.count_if(F.col("type") == "fix").alias("fixes"),
        F.countDistinct("agent").alias("groups"),
    )


def outer_aligned_counts(w: Warehouse) -> DataFrame:
    ours = w.ours.groupBy("repo_name").agg(F.count(F.lit(1)).alias("ours"))
    theirs = w.theirs.groupBy("repo_name").agg(F.count(F.lit(1)).alias("theirs"))
    return outer_counts([ours, theirs], ["repo_name"])


def commit_fan_out(w: Warehouse) -> DataFrame:
    """Every commit's file rows repeated for each pull request that holds the commit."""
    one = keep_first(w.details, ["sha"], [F.col("pr_id"), F.col("filename"), F.col("additions"), F.col("deletions")])
    return fan_out(one, w.commits).groupBy("pr_id").agg(n(), F.sum("additions").alias("additions"))


def suffixed_pairs(w: Warehouse) -> DataFrame:
    left = keep_first(w.ours.select("match_key", "agent", "id"), ["match_key"], [F.col("id")])
    right = keep_first(w.theirs_all.select("match_key", "agent", "id"), ["match_key"], [F.col("id")])
    pairs = prefixed(left, ["match_key"], "our_").join(prefixed(right, ["match_key"], "their_"), "match_key")
    return pairs.groupBy("our_agent", "their_agent").agg(n())


def membership_flag(w: Warehouse) -> DataFrame:
    return membership(w.theirs_all, w.ours, ["match_key"], "in_ours").groupBy("in_ours", "agent").agg(n())


def first_known_repo(w: Warehouse) -> DataFrame:
    """Metadata name of each commit's first pull request that has one."""
    named = w.prs.select(F.col("id").alias("pr_id"), "repo_id").join(w.repositories.select("repo_id", "full_name"), "repo_id").drop("repo_id")
    links = w.commits.select("sha", "pr_id", *COMMIT_ORDER)
    return first_known(links, named, "pr_id", "sha", "full_name", ["pr_id", *COMMIT_ORDER]).groupBy("full_name").agg(n())


# Aggregates


def group_count(w: Warehouse) -> DataFrame:
    return w.prs.groupBy("repo_name", "source").agg(n())


def value_counts_no_null(w: Warehouse) -> DataFrame:
    return value_totals(_with_missing_agent(w), "agent")


def date_range(w: Warehouse) -> DataFrame:
    return w.prs.agg(day_text(F.min("created_at")).alias("first_day"), day_text(F.max("created_at")).alias("last_day"))


def sums_of_nothing(w: Warehouse) -> DataFrame:
    """Line sums per pull request; without any file row they are zero."""
    return w.details.groupBy("pr_id").agg(sum_or_zero(F.col("additions")).alias("added"), sum_or_zero(F.col("deletions")).alias("deleted"))


def distinct_per_group(w: Warehouse) -> DataFrame:
    joined = w.commits.join(w.prs.select(F.col("id").alias("pr_id"), "agent"), "pr_id")
    return distinct_count(joined, ["agent"], "author", "authors")


def exact_medians(w: Warehouse) -> DataFrame:
    return rounded(
        quantiles(w.table("lineitem"), ["l_returnflag"], median_price=("l_extendedprice", 0.5), median_quantity=("l_quantity", 0.5)),
        4, "median_price", "median_quantity",
    )


def exact_upper_quantiles(w: Warehouse) -> DataFrame:
    return rounded(
        quantiles(w.table("events"), ["event_type"], p05=("value", 0.05), p95=("value", 0.95), p99=("value", 0.99)), 4, "p05", "p95", "p99"
    )


def near_quantiles(w: Warehouse) -> DataFrame:
    """Approximate medians, checked against the exact ones within one per cent of the ranks."""
    near = approximate_quantiles(w.table("lineitem"), ["l_returnflag"], median_price=("l_extendedprice", 0.5))
    fences = quantiles(w.table("lineitem"), ["l_returnflag"], low=("l_extendedprice", 0.49), high=("l_extendedprice", 0.51))
    close = F.col("median_price").between(F.col("low"), F.col("high")).alias("close")
    return rounded(near.join(fences, "l_returnflag").select("l_returnflag", "low", "high", close), 4, "low", "high")


def boolean_mean(w: Warehouse) -> DataFrame:
    return w.prs.groupBy("agent").agg(np_round(F.avg(F.col("is_merged").cast("double")) * 100, 4).alias("rate"))


def outcome_table(w: Warehouse) -> DataFrame:
    return rounded(acceptance(w.prs.where("state = 'closed'"), "agent"), 4, "acceptance_rate")


def two_key_rates(w: Warehouse) -> DataFrame:
    return rounded(grouped_rate(w.prs, ["month", "agent"]), 4, "rate")


def first_per_group(w: Warehouse) -> DataFrame:
    """First commit in order, and the first known file, of each pull request."""
    return keep_first(
        w.details.join(w.commits.select("sha", "pr_id", *COMMIT_ORDER).distinct(), ["sha", "pr_id"]).select("pr_id", "sha", "filename", *COMMIT_ORDER),
        ["pr_id"], [F.col(c) for c in (*COMMIT_ORDER, "filename")], first_non_null=True,
    ).select("pr_id", "sha", "filename")


def pull_requests_per_commit(w: Warehouse) -> DataFrame:
    """How many pull requests hold each shared commit, without gathering them in one row."""
    held = distinct_count(w.commits, ["sha"], "pr_id", "prs")
    return held.groupBy("prs").agg(n())


def commit_holders(w: Warehouse) -> DataFrame:
    """Every commit with each pull request that holds it and the number of them, one row for each pair."""
    held = w.commits.select("sha", "pr_id").distinct()
    return held.join(held.groupBy("sha").agg(F.count(F.lit(1)).alias("prs")), "sha")


def pivot_zero_filled(w: Warehouse) -> DataFrame:
    return pivot_counts(w.prs, "month", "agent", (*AGENTS, EXCLUDED_AGENT, HUMAN))


def pivot_of_the_most_common(w: Warehouse) -> DataFrame:
    """Rows a month for the three most common authors' groups, all others together, and the sum; one line a column."""
    wide = pivot_common(w.prs, "month", "agent", 3)
    return wide.unpivot("month", [c for c in wide.columns if c != "month"], "agent", "n")


def sketched_distinct(w: Warehouse) -> DataFrame:
    """Users per kind of event: exact, and from stored sketches of each day, within three standard errors."""
    events = w.table("events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    daily = stored(distinct_sketches(events, ["event_type", "day"], "user_id"), "sketches")
    both = distinct_count(events, ["event_type"], "user_id", "users").join(sketched_count(daily, ["event_type"], "estimate"), "event_type")
    bound = 3 * 1.04 / 2 ** (SKETCH_CELLS / 2)
    return both.select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.col("users") * bound + 1).alias("within"))


def pivot_null_kept(w: Warehouse) -> DataFrame:
    return pivot_counts(w.prs.where("type = 'other'"), "repo_name", "agent", AGENTS, fill=None)


def crosstab_margins(w: Warehouse) -> DataFrame:
    return crosstab(w.prs, "agent", "task_type", ("chore", "docs", "feat", "fix", "other", "refactor", "test"))


def total_row(w: Warehouse) -> DataFrame:
    return with_total_row(w.prs.groupBy("agent").agg(n(), F.count_if("is_merged").alias("merged")), "agent", "TOTAL", ("n", "merged"))


def conditional_counts(w: Warehouse) -> DataFrame:
    return w.prs.groupBy("month").agg(
        F.count_if(F.col("is_agent")).alias("agents"), F.count_if(~F.col("is_agent")).alias("humans"),
        F.countDistinct(F.when(F.col("is_merged"), F.col("repo_name"))).alias("merging_repos"),
    )


def share_of_total(w: Warehouse) -> DataFrame:
    return share_of_all(w.prs.groupBy("agent").agg(n()), "n", digits=2)


def twenty_bins(w: Warehouse) -> DataFrame:
    return rounded(histogram(w.table("events"), "value"), 6, "bin_low", "bin_high")


def box_per_group(w: Warehouse) -> DataFrame:
    return rounded(box_stats(w.table("events"), ["event_type"], "value"), 4, "q1", "median", "q3")


def log_distribution(w: Warehouse) -> DataFrame:
    """Equal-width bins of log lines per source."""
    lines = w.details.groupBy(F.col("pr_id").alias("id")).agg(F.sum("additions").alias("added"))
    logs = w.prs.select("id", "source").join(lines, "id").withColumn("log_added", log10_scale(F.col("added")))
    return histogram(logs, "log_added", by=["source"]).select("source", "bin", "rows")


# Windows, ordering and sets


def first_commit_rows(w: Warehouse) -> DataFrame:
    return first_commits(w.commits, COMMIT_ORDER)


def monthly_shares(w: Warehouse) -> DataFrame:
    return share(w.prs.groupBy("month", "agent").agg(n()), ["month"], "n", digits=2)


def stratum_ranks(w: Warehouse) -> DataFrame:
    return hashed_row_number(w.prs.select("id", "agent"), ["agent"], "id", "position", ":42")


def mid_ranks(w: Warehouse) -> DataFrame:
    """Rank sum of the agent rows, the quantity behind the U test."""
    tested = mann_whitney(w.timed_fixes.where("is_merged"), [], F.col("source") == "agent", "hours_to_merge")
    return tested.select("n1", "n2", (F.col("u") + F.col("n1") * (F.col("n1") + 1) / 2).alias("rank_sum"))


def at_risk_by_group(w: Warehouse) -> DataFrame:
    """Log-rank of every agent before and after the cutoff."""
    agents = w.timed_fixes.where(F.col("agent").isin(*AGENTS))
    tested = log_rank(agents, ["agent"], F.col("period") == "before", "hours_open", F.col("is_merged"))
    return rounded(tested.select("agent", "n1", "n2", "observed", "expected", "chi2", "sig"), 4, "expected", "chi2")


def period_points(w: Warehouse) -> DataFrame:
    rates = grouped_rate(w.fixes, ["agent", "period"])
    return rounded(period_change(rates, "agent", "period", "rate", "before", "after"), 4, "before", "after", "change_pp")


def sorted_groups(w: Warehouse) -> DataFrame:
    return w.prs.groupBy("repo_name", "agent").agg(n()).orderBy(F.desc("n"), F.asc("repo_name"), F.asc("agent"))


def top_twenty(w: Warehouse) -> DataFrame:
    return top_k(w.prs, "repo_name", 20)


def top_with_measures(w: Warehouse) -> DataFrame:
    return top_k(w.fixes, "repo_name", 15, F.count_if("is_merged").alias("merged"), F.count_if("is_agent").alias("agents")).withColumn(
        "rate", percent(F.col("merged"), F.col("total"), 1)
    )


def priority_queue(w: Warehouse) -> DataFrame:
    return work_list(w.prs.where("is_agent"), w.theirs, "repo_name")


def deduplicated(w: Warehouse) -> DataFrame:
    """One row per file, the earliest pull request's kept."""
    return keep_first(w.details.where("filename IS NOT NULL"), ["filename"], [F.col("pr_id"), F.col("sha"), F.col("additions"), F.col("deletions")])


def union_of_schemas(w: Warehouse) -> DataFrame:
    a = w.prs.where("is_agent").select("id", "agent")
    b = w.prs.where("NOT is_agent").select("id", "user")
    return a.unionByName(b, allowMissingColumns=True).agg(n(), F.count("agent").alias("agents"), F.count("user").alias("users"))


def key_intersection(w: Warehouse) -> DataFrame:
    return w.ours.select("repo_name").intersect(w.theirs.select("repo_name"))


def key_differences(w: Warehouse) -> DataFrame:
    a, b = w.ours.select("match_key"), w.theirs.select("match_key")
    return a.subtract(b).select("match_key", F.lit("ours").alias("side")).unionByName(b.subtract(a).select("match_key", F.lit("theirs").alias("side")))


def key_union(w: Warehouse) -> DataFrame:
    return w.ours.select("match_key").union(w.theirs.select("match_key")).distinct()


def tagged_keys(w: Warehouse) -> DataFrame:
    return tag(w.ours, w.theirs, ["match_key"])


# Scalar functions, tests and samples


def scalar_functions(w: Warehouse) -> DataFrame:
    added = F.col("l_quantity").cast("long")
    gone = F.round(F.col("l_discount") * 100).cast("long")
    return w.table("lineitem").groupBy("l_linenumber").agg(
        np_round(F.sum(pct_modification(added, gone)), 2).alias("modification"),
        F.sum(np_round(F.col("l_extendedprice") / 1000, 0)).cast("long").alias("thousands"),
        F.count_if(pct_modification(added, gone).isNull()).alias("undefined"),
        F.max(match_key(F.col("l_orderkey").cast("string"), F.col("l_partkey"))).alias("last_key"),
        F.max(remove_prefix(F.concat(F.lit("https://api.github.com/repos/"), F.col("l_returnflag")), "https://api.github.com/repos/")).alias("last_flag"),
    )


def elapsed_time(w: Warehouse) -> DataFrame:
    joined = w.table("lineitem").join(w.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(month_text(F.col("o_orderdate").cast("timestamp")).alias("month")).agg(
        np_round(F.min(hours_between(F.col("o_orderdate"), F.col("l_shipdate"))), 2).alias("shortest"),
        np_round(F.max(hours_between(F.col("o_orderdate"), F.col("l_shipdate"))), 2).alias("longest"),
    )


def significance_ladder(w: Warehouse) -> DataFrame:
    """P value and stars for statistics of every size found in the event values."""
    levels = w.table("events").select(np_round(F.col("value") / 10, 1).alias("statistic")).distinct()
    return levels.select("statistic", np_round(chi_square_p(F.col("statistic")), 6).alias("p"), stars(chi_square_p(F.col("statistic"))).alias("sig"))


def chi_square_by_group(w: Warehouse) -> DataFrame:
    tested = chi_square(w.prs.where("state = 'closed'"), ["task_type"], F.col("is_agent"), F.col("is_merged"))
    return rounded(rounded(tested, 4, "rate_a", "rate_b", "chi2"), 6, "p")


def u_test_by_group(w: Warehouse) -> DataFrame:
    tested = mann_whitney(w.table("lineitem"), ["l_linestatus"], F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False), "l_quantity")
    return rounded(tested.select("l_linestatus", "n1", "n2", "u", "z", "p", "sig", "method"), 6, "z", "p")


def u_test_of_small_samples(w: Warehouse) -> DataFrame:
    """Prices of each customer's finished orders against the open ones: a few orders a side."""
    finished = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    tested = mann_whitney(w.table("orders"), ["o_custkey"], finished, "o_totalprice")
    return rounded(tested.select("o_custkey", "n1", "n2", "u", "p", "sig", "method"), 6, "p")


def weighted_average_check(w: Warehouse) -> DataFrame:
    """Monthly rates weighted by volume against the overall rate."""
    monthly = grouped_rate(w.fixes, ["month", "source"])
    weighted = monthly.groupBy("source").agg((F.sum("merged") / F.sum("total") * 100).alias("weighted"))
    overall = acceptance(w.fixes, "source").select("source", F.col("acceptance_rate").alias("overall"))
    return weighted.join(overall, "source").select(
        "source", np_round(F.col("weighted"), 4).alias("weighted"), np_round(F.col("overall"), 4).alias("overall"),
        (F.abs(F.col("weighted") - F.col("overall")) < 0.1).alias("agrees"),
    )


def exact_sample(w: Warehouse) -> DataFrame:
    return sample_n(w.prs.select("id", "agent", "source"), 1000, "id")


def size_matched_sample(w: Warehouse) -> DataFrame:
    picked, _ = matched(w.fixes.where("is_agent AND is_merged"), w.fixes.where("NOT is_agent"), [], "id")
    return picked.select("id")


def month_matched_sample(w: Warehouse) -> DataFrame:
    picked, _ = matched(w.fixes.where("agent = 'Devin'"), w.fixes.where("NOT is_agent"), ["month"], "id")
    return picked.select("id", "month")


def agent_matched_sample(w: Warehouse) -> DataFrame:
    picked, _ = matched(w.theirs, w.ours_agents.where("type = 'other'"), ["agent"], "id")
    return picked.groupBy("agent").agg(n(), F.sum("id").alias("ids"))


PLANS = {
    "s01_pruned_scan": pruned_scan,
    "s02_pushed_in_list": pushed_in_list,
    "s03_filtered_scan": filtered_scan,
    "s04_csv_by_suffix": csv_by_suffix,
    "s05_status_document": status_document,
    "s07_compacted": compacted,
    "s10_split_by_source": split_by_source,
    "s11_preview": preview,
    "s12_schema_difference": schema_difference,
    "s13_report_rows": report_long,
    "schema_normalized": normalized,
    "f01_equality": equality_filter,
    "f02_differs_keeps_null": differs_keeps_null,
    "f03_in_and_not_in": in_and_not_in,
    "f04_outcome_flag": outcome_flag,
    "f05_inclusive_window": inclusive_window,
    "f06_open_start_window": open_start_window,
    "f07_text_date_window": text_date_window,
    "f08_size_gate": size_gate,
    "f09_filled_nulls": filled_nulls,
    "f10_safe_casts": safe_casts,
    "f11_two_branch_label": two_branch_label,
    "f12_period_buckets": period_buckets,
    "f14_prefixed_columns": prefixed_columns,
    "f15_rows_with_key": rows_with_key,
    "f16_clipped_values": clipped_values,
    "f16_clipped_at_quantile": clipped_at_quantile,
    "f17_safe_ratios": safe_ratios,
    "j01_inner_join": inner_join_labels,
    "j02_left_join": left_join_metrics,
    "j03_semi_join": semi_join_keys,
    "j04_anti_join": anti_join_keys,
    "j05_composite_semi_join": composite_semi_join,
    "j06_dictionary_lookup": dictionary_lookup,
    "j07_star_of_aggregates": star_of_aggregates,
    "j08_outer_aligned": outer_aligned_counts,
    "j09_commit_fan_out": commit_fan_out,
    "j10_suffixed_pairs": suffixed_pairs,
    "j11_membership_flag": membership_flag,
    "j13_first_known_repo": first_known_repo,
    "a01_group_count": group_count,
    "a02_value_counts": value_counts_no_null,
    "a03_date_range": date_range,
    "a04_sum_or_zero": sums_of_nothing,
    "a05_distinct_count": distinct_per_group,
    "a06_exact_medians": exact_medians,
    "a07_exact_quantiles": exact_upper_quantiles,
    "a07_near_quantiles": near_quantiles,
    "a08_boolean_mean": boolean_mean,
    "a09_outcome_table": outcome_table,
    "a10_two_key_rates": two_key_rates,
    "a11_first_per_group": first_per_group,
    "a12_prs_per_commit": pull_requests_per_commit,
    "a12_commit_holders": commit_holders,
    "a13_pivot_zero_filled": pivot_zero_filled,
    "a13_pivot_null_kept": pivot_null_kept,
    "a13_pivot_most_common": pivot_of_the_most_common,
    "a05_sketched_distinct": sketched_distinct,
    "s05_status_documents_read": status_documents_read,
    "a14_crosstab_margins": crosstab_margins,
    "a15_total_row": total_row,
    "a16_conditional_counts": conditional_counts,
    "a17_share_of_total": share_of_total,
    "a18_histogram": twenty_bins,
    "a19_box_stats": box_per_group,
    "a20_log_distribution": log_distribution,
    "w01_first_commit": first_commit_rows,
    "w02_row_share": monthly_shares,
    "w03_stratum_ranks": stratum_ranks,
    "w04_mid_ranks": mid_ranks,
    "w05_at_risk": at_risk_by_group,
    "w06_period_points": period_points,
    "k01_sorted_groups": sorted_groups,
    "k02_top_twenty": top_twenty,
    "k03_top_with_measures": top_with_measures,
    "k04_priority_queue": priority_queue,
    "k05_deduplicated": deduplicated,
    "e01_union_of_schemas": union_of_schemas,
    "e02_key_intersection": key_intersection,
    "e03_key_differences": key_differences,
    "e04_key_union": key_union,
    "e05_tagged_keys": tagged_keys,
    "scalar_functions": scalar_functions,
    "scalar_elapsed_time": elapsed_time,
    "scalar_significance_ladder": significance_ladder,
    "t1_chi_square_by_group": chi_square_by_group,
    "t2_u_test_by_group": u_test_by_group,
    "t2_small_samples": u_test_of_small_samples,
    "t6_weighted_average": weighted_average_check,
    "sm1_exact_sample": exact_sample,
    "sm2_size_matched": size_matched_sample,
    "sm3_month_matched": month_matched_sample,
    "sm4_agent_matched": agent_matched_sample,
}
