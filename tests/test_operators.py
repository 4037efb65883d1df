"""Joins, aggregates, overlap, revisions, sampling and labelling on small tables made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from mergescope.operators import sampling
from mergescope.operators.aggregates import (
    acceptance, crosstab, distinct_count, distinct_sketches, grouped_rate, period_change, pivot_common, pivot_counts, share, share_of_all,
    sketched_count, sum_or_zero, top_k, value_totals, with_total_row, work_list,
)
from mergescope.operators.filters import after_end_of, closed_fixes, differs, in_window, min_size, within_range_of
from mergescope.operators.joins import fan_out, first_known, keep_first, lookup, membership, outer_counts, paired, rest_period, scope
from mergescope.operators.labelling import (
    attribute, classify_table, fixes_with_commits, label_incremental, parse_responses, validate_responses,
)
from mergescope.operators.overlap import agreement, dual_match, overlap, tag
from mergescope.operators.ranking import hashed_row_number, sha_batches
from mergescope.operators.revisions import change_size, first_vs_rest, revision_effort


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def prs(spark):
    data = [
        (1, "Devin", "agent", "fix", "closed", True, "2025-01-01", "r1"), (2, "Devin", "agent", "fix", "closed", False, "2025-01-02", "r1"),
        (3, None, "agent", "fix", "closed", True, "2025-01-03", "r2"), (4, "OpenAI_Codex", "agent", "fix", "closed", True, "2025-01-04", "r2"),
        (5, "human", "human", "fix", "open", False, "2025-01-05", "r1"), (6, "human", "human", "other", "closed", True, "2025-01-06", None),
    ]
    df = spark.createDataFrame(data, "id long, agent string, source string, type string, state string, is_merged boolean, day string, repo_name string")
    return df.withColumn("created_at", F.col("day").cast("timestamp"))


def test_filters(spark, prs):
    assert [r[0] for r in rows(closed_fixes(prs), "id")] == [1, 2, 3]
    assert [r[0] for r in rows(closed_fixes(prs, None), "id")] == [1, 2, 3, 4]
    assert [r[0] for r in rows(prs.where(differs(F.col("agent"), "Devin")), "id")] == [3, 4, 5, 6]
    low, high = F.lit("2025-01-02").cast("timestamp"), F.lit("2025-01-04").cast("timestamp")
    assert [in_window(prs, "created_at", low, high, how).count() for how in ("both", "left", "right", "neither")] == [3, 2, 2, 1]
    other = prs.where("id IN (2, 4)")
    assert [r[0] for r in rows(within_range_of(prs, other), "id")] == [2, 3, 4]
    assert [r[0] for r in rows(after_end_of(prs, other, until="2025-01-05"), "id")] == [5]
    sized = spark.createDataFrame([("four", i) for i in range(4)] + [("five", i) for i in range(5)], "g string, i int")
    assert rows(sized.groupBy("g").agg(min_size(F.max("i")).alias("m"))) == [("five", 4), ("four", None)]


def test_aggregates(spark, prs):
    assert rows(acceptance(prs, "agent", "All"), "agent", "total", "merged", "rejected") == [
        ("All", 5, 3, 2), ("Devin", 2, 1, 1), ("OpenAI_Codex", 1, 1, 0), ("human", 2, 1, 1)
    ]
    assert rows(value_totals(prs, "agent")) == [("Devin", 2), ("OpenAI_Codex", 1), ("human", 2)]
    assert rows(grouped_rate(prs, ["source", "state"], min_rows=2), "source", "state", "rate") == [
        ("agent", "closed", 75.0), ("human", "closed", None), ("human", "open", None)
    ]
    assert rows(pivot_counts(prs, "source", "state", ("closed", "open"))) == [("agent", 4, 0), ("human", 1, 1)]
    assert rows(pivot_counts(prs, "source", "state", ("closed", "open"), fill=None)) == [("agent", 4, None), ("human", 1, 1)]
    assert rows(crosstab(prs, "source", "type", ("fix", "other"))) == [("Total", 5, 1, 0, 6), ("agent", 4, 0, 0, 4), ("human", 1, 1, 0, 2)]
    assert rows(crosstab(prs, "source", "type", ("fix",))) == [("Total", 5, 1, 6), ("agent", 4, 0, 4), ("human", 1, 1, 2)]
    counts = prs.groupBy("source").agg(F.count("*").alias("n"))
    assert rows(with_total_row(counts, "source", "T", ("n",))) == [("T", 6), ("agent", 4), ("human", 2)]
    assert rows(share_of_all(counts, "n", digits=2)) == [("agent", 4, 66.67), ("human", 2, 33.33)]
    assert rows(distinct_count(prs, ["source"], "agent", "n")) == [("agent", 2), ("human", 1)]
    nothing = spark.createDataFrame([("a", None), ("a", None)], "g string, x long")
    assert rows(nothing.groupBy("g").agg(sum_or_zero(F.col("x")).alias("s"))) == [("a", 0)]
    assert [tuple(r) for r in top_k(prs, "repo_name", 2).collect()] == [("r1", 3), ("r2", 2)]
    assert rows(work_list(prs, prs.where("repo_name = 'r1'"), "repo_name")) == [("r2", 2)]
    monthly = share(prs.groupBy("source", "state").agg(F.count("*").alias("n")), ["source"], "n")
    assert {r[0]: r[1] for r in monthly.groupBy("source").agg(F.sum("share_pct")).collect()} == {"agent": 100.0, "human": 100.0}
    rates = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 4.0), ("b", "x", 2.0)], "k string, p string, v double")
    assert rows(period_change(rates, "k", "p", "v", "x", "y")) == [("a", 1.0, 4.0, 3.0), ("b", 2.0, None, None)]


def test_joins(spark):
    df = spark.createDataFrame([(1, "b", 2, None), (1, "a", 1, None), (1, "c", 3, "z"), (2, "d", 1, "y")], "k int, v string, o int, w string")
    assert rows(keep_first(df, ["k"], [F.col("o")])) == [(1, "a", 1, None), (2, "d", 1, "y")]
    assert rows(keep_first(df, ["k"], [F.col("o")], first_non_null=True)) == [(1, "a", 1, "z"), (2, "d", 1, "y")]
    facts = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    assert rows(lookup(facts, df.select("k", "v", "o"), ["k"], [F.col("o")], {"v": "?"}), "k", "v") == [(1, "c"), (2, "d"), (3, "?"), (None, "?")]
    assert rows(membership(facts, df, ["k"], "known")) == [(1, True), (2, True), (3, False), (None, False)]
    both = outer_counts([df.groupBy("k").agg(F.count("*").alias("a")), facts.where("k > 1").groupBy("k").agg(F.count("*").alias("b"))], ["k"])
    assert rows(both) == [(1, 3, 0), (2, 1, 1), (3, 0, 1)]
    files = spark.createDataFrame([("s1", 0, "f"), ("s1", 0, "g"), ("s2", 0, None), ("s3", 0, "h")], "sha string, pr_id long, filename string")
    held = spark.createDataFrame([("s1", 7), ("s1", 8), ("s1", 8), ("s2", 7)], "sha string, pr_id long")
    assert rows(fan_out(files, held), "sha", "filename", "pr_id") == [
        ("s1", "f", 7), ("s1", "f", 8), ("s1", "g", 7), ("s1", "g", 8), ("s2", None, 7), ("s3", "h", None)
    ]
    repos = spark.createDataFrame([(7, None), (8, "r8"), (9, "r9")], "pr_id long, repo string")
    links = spark.createDataFrame([("s1", 7, 0), ("s1", 9, 2), ("s1", 8, 1), ("s2", 7, 0)], "sha string, pr_id long, o int")
    assert rows(first_known(links, repos, "pr_id", "sha", "repo", ["o"])) == [("s1", "r8")]


def test_overlap_and_agreement(spark):
    a = spark.createDataFrame([("k1",), ("k1",), ("k2",), (None,)], "key string")
    b = spark.createDataFrame([("k2",), ("k3",), ("k3",), ("k4",), (None,)], "key string")
    (row,) = overlap(a, b, "key").collect()
    assert (row.a_keys, row.b_keys, row.overlap, row.only_a, row.only_b, row.union_keys) == (2, 3, 1, 1, 2, 4)
    assert row.jaccard == 0.25 and row.pct_of_a == 50.0 and row.pct_of_b == pytest.approx(100 / 3)
    assert row.overlap + row.only_a == row.a_keys and row.overlap + row.only_b == row.b_keys
    assert tag(a, b, ["key"]).count() == 4
    left = spark.createDataFrame([("k", "x", True, 2), ("k", "y", False, 1), ("m", "x", True, 1)], "key string, label string, ok boolean, id int")
    right = spark.createDataFrame([("k", "y", True, 1), ("m", "x", True, 1), ("n", "x", True, 1)], "key string, label string, ok boolean, id int")
    pairs = paired(left, right, "key", ["label", "ok"], ["id"])
    assert rows(pairs, "key", "a_label", "b_label") == [("k", "y", "y"), ("m", "x", "x")]
    assert rows(agreement(pairs, "a_ok", "b_ok"), "pairs", "agree", "disagree", "only_left_true", "only_right_true") == [(2, 1, 1, 0, 1)]


def test_dual_match_joins_by_key_or_commit(spark):
    a = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, None, 30)], "id long, repo_id long, number long")
    b = spark.createDataFrame([(11, 1, 10), (12, 9, 9), (13, None, 30), (14, 8, 8)], "id long, repo_id long, number long")
    a_commits = spark.createDataFrame([("s1", 1), ("s2", 2)], "sha string, pr_id long")
    b_commits = spark.createDataFrame([("s2", 12), ("s2", 11), ("s9", 14)], "sha string, pr_id long")
    assert rows(dual_match(b, a, b_commits, a_commits, ["repo_id", "number"])) == [(11,), (12,)]


def test_scope_cuts_to_shared_repositories_and_dates(spark, prs):
    other = prs.where("id IN (1, 3)")
    ours, theirs = scope(prs, other)
    assert [r[0] for r in rows(ours, "id")] == [1, 2, 3] and theirs.count() == 2
    assert [r[0] for r in rows(rest_period(prs, other, other), "id")] == [4, 5]


@pytest.fixture(scope="module")
def history(spark):
    commits = spark.createDataFrame(
        [(1, "a", 2), (1, "b", 1), (1, "c", 3), (2, "b", 5), (2, "d", 6), (3, "e", 1)], "pr_id long, sha string, seq int"
    )
    details = spark.createDataFrame(
        [
            (1, "b", "f1", 10, 0), (1, "a", "f1", 1, 2), (1, "a", "f2", 3, 4), (1, "c", None, None, None), (2, "b", "f1", 0, 0),
            (2, "d", "f3", 5, 5), (3, "e", "f1", 7, 7),
        ],
        "pr_id long, sha string, filename string, additions long, deletions long",
    )
    return commits, details


def test_revision_effort(history):
    commits, details = history
    effort = revision_effort(commits, details, ["seq"])
    assert rows(effort, "pr_id", "num_commits", "rev_files", "rev_lines_added", "rev_lines_deleted", "pct_modification") == [
        (1, 3, 2, 4, 6, 100.0), (2, 2, 1, 5, 5, None), (3, 1, 0, 0, 0, None)
    ]
    assert [r[0] for r in rows(revision_effort(commits, details, ["seq"], missing="drop"), "pr_id")] == [1, 2]
    # b opens both pull requests, d and the rest of 1 follow; a shared first commit is first everywhere.
    shared = first_vs_rest(commits, details, ["seq"], compat=True)
    assert rows(shared.where("has_rest"), "pr_id", "rev_lines_added") == [(1, 4), (2, 5)]
    with pytest.raises(ValueError):
        revision_effort(commits, details, ["seq"], missing="other")
    assert rows(change_size(details)) == [(1, 2, 14, 6), (2, 2, 5, 5), (3, 1, 7, 7)]


@pytest.mark.parametrize("n", [0, 1, 499, 500, 700])
def test_sample_has_the_exact_size(spark, n):
    df = spark.range(500)
    picked = sampling.sample_n(df, n, "id")
    ids = [r[0] for r in picked.collect()]
    assert len(ids) == min(n, 500) == len(set(ids))
    assert sorted(ids) == sorted(r[0] for r in sampling.sample_n(df.repartition(7), n, "id").collect())


def test_strata_of_any_size(spark):
    pool = spark.range(3000).select("id", F.when(F.col("id") < 2900, "hot").when(F.col("id") < 2990, "warm").otherwise("cold").alias("g"))
    cohort = spark.createDataFrame([("hot",)] * 1000 + [("cold",)] * 50 + [("gone",)] * 2, "g string")
    picked, short = sampling.matched(cohort, pool, ["g"], "id")
    assert rows(picked.groupBy("g").count()) == [("cold", 10), ("hot", 1000)]
    assert rows(short, "g", "target", "available", "shortfall") == [("cold", 50, 10, 40), ("gone", 2, 0, 2), ("hot", 1000, 2900, 0)]
    ranked = hashed_row_number(pool, ["g"], "id", "k", ":42")
    assert rows(ranked.groupBy("g").agg(F.min("k"), F.max("k"), F.countDistinct("k"))) == [("cold", 1, 10, 10), ("hot", 1, 2900, 2900), ("warm", 1, 90, 90)]
    by_rank = {r[0] for r in ranked.where("g = 'hot' AND k <= 1000").select("id").collect()}
    assert by_rank == {r[0] for r in picked.where("g = 'hot'").select("id").collect()}


def test_work_list_batches(spark):
    commits = spark.createDataFrame([(f"s{i}", i % 7, i) for i in range(120)] + [("s1", 6, 999)], "sha string, pr_id long, seq int")
    prs = spark.createDataFrame([(i, None if i == 1 else f"r{i % 2}") for i in range(7)], "id long, repo_name string")
    batches = sha_batches(commits, prs, ["seq"], size=10)
    listed = rows(batches)
    assert len({sha for _, sha, _ in listed}) == len(listed)
    assert ("r0", "s1") in {(r, s) for r, s, _ in listed} and "s8" not in {s for _, s, _ in listed}
    assert all(1 <= r["count"] <= 10 for r in batches.groupBy("repo_name", "batch").count().collect())


def test_labelling_jobs(spark):
    prs = spark.createDataFrame([(1, "fix: a"), (2, "feature"), (3, None), (4, "docs: x")], "id long, title string")
    labelled, queue = label_incremental(prs, spark.createDataFrame([("4",)], "id string"))
    assert rows(labelled, "id", "label", "confidence") == [(1, "fix", 10)]
    assert rows(queue, "id", "title") == [(2, "feature"), (3, "")]
    fixes, commits, details = fixes_with_commits(
        classify_table(prs, "agent"), spark.createDataFrame([(1, "a"), (2, "b")], "pr_id long, sha string"),
        spark.createDataFrame([(1, "a", "f"), (4, "c", "g")], "pr_id long, sha string, filename string"),
    )
    assert [fixes.count(), commits.count(), details.count()] == [1, 1, 1]
    users = spark.createDataFrame([("u", "Devin", 1), ("u", "Cursor", 2), ("v", "Copilot", 1)], "user string, agent string, n int")
    authors = spark.createDataFrame([("u",), ("v",), ("w",), (None,)], "user string")
    assert rows(attribute(authors, users, ["n"]), "user", "is_agent", "agent") == [("u", True, "Cursor"), ("v", True, "Copilot"), ("w", False, "human"), (None, False, "human")]


RESPONSES = {
    json.dumps({"output": " Fix ", "confidence": 7, "reason": " why "}): ("fix", 7, "why"),
    'Sure!\n{"output": "docs", "confidence": "7"}\nbye': ("docs", 7, "No reason provided."),
    '[{"output": "test", "confidence": 3.9, "reason": ""}]': ("test", 3, "No reason provided."),
    '{"output": "feature", "confidence": 5}': "label",
    '{"output": "fix", "confidence": 0}': "confidence range",
    '{"output": "fix", "confidence": 11}': "confidence range",
    '{"output": "fix", "confidence": "high"}': "confidence",
    '{"output": "fix"}': "confidence range",
    "no json": "no object",
    '{"output": "fix", ': "no object",
    "": "no object",
}


def test_model_answers(spark):
    raw = spark.createDataFrame([(r,) for r in RESPONSES], "raw string")
    good, bad = validate_responses(raw, "raw")
    got = {r["raw"]: (r["label"], r["confidence"], r["reason"]) for r in good.collect()} | {r["raw"]: r["problem"] for r in bad.collect()}
    assert got == RESPONSES


def test_fractions_of_model_answers(spark):
    answers = ['{"output": "fix", "confidence": 7.5}', '{"output": "fix", "confidence": "7.5"}', '{"output": "fix", "confidence": " 7 "}']
    rows = parse_responses(spark.createDataFrame([(a,) for a in answers], "raw string"), "raw").select("confidence", "problem").collect()
    assert [tuple(r) for r in rows] == [(7, None), (None, "confidence"), (7, None)]


def test_common_values_get_columns_and_all_others_one(spark):
    df = spark.createDataFrame([("r", v) for v in "aaabbcd"] + [("s", "d"), ("s", None), (None, "a")], "g string, v string")
    wide = pivot_common(df, "g", "v", 2)
    assert wide.columns == ["g", "a", "b", "Unlisted", "Total"]
    assert rows(wide) == [("r", 3, 2, 2, 7), ("s", 0, 0, 1, 1)]
    assert rows(pivot_common(df.limit(0), "g", "v", 2)) == []


def test_sketches_of_days_add_up_within_their_error(spark):
    df = spark.range(200_000).selectExpr("id % 20 AS day", "id % 3 AS g", "id % 60000 AS user")
    daily = distinct_sketches(df, ["g", "day"], "user")
    assert daily.count() == 60
    for r in sketched_count(daily, ["g"], "n").collect():
        assert abs(r.n - 20_000) < 20_000 * 3 * 1.04 / 64
    assert abs(sketched_count(daily, [], "n").collect()[0].n - 60_000) < 60_000 * 3 * 1.04 / 64
