"""The registered queries: contract, invariants on the smallest tables, and behaviour under hot keys."""

import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from check import TABLES, canonical
from mergescope.operators.revisions import revision_effort
from mergescope.oracle import statements
from mergescope.plans import all_plans

FOLDER = "/root/testdata/sf0.001"


def test_registry_needs_no_session():
    code = "import __spark_entry__ as d; q = d.queries(); s = d.oracle_sql(); assert set(s) <= set(q) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=driver.__file__.rsplit("/", 1)[0], timeout=120)


def test_every_plan_has_sql():
    assert set(statements()) == set(all_plans())
    assert set(all_plans()) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_returns_rows(spark):
    table = driver.entry(spark)
    assert table.columns == ["agent", "total", "merged", "rejected", "acceptance_rate"] and table.count() == 5


SMALL = [
    "q01_dataset_overview", "q03_acceptance_time_table", "q05_time_to_merge_boxes", "q09_revision_effort_medians", "q18_agent_leaderboard",
    "q21_dataset_overlap", "q26_repo_coverage", "q29_dual_key_overlap", "q33_cohort_ladder", "q37_survival_log_rank", "c4_valid_responses",
    "p1_numstat_totals", "sm3_month_matched", "i3_monthly_update",
]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SMALL)
def test_query_equals_its_sql(spark, database, name):
    frame = driver.queries()[name](spark, FOLDER)
    result = database.sql(driver.oracle_sql()[name])
    assert canonical(frame.columns, frame.collect()) == canonical(list(result.columns), result.fetchall())


def test_invariants(small):
    plans = all_plans()
    for row in plans["q02_acceptance_by_agent"](small).collect():
        assert row["merged"] + row["rejected"] == row["total"]
    for row in plans["q22_overlap_by_month"](small).collect():
        assert row["overlap"] + row["only_a"] == row["a_keys"] and row["overlap"] + row["only_b"] == row["b_keys"]
    for row in plans["q13_monthly_market_share"](small).collect():
        assert sum(v for v in row[1:] if v is not None) == pytest.approx(100, abs=0.05)
    assert all(r["agrees"] for r in plans["t6_weighted_average"](small).collect())
    for row in plans["q33_stratified_shortfall"](small).collect():
        assert row["shortfall"] == max(row["target"] - row["available"], 0)


def test_one_pull_request_with_a_third_of_all_commits(spark):
    n = 30_000
    commits = spark.range(n).select(
        F.when(F.col("id") < n / 3, 0).otherwise(F.col("id")).alias("pr_id"), F.concat(F.lit("s"), F.col("id")).alias("sha"), F.col("id").alias("seq")
    )
    details = commits.select(
        "pr_id", "sha", F.concat(F.lit("f"), F.col("seq") % 100).alias("filename"), F.lit(2).alias("additions"), F.lit(1).alias("deletions")
    )
    effort = revision_effort(commits, details, ["seq"])
    (hot,) = effort.where("pr_id = 0").collect()
    assert (hot["num_commits"], hot["rev_files"], hot["rev_lines_added"]) == (n // 3, 100, 2 * (n // 3 - 1))
    assert effort.count() == n - n // 3 + 1


@pytest.mark.parametrize("name", ["q05_time_to_merge_boxes", "q08_revision_count_test", "q37_survival_log_rank", "sm2_size_matched", "w03_stratum_ranks"])
def test_plans_hold_no_cross_join(small, name):
    plan = all_plans()[name](small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
