"""Adapters that present order-processing tables as pull-request data.

An order is a pull request, its customer the repository, its priority the author group, and its line items the commits
with one changed file each. Two overlapping collections of pull requests follow from what each collector would have
seen: its authors, its dates, and its snapshot of the state. Whole tables are used throughout.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergescope.config import EXCLUDED_AGENT, HUMAN, REPO_API_PREFIX
from mergescope.functions.clock import hours_between, month_text, period_of
from mergescope.functions.text import classify_title, match_key, word_count
from mergescope.operators.filters import closed_fixes, differs, studied_group

OURS_SINCE = "1995-07-01"
THEIRS_UNTIL = "1998-07-31"
THEIRS_MIN_AMOUNT = 30_000.0
THEIRS_HUMAN_MIN_AMOUNT = 60_000.0
THEIRS_MERGE_SEEN_BELOW = 450_000.0
PREV_UNTIL = "2000-01-01"
NEW_SINCE = "1999-06-01"
CUTOFF = THEIRS_UNTIL
COMMIT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")

# Title openings and external labels by price band of 50,000.
TITLE_BANDS = (
    "fix: order ", "fix(cart)!: order ", "feat(ui): add order ", "Resolve crash in order ", "docs: describe order ",
    "Bugfix order ", "prefix debug of order ", "refactor!: order ", "Hotfix for regression ", "chore(deps): bump ",
)
LABEL_BANDS = ("fix", "fix", "feat", "fix", "docs", "fix", "other", "refactor", "test", "chore")
AGENT_BY_PRIORITY = {"1-URGENT": "Claude_Code", "2-HIGH": "Copilot", "3-MEDIUM": HUMAN, "4-NOT SPECIFIED": "Cursor"}
EXCLUDED_ABOVE = 350_000.0


def _by_band(values: tuple[str, ...]) -> Column:
    band = F.least(F.floor(F.col("o_totalprice") / 50_000.0).cast("int"), F.lit(len(values) - 1))
    return F.element_at(F.array(*[F.lit(v) for v in values]), band + 1)


class Warehouse:
    """The tables of one scale-factor folder, in the pull-request model."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def prs(self) -> DataFrame:
        """All pull requests, without the columns that need a join."""
        return self.prs_from(self.table("orders"))

    def stream(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        """A table as a stream of its files, optionally in bounded steps."""
        # A pattern, because a plain stream path must be a folder and a table may be one file.
        path = f"{self.folder}/{name}.parque[t]"
        reader = self.spark.readStream.schema(self.table(name).schema)
        if files_per_trigger is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(path)

    @staticmethod
    def prs_from(orders: DataFrame) -> DataFrame:
        """Pull requests of a batch or streaming orders table."""
        agent = F.when(F.col("o_totalprice") >= EXCLUDED_ABOVE, EXCLUDED_AGENT).otherwise("Devin")
        for priority, name in AGENT_BY_PRIORITY.items():
            agent = F.when(F.col("o_orderpriority") == priority, name).otherwise(agent)
        repo = F.concat(F.lit("acme-"), F.col("o_custkey").cast("string"), F.lit("/repo"))
        raw = orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").alias("number"),
            F.col("o_custkey").alias("repo_id"),
            repo.alias("repo_name"),
            F.concat(_by_band(TITLE_BANDS), F.col("o_orderkey").cast("string")).alias("title"),
            _by_band(LABEL_BANDS).alias("task_type"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.when(F.col("o_orderstatus") == "P", "open").otherwise("closed").alias("state"),
            (F.col("o_orderstatus") == "F").alias("is_merged"),
            agent.alias("agent"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").alias("amount"),
        )
        human = F.col("agent") == HUMAN
        return raw.select(
            "*",
            F.when(human, F.concat(F.lit("dev-"), F.col("user_id").cast("string")))
            .otherwise(F.concat(F.lower("agent"), F.lit("[bot]"))).alias("user"),
            (~human).alias("is_agent"),
            F.when(human, HUMAN).otherwise("agent").alias("source"),
            classify_title(F.col("title")).alias("type"),
            match_key(F.col("repo_name"), F.col("number")).alias("match_key"),
            month_text(F.col("created_at")).alias("month"),
            F.concat(F.lit(REPO_API_PREFIX), F.col("repo_name")).alias("repo_url"),
            F.concat(F.lit("https://github.com/"), F.col("repo_name"), F.lit("/pull/"), F.col("number").cast("string"))
            .alias("html_url"),
        )

    def closed(self, prs: DataFrame) -> DataFrame:
        """Add closing and merge times; an order closes with its last shipment, or after a day if none follows it."""
        shipped = F.timestamp_micros(
            F.unix_micros(F.col("l_shipdate").cast("timestamp")) + (F.col("l_quantity") * 420).cast("long") * 1_000_000
        )
        last = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(shipped).alias("last_ship"))
        closing = F.when(F.col("last_ship") >= F.col("created_at"), F.col("last_ship")).otherwise(
            F.col("created_at") + F.expr("INTERVAL 1 DAY")
        )
        return (
            prs.join(last, "id", "left")
            .withColumn("closed_at", F.when(F.col("state") == "closed", closing))
            .withColumn("merged_at", F.when(F.col("is_merged"), F.col("closed_at")))
            .withColumn("hours_to_merge", hours_between(F.col("created_at"), F.col("merged_at")))
            .withColumn("hours_open", hours_between(F.col("created_at"), F.col("closed_at")))
            .drop("last_ship")
        )

    def described(self, prs: DataFrame) -> DataFrame:
        """Add the number of words of the description, NULL where there is none; the text itself is never shuffled."""
        words = self.table("documents").select(F.col("doc_id").alias("id"), word_count(F.col("text")).alias("body_words"))
        return prs.join(words, "id", "left")

    @cached_property
    def fixes(self) -> DataFrame:
        """Closed fixes of the studied groups with their group label and period."""
        return closed_fixes(self.prs).withColumns(
            {"group": studied_group(), "period": period_of(F.col("created_at"), CUTOFF)}
        )

    @cached_property
    def timed_fixes(self) -> DataFrame:
        return self.closed(self.fixes)

    @cached_property
    def ours(self) -> DataFrame:
        """First collection: all authors but the excluded agent, from its start date on."""
        return self.prs.where(differs(F.col("agent"), EXCLUDED_AGENT)).where(
            F.col("created_at") >= F.lit(OURS_SINCE).cast("timestamp")
        )

    def _seen_by_them(self, prs: DataFrame, min_amount: float) -> DataFrame:
        """What the second collector's older snapshot holds of the given pull requests."""
        return prs.where(
            (F.col("created_at") <= F.lit(THEIRS_UNTIL).cast("timestamp")) & (F.col("amount") >= min_amount)
        ).withColumns(
            {
                "agent": F.when((F.col("agent") == "Cursor") & (F.col("state") == "open"), "Copilot").otherwise(F.col("agent")),
                "state": F.when(F.col("is_merged"), "closed").otherwise("open"),
                "is_merged": F.col("is_merged") & (F.col("amount") < THEIRS_MERGE_SEEN_BELOW),
            }
        )

    @cached_property
    def theirs_all(self) -> DataFrame:
        """Second collection: agent pull requests up to its end date, the excluded agent included."""
        return self._seen_by_them(self.prs.where("is_agent"), THEIRS_MIN_AMOUNT)

    @cached_property
    def theirs(self) -> DataFrame:
        return self.theirs_all.where(differs(F.col("agent"), EXCLUDED_AGENT))

    @cached_property
    def theirs_human(self) -> DataFrame:
        return self._seen_by_them(self.prs.where(F.col("agent") == HUMAN), THEIRS_HUMAN_MIN_AMOUNT)

    @cached_property
    def ours_human(self) -> DataFrame:
        return self.ours.where(F.col("agent") == HUMAN)

    @cached_property
    def ours_agents(self) -> DataFrame:
        return self.ours.where(F.col("agent") != HUMAN)

    @cached_property
    def prev(self) -> DataFrame:
        return self.ours.where(F.col("created_at") < F.lit(PREV_UNTIL).cast("timestamp"))

    @cached_property
    def new(self) -> DataFrame:
        return self.ours_agents.where(F.col("created_at") >= F.lit(NEW_SINCE).cast("timestamp"))

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sha"),
            F.col("l_orderkey").alias("pr_id"),
            F.concat(F.lit("dev-"), F.col("l_suppkey").cast("string")).alias("author"),
            *COMMIT_ORDER,
        )

    @cached_property
    def details(self) -> DataFrame:
        """One changed file per line item; untaxed lines are commits without files."""
        listed = F.col("l_tax") > 0
        path = F.concat(F.lit("src/"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("/"),
                        F.col("l_linenumber").cast("string"), F.lit(".py"))
        return self.table("lineitem").select(
            F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sha"),
            F.col("l_orderkey").alias("pr_id"),
            F.when(listed, path).alias("filename"),
            F.when(listed, F.col("l_quantity").cast("long")).alias("additions"),
            F.when(listed, F.round(F.col("l_discount") * 100).cast("long")).alias("deletions"),
        )

    @cached_property
    def repositories(self) -> DataFrame:
        """Repository metadata, known for customers that are not in debt."""
        nations = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("language"))
        return (
            self.table("customer").where(F.col("c_acctbal") >= 0).join(nations, "c_nationkey", "left").select(
                F.col("c_custkey").alias("repo_id"),
                F.when(F.col("c_mktsegment") == "FURNITURE", "Unknown")
                .otherwise(F.concat(F.lower("c_mktsegment"), F.lit("/"), F.col("c_name"))).alias("full_name"),
                "language",
                F.when(F.col("c_nationkey") % 4 > 0, F.concat(F.lit("license-"), (F.col("c_nationkey") % 4).cast("string"))).alias("license"),
                F.floor("c_acctbal").cast("long").alias("stars"),
                F.col("c_nationkey").cast("long").alias("forks"),
            )
        )

    @cached_property
    def run_status(self) -> DataFrame:
        """(list, repo_name): how the collection run ended for each repository."""
        balance = F.col("c_acctbal")
        lists = F.array_compact(
            F.array(
                F.when(balance < -800, "errors"),
                F.when((balance >= -800) & (balance < -600), "not_found"),
                F.when((balance >= 0) | (balance < -900), "done_repos"),
            )
        )
        repo = F.concat(F.lit("acme-"), F.col("c_custkey").cast("string"), F.lit("/repo"))
        return self.table("customer").select(F.explode(lists).alias("list"), repo.alias("repo_name"))
