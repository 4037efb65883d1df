"""Reading tables, status documents and nested API records."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergescope.config import REPO_API_PREFIX
from mergescope.functions.clock import parse_utc
from mergescope.operators.joins import lookup
from mergescope.schema import RUN_STATUS


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV table chosen by suffix, cut to the wanted columns."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".parquet":
        table = reader.parquet(path)
    elif suffix == ".csv":
        table = reader.csv(path, header=True, multiLine=True, escape='"')
    else:
        raise ValueError(f"unsupported file type: {suffix or path}")
    return table if columns is None else table.select(*columns)


def only_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the literals; on a Parquet scan the list is pushed to the reader."""
    return df.where(F.col(column).isin(*values))


def status_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list, repo_name) rows of a run status document."""
    return explode_status(spark.read.schema(RUN_STATUS).json(path, multiLine=True))


def status_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((file, document variant) of the status documents under a path, (file, text) of what is no JSON object).

    A document may span lines. Its fields aren't fixed: it is kept as it is, and read field by field.
    """
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parsed = read.withColumn("document", F.try_parse_json("text"))
    is_object = F.coalesce(F.schema_of_variant("document").startswith("OBJECT"), F.lit(False))
    return parsed.where(is_object).select("file", "document"), parsed.where(~is_object).select("file", "text")


def status_entries(documents: DataFrame, lists: Sequence[str] = ("errors", "not_found", "done_repos")) -> DataFrame:
    """(list, repo_name) of documents whose lists hold names, or objects with a name, or are one name instead of a list."""

    def names(field: str) -> Column:
        whole = F.try_variant_get("document", f"$.{field}", "array<variant>")
        one = F.array(F.try_variant_get("document", f"$.{field}", "variant"))
        return F.transform(
            F.coalesce(whole, one), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))
        )

    entries = F.array(*[F.struct(F.lit(field).alias("list"), names(field).alias("names")) for field in lists])
    found = documents.select(F.inline(entries)).select("list", F.explode("names").alias("repo_name"))
    return found.where(F.col("repo_name").isNotNull()).distinct()


def explode_status(document: DataFrame) -> DataFrame:
    lists = F.create_map(*[x for n in ("errors", "not_found", "done_repos") for x in (F.lit(n), F.col(n))])
    return document.select(F.explode(lists).alias("list", "names")).select("list", F.explode("names").alias("repo_name")).distinct()


API_USER = T.StructType([T.StructField("login", T.StringType()), T.StructField("id", T.LongType())])
API_NAMED = T.StructType([T.StructField("name", T.StringType())])
API_PULL = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("number", T.LongType()), T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()), T.StructField("user", API_USER), T.StructField("state", T.StringType()),
        T.StructField("created_at", T.StringType()), T.StructField("closed_at", T.StringType()),
        T.StructField("merged_at", T.StringType()), T.StructField("html_url", T.StringType()),
        T.StructField("pull_request", T.StructType([T.StructField("merged_at", T.StringType())])),
    ]
)
API_COMMIT = T.StructType(
    [
        T.StructField("sha", T.StringType()),
        T.StructField("author", API_USER),
        T.StructField("committer", API_USER),
        T.StructField(
            "commit",
            T.StructType(
                [
                    T.StructField("author", API_NAMED), T.StructField("committer", API_NAMED),
                    T.StructField("message", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "stats",
            T.StructType([T.StructField(n, T.LongType()) for n in ("total", "additions", "deletions")]),
        ),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("filename", T.StringType()), T.StructField("status", T.StringType()),
                        T.StructField("additions", T.LongType()), T.StructField("deletions", T.LongType()),
                        T.StructField("patch", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def flatten_pulls(df: DataFrame, record: str, repo: str, repo_ids: DataFrame | None = None) -> DataFrame:
    """Pull-request rows from JSON records; search results carry the merge time in a nested object."""
    r = F.from_json(F.col(record), API_PULL)
    flat = df.select(F.col(repo).alias("repo_name"), r.alias("r")).select(
        F.col("r.id").alias("id"),
        F.col("r.number").alias("number"),
        _text(F.col("r.title")).alias("title"),
        _text(F.col("r.body")).alias("body"),
        _text(F.col("r.user.login")).alias("user"),
        F.col("r.user.id").alias("user_id"),
        _text(F.col("r.state")).alias("state"),
        parse_utc(F.col("r.created_at")).alias("created_at"),
        parse_utc(F.col("r.closed_at")).alias("closed_at"),
        parse_utc(
            F.when(F.col("r.pull_request").isNotNull(), F.col("r.pull_request.merged_at")).otherwise(F.col("r.merged_at"))
        ).alias("merged_at"),
        F.concat(F.lit(REPO_API_PREFIX), F.col("repo_name")).alias("repo_url"),
        "repo_name",
        _text(F.col("r.html_url")).alias("html_url"),
    )
    if repo_ids is None:
        return flat.withColumn("repo_id", F.lit(None).cast("long"))
    return lookup(flat, repo_ids.select("repo_name", "repo_id"), ["repo_name"], [F.col("repo_id")])


def flatten_commits(df: DataFrame, record: str, pr_id: str) -> DataFrame:
    """Commit rows from JSON records; the account name is preferred to the git name."""
    c = F.from_json(F.col(record), API_COMMIT)

    def who(role: str) -> Column:
        login = F.nullif(F.col(f"c.{role}.login"), F.lit(""))
        return F.coalesce(login, F.col(f"c.commit.{role}.name"), F.lit("")).alias(role)

    return df.select(F.col(pr_id).alias("pr_id"), c.alias("c")).select(
        "c.sha", "pr_id", who("author"), who("committer"), _text(F.col("c.commit.message")).alias("message")
    )


def flatten_commit_files(df: DataFrame, record: str) -> DataFrame:
    """Commit detail rows from JSON records; a commit without files keeps one row with NULL file columns."""
    zero = F.lit(0).cast("long")
    c = df.select(F.from_json(F.col(record), API_COMMIT).alias("c"))
    rows = c.select("c", F.explode_outer("c.files").alias("f"))
    has_file = F.col("f").isNotNull()

    def lines(name: str) -> Column:
        return F.when(has_file, F.coalesce(F.col(f"f.{name}"), zero))

    return rows.select(
        "c.sha",
        _text(F.col("c.commit.author.name")).alias("author"),
        _text(F.col("c.commit.committer.name")).alias("committer"),
        _text(F.col("c.commit.message")).alias("message"),
        F.col("f.filename").alias("filename"),
        F.when(has_file, F.coalesce(F.col("f.status"), F.lit("modified"))).alias("status"),
        lines("additions").alias("additions"),
        lines("deletions").alias("deletions"),
        (lines("additions") + lines("deletions")).alias("changes"),
        F.col("f.patch").alias("patch"),
        *[F.coalesce(F.col(f"c.stats.{n}"), zero).alias(f"commit_stats_{n}") for n in ("total", "additions", "deletions")],
    )
