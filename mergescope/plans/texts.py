"""Labelling, parsing and text queries over whole tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.functions.text import (
    canonical_url, classify_title, conventional_label, first_line, repo_of, shorten, strip, within_bytes, word_count,
)
from mergescope.operators.gittext import COMMIT_MARK, MESSAGE_END, build_details
from mergescope.operators.labelling import (
    attribute, classify_table, fixes_with_commits, label_by_title, label_incremental, parse_responses, validate_responses,
)
from mergescope.operators.ranking import sha_batches
from mergescope.session import JOINED_AS_DEALT, settings, shared_folder, stored, stored_by
from mergescope.sources.gitfiles import (
    commit_patches, diff_records, last_statuses, latest, log_files, log_records, read_tasks, status_rows, write_git_text,
)
from mergescope.sources.readers import flatten_commit_files, flatten_commits, flatten_pulls
from mergescope.sources.warehouse import COMMIT_ORDER, Warehouse

# Labels


def classified_summary(w: Warehouse) -> DataFrame:
    """Fix and other rows per source."""
    return classify_table(w.prs.drop("type")).groupBy("source").agg(
        F.count_if(F.col("type") == "fix").alias("fix"), F.count_if(F.col("type") == "other").alias("other")
    )


def classified_documents(w: Warehouse) -> DataFrame:
    """The title rule over every document's whole text and over its first line."""
    text = w.table("documents").select("lang", classify_title(F.col("text")).alias("whole"), classify_title(first_line(F.col("text"))).alias("head"))
    return text.groupBy("lang", "whole", "head").agg(F.count(F.lit(1)).alias("n"))


def fix_commit_rows(w: Warehouse) -> DataFrame:
    """Rows left of each table after keeping what belongs to fixes."""
    fixes, commits, details = fixes_with_commits(w.prs, w.commits, w.details)
    return (
        fixes.agg(F.count(F.lit(1)).alias("prs"))
        .withColumns(
            {
                "commits": commits.agg(F.count(F.lit(1))).scalar(),
                "details": details.agg(F.count(F.lit(1))).scalar(),
            }
        )
    )


def conventional_labels(w: Warehouse) -> DataFrame:
    labelled = label_by_title(w.prs.select("id", "title"))
    return labelled.groupBy("label", "confidence", "reason").agg(F.count(F.lit(1)).alias("n"))


def _titles(w: Warehouse) -> DataFrame:
    """Titles in every shape the labeller meets, one per order line."""
    kinds = (
        "feat!", "feature", "FIX(api)", "docs(readme)!", "ci/cd", "Chore", "revert:", "testing", "style", "perf_x", "other", "build(",
        "refactor)", "test",
    )
    shape = F.col("l_linenumber") + F.when(F.col("l_linestatus") == "O", 7).otherwise(0)
    kind = F.element_at(F.array(*[F.lit(t) for t in kinds]), shape.cast("int"))
    return w.table("lineitem").select(F.col("l_orderkey").alias("id"), F.concat(kind, F.lit(" "), F.col("l_returnflag"), F.lit("\nfix: second line")).alias("title"))


def title_shapes(w: Warehouse) -> DataFrame:
    return _titles(w).groupBy(first_line(F.col("title")).alias("head"), conventional_label(F.col("title")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def incremental_labels(w: Warehouse) -> DataFrame:
    """Rows of each outcome when the other side's rows are done already."""
    labelled, queue = label_incremental(w.prs.select("id", "title", "agent"), w.theirs_all)
    done = labelled.groupBy("agent").agg(F.count(F.lit(1)).alias("labelled"), F.countDistinct("label").alias("labels"))
    return done.join(queue.groupBy("agent").agg(F.count(F.lit(1)).alias("queued")), "agent", "outer").na.fill(0)


def _responses(w: Warehouse) -> DataFrame:
    """Raw model answers built from the events: plain objects, objects inside text, arrays and bad values."""
    label = F.when(F.col("event_type") == "click", "Fix").when(F.col("event_type") == "view", "docs ").when(
        F.col("event_type") == "signup", "feature").otherwise("chore")
    confidence = F.floor("value").cast("long").cast("string")
    quoted = F.when(F.col("event_type") == "view", F.concat(F.lit('"'), confidence, F.lit('"'))).otherwise(confidence)
    reason = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(', "reason": " because '), F.col("user_id").cast("string"), F.lit(' "')))
    body = F.concat(F.lit('{"output": "'), label, F.lit('", "confidence": '), quoted, reason, F.lit("}"))
    raw = (
        F.when(F.col("value") > 60, F.lit("no answer given"))
        .when(F.col("value") > 40, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone.")))
        .when(F.col("value") > 30, F.concat(F.lit("["), body, F.lit("]")))
        .when((F.col("value") > 8) & (F.col("value") < 9), F.substring(body, 1, 20))
        .otherwise(body)
    )
    return w.table("events").select("event_id", raw.alias("raw"))


def response_outcomes(w: Warehouse) -> DataFrame:
    return parse_responses(_responses(w), "raw").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def valid_responses(w: Warehouse) -> DataFrame:
    return validate_responses(_responses(w), "raw")[0].select("event_id", "label", "confidence", "reason")


def quarantined_responses(w: Warehouse) -> DataFrame:
    return validate_responses(_responses(w), "raw")[1].select("event_id", "raw", "problem")


def attributed_authors(w: Warehouse) -> DataFrame:
    """Agent rows per author group, attributed by the user names the other side lists."""
    users = w.theirs_all.select("user", "agent", "id")
    return attribute(w.prs.select("id", "user"), users, ["id"]).groupBy("is_agent", "agent").agg(F.count(F.lit(1)).alias("n"))


# Git text

#: The order of the lines of a log.
LINE = ["pr_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


def _sha(part: str, supplier: str) -> Column:
    return F.sha1(F.concat_ws("-", F.col(part).cast("string"), F.col(supplier).cast("string")))


def _git_lines(w: Warehouse) -> DataFrame:
    """Order lines as entries of their repository's log, status list and diff, without the texts.

    A third of the suppliers have logs of their own by tens, all others share one, which so holds most of the table. A pair
    of part and supplier is a commit, and comes back in its log with every order of that pair.
    """
    return w.table("lineitem").select(
        F.col("l_orderkey").alias("pr_id"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 10).otherwise(10).cast("int").alias("repo"),
        F.concat(F.lit("src/"), F.col("l_linenumber").cast("string"), F.lit(".py")).alias("file"),
        F.col("l_quantity").cast("long").cast("string").alias("add"),
        F.round(F.col("l_discount") * 100).cast("long").cast("string").alias("del"),
        *LINE[1:],
        "l_returnflag",
    )


def _git_texts() -> dict[str, Column]:
    """What a line adds to each kind of git text, from the columns of `_git_lines`."""
    sha = _sha("l_partkey", "l_suppkey")
    numstat = F.concat(
        F.lit("\n\n"), F.col("add"), F.lit("\t"), F.col("del"), F.lit("\t"), F.col("file"), F.lit("\n-\t-\tlogo.png\nnot a numstat line")
    )
    listed = F.when(F.col("l_tax") > 0, numstat).otherwise("")
    log = F.concat(
        F.lit(COMMIT_MARK + "\n"), sha, F.lit("\nName "), F.col("l_suppkey").cast("string"), F.lit("\nBot\nFix line\n\nbody of "),
        F.col("file"), F.lit("\n" + MESSAGE_END), listed,
    )
    # Lines without a header of their own belong to the commit above them.
    status = F.when(
        F.col("l_tax") > 0, F.concat(sha, F.lit("\n\n"), F.col("l_returnflag"), F.lit("\t"), F.col("file"), F.lit("\nM100\tlogo.png"))
    ).otherwise(F.concat(F.lit("T\textra.txt\nD\t"), F.col("file")))
    diff = F.concat(
        F.lit("diff --git a/"), F.col("file"), F.lit(" b/"), F.col("file"), F.lit("\n--- a\n+++ b\n@@\n+"), F.repeat(F.lit("x"), F.col("add").cast("int")),
        F.lit("\ndiff --git a/logo.png b/logo.png\nBinary files differ"),
    )
    marked = F.concat(F.lit(COMMIT_MARK + "\n"), sha, F.lit("\n\n"), diff)
    return {"log": log, "status": status, "diff": diff, "marked": marked}


def _git_files(w: Warehouse, kind: str) -> str:
    """Folder of the files of one kind of git text, a folder for each repository."""
    path = f"{shared_folder(w.spark)}/runs/git-{kind}-{uuid4().hex}"
    write_git_text(_git_lines(w), _git_texts()[kind], path, "repo", LINE)
    return path


def numstat_totals(w: Warehouse) -> DataFrame:
    """Changes per file over the last entry of every commit."""
    path = _git_files(w, "log")
    last = latest(log_records(w.spark, path), ["log", "sha"], read_tasks(w.spark, path))
    return log_files(last).groupBy("filename").agg(
        F.count(F.lit(1)).alias("n"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )


def log_headers(w: Warehouse) -> DataFrame:
    path = _git_files(w, "log")
    commits = latest(log_records(w.spark, path), ["log", "sha"], read_tasks(w.spark, path))
    return commits.groupBy("author", "committer", "message").agg(F.count(F.lit(1)).alias("n"))


def status_words(w: Warehouse) -> DataFrame:
    statuses = last_statuses(status_rows(w.spark, _git_files(w, "status")))
    return statuses.groupBy("log", "filename", "status").agg(F.count(F.lit(1)).alias("n"))


def patch_sizes(w: Warehouse) -> DataFrame:
    """Sizes of the last patch of every commit's files, those above a cap left out."""
    path = _git_files(w, "marked")
    patches = latest(commit_patches(w.spark, path, cap=50), ["log", "sha", "filename"], read_tasks(w.spark, path))
    return patches.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n"), F.count("patch").alias("kept"), F.sum(F.octet_length("patch")).alias("bytes")
    )


def whole_patch_sizes(w: Warehouse) -> DataFrame:
    """Sizes of all patches in diffs of any length, none left out."""
    return diff_records(w.spark, _git_files(w, "diff")).groupBy("log", "filename").agg(
        F.count("patch").alias("n"), F.sum(F.octet_length("patch")).alias("bytes")
    )


def commit_details(w: Warehouse) -> DataFrame:
    """Detail rows rebuilt from git text, summed per file status.

    Each table is shuffled once, by sha, and stored; nothing of them is shuffled where they are joined. A table's shuffle is gone
    before that of the next.
    """
    marked = _git_files(w, "marked")
    tasks = read_tasks(w.spark, marked)
    patches = stored_by(latest(commit_patches(w.spark, marked), ["sha", "filename"], tasks, by=["sha"]), "patches", "sha", tasks)
    listed = status_rows(w.spark, _git_files(w, "status"))
    statuses = stored_by(last_statuses(listed, ["sha", "filename"], tasks, by=["sha"]), "statuses", "sha", tasks)
    commits = stored_by(latest(log_records(w.spark, _git_files(w, "log")), ["sha"], tasks), "commits", "sha", tasks)
    holders = _git_lines(w).select(_sha("l_partkey", "l_suppkey").alias("sha"), "pr_id")
    holders = stored_by(holders.repartition(tasks, "sha").distinct(), "holders", "sha", tasks)
    details = build_details(commits, log_files(commits), statuses, patches, holders)
    summary = details.groupBy("filename", "status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pr_id").alias("prs"), F.sum("changes").alias("changes"),
        F.sum("commit_stats_total").alias("commit_total"), F.sum(F.octet_length("patch")).alias("patch_bytes"),
        F.sum(F.char_length("message")).alias("message_length"),
    )
    with settings(w.spark, JOINED_AS_DEALT | {"spark.sql.shuffle.partitions": tasks}):
        return stored(summary, "details")


def sha_work_list(w: Warehouse) -> DataFrame:
    return sha_batches(w.commits, w.prs, [*COMMIT_ORDER, "pr_id"], size=50)


# API records


def _pull_json(w: Warehouse) -> DataFrame:
    prs = w.prs
    record = F.to_json(
        F.struct(
            "id", "number", "title", F.struct(F.col("user").alias("login"), F.col("user_id").alias("id")).alias("user"), "state",
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            F.when(F.col("is_merged"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("merged_at"),
            F.when(F.col("state") == "open", F.struct(F.lit(None).cast("string").alias("merged_at"))).alias("pull_request"),
            "html_url",
        )
    )
    return prs.select("repo_name", "repo_id", record.alias("record"))


def flattened_pulls(w: Warehouse) -> DataFrame:
    source = _pull_json(w)
    flat = flatten_pulls(source, "record", "repo_name", source.select("repo_name", "repo_id"))
    return flat.groupBy("state", F.date_format("created_at", "yyyy").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count("merged_at").alias("merged"), F.sum("user_id").alias("user_ids"),
        F.count_if(F.col("body") == "").alias("empty_bodies"), F.count("repo_id").alias("with_repo_id"),
        F.max("repo_url").alias("last_repo_url"),
    )


def _commit_json(w: Warehouse) -> DataFrame:
    line = w.table("lineitem")
    name = F.concat(F.lit("Name "), F.col("l_suppkey").cast("string"))
    login = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("dev-"), F.col("l_suppkey").cast("string")))
    one = F.struct(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("filename"), F.col("l_quantity").cast("long").alias("additions"),
        F.when(F.col("l_linestatus") == "O", "added").alias("status"), F.lit("@@").alias("patch"),
    )
    record = F.to_json(
        F.struct(
            _sha("l_partkey", "l_suppkey").alias("sha"),
            F.when(login.isNotNull(), F.struct(login.alias("login"))).alias("author"),
            F.struct(F.struct(name.alias("name")).alias("author"), F.lit("msg").alias("message")).alias("commit"),
            F.when(F.col("l_tax") > 0, F.array(one, one)).otherwise(F.array().cast("array<struct<filename:string,additions:bigint,status:string,patch:string>>")).alias("files"),
            F.struct(F.col("l_quantity").cast("long").alias("total")).alias("stats"),
        )
    )
    return line.select(F.col("l_orderkey").alias("pr_id"), record.alias("record"))


def flattened_commits(w: Warehouse) -> DataFrame:
    return flatten_commits(_commit_json(w), "record", "pr_id").groupBy("author", "committer", "message").agg(
        F.count(F.lit(1)).alias("n"), F.min("sha").alias("first_sha")
    )


def flattened_commit_files(w: Warehouse) -> DataFrame:
    return flatten_commit_files(_commit_json(w), "record").groupBy("filename", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("changes").alias("changes"), F.sum("deletions").alias("deletions"),
        F.sum("commit_stats_total").alias("totals"), F.count("patch").alias("patches"),
    )


# Text functions


def page_addresses(w: Warehouse) -> DataFrame:
    """Repository and canonical address of addresses in several shapes, one set per page."""
    path = F.concat_ws("/", F.lit("own"), F.concat(F.lit("r"), F.col("page_id").cast("string")))
    shapes = F.array(
        F.concat(F.lit("https://api.github.com/repos/"), path), F.concat(F.lit("https://github.com/"), path, F.lit("/pull/7")),
        F.concat(F.lit("http://github.com/"), path, F.lit("/")), F.col("url"), F.lit(None).cast("string"),
    )
    return w.table("pages").select("page_id", F.posexplode(shapes).alias("shape", "address")).select(
        "page_id", "shape", repo_of(F.col("address")).alias("repo"), canonical_url(F.col("address")).alias("canonical")
    )


def text_functions(w: Warehouse) -> DataFrame:
    """Words, first line, trimmed ends, shortened form and byte cap of every document."""
    text = F.col("text")
    return w.table("documents").select(
        "doc_id", word_count(text).cast("int").alias("words"), F.md5(first_line(text)).alias("head_hash"),
        F.length(strip(F.concat(F.lit("  \t"), text, F.lit("  \n")))).alias("stripped"),
        shorten(F.replace(text, F.lit("\n"), F.lit(" "))).alias("short"),
        F.octet_length(within_bytes(text, 2000)).alias("capped_bytes"),
    )


def turn_lengths(w: Warehouse) -> DataFrame:
    return w.table("conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(word_count(F.col("text"))).alias("words"),
        F.count_if(classify_title(F.col("text")) == "fix").alias("fixes"),
    )


PLANS = {
    "c1_classified_summary": classified_summary,
    "c1_classified_documents": classified_documents,
    "c1_fix_commit_rows": fix_commit_rows,
    "c2_conventional_labels": conventional_labels,
    "c2_title_shapes": title_shapes,
    "c3_incremental_labels": incremental_labels,
    "c4_response_outcomes": response_outcomes,
    "c4_valid_responses": valid_responses,
    "c4_quarantined_responses": quarantined_responses,
    "c5_attributed_authors": attributed_authors,
    "p1_numstat_totals": numstat_totals,
    "p1_log_headers": log_headers,
    "p2_status_words": status_words,
    "p3_patch_sizes": patch_sizes,
    "p3_whole_patch_sizes": whole_patch_sizes,
    "p4_commit_details": commit_details,
    "p5_sha_work_list": sha_work_list,
    "s6_flattened_pulls": flattened_pulls,
    "s6_flattened_commits": flattened_commits,
    "s6_flattened_commit_files": flattened_commit_files,
    "text_page_addresses": page_addresses,
    "text_functions": text_functions,
    "text_turn_lengths": turn_lengths,
}
