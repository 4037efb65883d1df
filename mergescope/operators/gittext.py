"""Structured rows from the text that git prints: numstat logs, name-status lists and unified diffs.

Documents are cut with regular expressions inside Spark and exploded; a header travels with its own segment, so no
window has to carry state from line to line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergescope.functions.text import strip, within_bytes
from mergescope.operators.joins import fan_out

# Write logs with these marks before each commit and after its message: git log --numstat --format with the lines
# COMMIT_MARK, %H, %an, %cn, %B and MESSAGE_END.
COMMIT_MARK = "<<commit entry>>"
MESSAGE_END = "<<end of message>>"

# The words for git's status letters.
STATUS_WORDS = {
    "A": "added", "M": "modified", "D": "removed", "R": "renamed", "C": "copied", "T": "changed",
}
DEFAULT_STATUS = "modified"


def _line(text: Column, number: int) -> Column:
    return strip(F.substring_index(F.substring_index(text, "\n", number), "\n", -1))


def _after(text: Column, head: Column, skip: int) -> Column:
    return F.substr(text, F.char_length(head) + F.lit(skip + 1))


def _newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def _last_entries(df: DataFrame, keep: Sequence[str], entries: Column, key: Sequence[str]) -> DataFrame:
    """One row per key of each document's entries, the last one; the structs begin with the key and then the position.

    Repeats are dropped inside the document by sorting its own entries, so no text is shuffled.
    """
    ordered = df.select(*keep, F.array_sort(entries).alias("entries__"))

    def unless_repeated(entry: Column, following: Column) -> Column:
        same = F.lit(True)
        for name in key:
            same = same & entry[name].eqNullSafe(following[name])
        return F.when(following.isNull() | ~same, entry)

    following = F.slice("entries__", F.lit(2), F.greatest(F.size("entries__"), F.lit(1)))
    kept = F.array_compact(F.zip_with("entries__", following, unless_repeated))
    return ordered.select(*keep, F.inline(kept))


def is_log_entry(block: Column) -> Column:
    """Whether a block holds a whole entry: three lines of header and the message's closing mark."""
    return F.contains(block, F.lit(MESSAGE_END)) & (_newlines(F.substring_index(block, MESSAGE_END, 1)) >= 3)


def log_fields(block: Column) -> dict[str, Column]:
    """The parts of a log entry, from its sha on."""
    head = F.substring_index(block, MESSAGE_END, 1)
    return {
        "sha": _line(head, 1),
        "author": _line(head, 2),
        "committer": _line(head, 3),
        "message": strip(_after(head, F.substring_index(head, "\n", 3), 1)),
        "numstat": _after(block, head, len(MESSAGE_END)),
    }


def patch_fields(block: Column) -> dict[str, Column]:
    """File name and patch of one file's part of a diff, from behind its opening words."""
    head = F.substring_index(block, "\n", 1)
    return {"filename": strip(_after(head, F.substring_index(head, " b/", 1), 3)), "patch": _after(block, head, 1)}


def is_patch(block: Column) -> Column:
    return F.contains(block, F.lit("\n")) & F.contains(F.substring_index(block, "\n", 1), F.lit(" b/"))


def status_word(letter: Column) -> Column:
    """The word of a status letter; unknown letters stay."""
    words = F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.substring(letter, 1, 1)), letter)


def log_commits(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per commit of a numstat log, with the text of its file list; within a log the last entry of a commit wins.

    A commit's entry is its mark, then lines for the sha, the author and the committer, then the message up to its own mark.
    """

    def entry(block: Column, position: Column) -> Column:
        return F.struct(log_fields(block)["sha"].alias("sha"), position.alias("pos"), block.alias("block"))

    blocks = F.filter(F.transform(F.split(F.col(text), COMMIT_MARK), strip), is_log_entry)
    commits = _last_entries(df, keep, F.transform(blocks, entry), ["sha"])
    return commits.select(*keep, *[c.alias(name) for name, c in log_fields(F.col("block")).items()])


def numstat_files(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """File rows of a numstat list; binary files count as zero lines and malformed lines are skipped."""
    line = F.col("line")
    lines = df.select(*keep, F.explode(F.split(strip(F.col(text)), "\n")).alias("line"))

    def count(found: Column) -> Column:
        return F.when(found == "-", F.lit(0).cast("long")).otherwise(found.try_cast("long"))

    opening = F.substring_index(line, "\t", 2)
    rows = lines.where(F.char_length(opening) < F.char_length(line)).select(
        *keep,
        count(F.substring_index(line, "\t", 1)).alias("additions"),
        count(F.substring_index(opening, "\t", -1)).alias("deletions"),
        _after(line, opening, 1).alias("filename"),
    )
    return rows.where("additions IS NOT NULL AND deletions IS NOT NULL")


def name_status(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(sha, filename, status) of a name-status list; lines before the first commit header are skipped."""
    header = r"^\s*([0-9a-f]{40})"
    tab = F.lit("\t")

    def segment_rows(segment: Column, part: Column) -> Column:
        sha = F.regexp_extract(segment, header, 1)
        lines = F.filter(F.slice(F.split(F.btrim(segment), "\n"), F.lit(2), F.char_length(segment)), lambda line: F.contains(line, tab))

        def row(line: Column, position: Column) -> Column:
            trimmed = strip(line)
            letter = F.substring_index(trimmed, "\t", 1)
            return F.struct(
                sha.alias("sha"), strip(_after(trimmed, letter, 1)).alias("filename"), part.alias("part"), position.alias("pos"),
                strip(letter).alias("letter"),
            )

        return F.transform(lines, row)

    segments = F.filter(F.split(F.col(text), r"(?m)^(?=\s*[0-9a-f]{40})"), lambda s: s.rlike(header))
    entries = F.flatten(F.transform(segments, segment_rows))
    return _last_entries(df, keep, entries, ["sha", "filename"]).select(
        *keep, "sha", "filename", status_word(F.col("letter")).alias("status")
    )


def diff_files(df: DataFrame, text: str, keep: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """(filename, patch) of a unified diff; with a byte cap, a patch above it is NULL."""

    def entry(block: Column, position: Column) -> Column:
        name, body = patch_fields(block).values()
        return F.struct(name.alias("filename"), position.alias("pos"), (body if cap is None else within_bytes(body, cap)).alias("patch"))

    blocks = F.filter(F.split(F.col(text), r"(?m)^diff --git "), is_patch)
    return _last_entries(df, keep, F.transform(blocks, entry), ["filename"]).select(*keep, "filename", "patch")


def build_details(
    commits: DataFrame, files: DataFrame, statuses: DataFrame, patches: DataFrame | None, holders: DataFrame
) -> DataFrame:
    """Commit detail rows: files with status and patch, commit totals, one row per pull request holding the commit.

    commits: (sha, author, committer, message), files: (sha, filename, additions, deletions), statuses: (sha, filename,
    status), patches: (sha, filename, patch), each with one row per key. Rows get their message and their patch before they
    are repeated for the pull requests, so a text is shuffled once or twice, not once for every holder of its commit.
    """
    totals = files.groupBy("sha").agg(
        F.sum("additions").alias("commit_stats_additions"), F.sum("deletions").alias("commit_stats_deletions")
    )
    described = files.select("sha", "filename", "additions", "deletions").join(
        statuses.select("sha", "filename", "status"), ["sha", "filename"], "left"
    ).withColumn("status", F.coalesce("status", F.lit(DEFAULT_STATUS)))
    if patches is None:
        described = described.withColumn("patch", F.lit(None).cast("string"))
    else:
        described = described.join(patches.select("sha", "filename", "patch"), ["sha", "filename"], "left")
    whole = (
        commits.select("sha", "author", "committer", "message")
        .join(totals, "sha", "left")
        .join(described, "sha", "left")
        .na.fill(0, ["commit_stats_additions", "commit_stats_deletions"])
        .withColumns(
            {
                "commit_stats_total": F.col("commit_stats_additions") + F.col("commit_stats_deletions"),
                "changes": F.col("additions") + F.col("deletions"),
                "pr_id": F.lit(None).cast("long"),
            }
        )
    )
    return fan_out(whole, holders)
