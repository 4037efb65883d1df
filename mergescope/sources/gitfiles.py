"""Git text in files of any size: logs, status lists and diffs that many tasks read.

A file is cut into byte ranges, and the reader of a range goes on to the end of its last record, so records are whole
wherever the edges fall. Logs and diffs are read record by record, by the mark that opens one. Status lists are read line
by line; a line belongs to the last header above it, which may stand in an earlier range: every range fills its own lines
on, and the lines above its first header take the last header of the ranges before it, in its file or, in a log's folder,
in the log's files before it.

Every row carries `at`, its place: file, first byte of its range, and number of the row. Places order the rows of a file.
Text is written after the shuffle that puts a log in order, from the columns it is made of, and is shuffled once where the
last rows of keys are looked for. The tasks of both grow with the input, so that a task's memory does not. Files are written
compressed, with few enough rows each for one task to read; files from elsewhere may be plain and of any size. Shas are
shuffled as bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergescope.functions.text import strip, within_bytes
from mergescope.operators.gittext import COMMIT_MARK, is_log_entry, is_patch, log_fields, numstat_files, patch_fields, status_word
from mergescope.session import SHUFFLES_FREED, settings

# What runs in executors travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that one task puts in order and writes, about.
ROWS_A_TASK = 500_000
#: Files that those rows go to: a compressed file is read by one task, and a task reads several.
FILES_A_TASK = 20
#: Of such files, those whose rows one task looks through for the last of each key.
FILES_SHUFFLED = 8

HEADER = r"^\s*([0-9a-f]{40})"


def write_git_text(df: DataFrame, text: str | Column, path: str, log: str, order: Sequence[str]) -> None:
    """Write one folder per log with its texts in the stated order, over as many files as the log needs.

    Rows are dealt out by ranges of (log, order), so a log that holds much of the table is written by many tasks; the names
    of its files rise in its order. A newline closes every text. A text given as an expression is made after rows are dealt
    out, so its columns are shuffled in its place. What is shuffled is removed when the files are written.
    """
    keys = [log, *order]
    parts = -(-df.count() // ROWS_A_TASK)
    many = [parts] if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    rows = df.repartitionByRange(*many, *keys).sortWithinPartitions(*keys)
    text = F.col(text) if isinstance(text, str) else text
    write = rows.select(text.alias("text"), F.col(log).alias("log")).write.partitionBy("log")
    write = write.option("maxRecordsPerFile", max(1, ROWS_A_TASK // FILES_A_TASK)).option("zlib.compress.level", "BEST_SPEED")
    with settings(df.sparkSession, SHUFFLES_FREED):
        write.text(path, compression="gzip")


def read_tasks(spark: SparkSession, path: str) -> int:
    """Tasks to shuffle the text of a path with: as many as read it, or as the session's settings name, if more.

    Compressed text is several times as much as its files, so there is a task for every few of them, if that is more.
    """
    read = spark.read.text(path)
    reading, packed = read.rdd.getNumPartitions(), sum(f.endswith(".gz") for f in read.inputFiles())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), reading, min(packed // FILES_SHUFFLED, 8 * reading))


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(log, at, text) of the records of all files under a path, by the text that separates them."""
    read = spark.read.option("lineSep", separator).text(path)
    # The files' common folder says nothing and would be in every row.
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    file = F.col("_metadata.file_path")
    at = F.instr(file, folder)
    place = F.struct(
        F.when(at > 0, F.substr(file, at + F.lit(len(folder)))).otherwise(file).alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"),
    )
    log = F.col("log") if "log" in read.columns else F.lit(None).cast("int")
    return read.select(log.alias("log"), place.alias("at"), F.col("value").alias("text"))


def _bytes(sha: Column) -> Column:
    """A sha in half its length; other text stays as it is, behind another mark."""
    return F.when(sha.rlike(r"^[0-9a-f]{40}\z"), F.concat(F.lit(b"\1"), F.unhex(sha))).otherwise(F.concat(F.lit(b"\0"), sha.cast("binary")))


def _hex(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _dealt(rows: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Rows dealt out by their keys to so many tasks, the sha in bytes on its way."""
    if "sha" not in rows.columns:
        return rows.repartition(tasks, *keys)
    by = [_hex(F.col(k)) if k == "sha" else F.col(k) for k in keys]
    packed = rows.withColumn("sha", _bytes(F.col("sha"))).repartition(tasks, *by)
    return packed.withColumn("sha", _hex(F.col("sha")))


def latest(rows: DataFrame, keys: Sequence[str], tasks: int | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Of the rows with the same key that of the last place, looked for by so many tasks; see `read_tasks`.

    Rows are dealt out to them by their keys, or by some of the keys.
    """
    dealt = rows if tasks is None else _dealt(rows, by or keys, tasks)
    from_last = Window.partitionBy(*keys).orderBy(F.desc("at"))
    return dealt.withColumn("place__", F.row_number().over(from_last)).where("place__ = 1").drop("place__")


def log_records(spark: SparkSession, path: str) -> DataFrame:
    """(log, at, sha, author, committer, message, numstat) of every entry of the logs, repeated commits too."""
    found = _records(spark, path, COMMIT_MARK + "\n").where(is_log_entry(F.col("text")))
    return found.select("log", "at", *[c.alias(name) for name, c in log_fields(F.col("text")).items()])


def log_files(records: DataFrame) -> DataFrame:
    """(log, at, sha, filename, additions, deletions) of the files that the entries list."""
    return numstat_files(records, "numstat", ["log", "at", "sha"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, start, row, header, ...) in reading order, with the last header of the same range in every row."""
    range_, header = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(0), batch.column(1).to_numpy()
        same = pc.equal(files.slice(1), files.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(~same.astype(bool) | (starts[1:] != starts[:-1])) + 1
        parts = []
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            here = (files[s].as_py(), int(starts[s]))
            column = batch.column(3).slice(s, e - s)
            filled = pc.fill_null_forward(column)
            if here == range_ and header is not None:
                filled = pc.fill_null(filled, header)
            range_, header = here, filled[-1].as_py()
            parts.append(filled)
        columns = list(batch.columns)
        columns[3] = pa.concat_arrays(parts)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def status_rows(spark: SparkSession, path: str) -> DataFrame:
    """(log, at, sha, filename, letter) of every line of the status lists; lines above the first header of a log, or of a file
    outside of logs' folders, are left out."""
    lines = _records(spark, path, "\n")
    sha = F.nullif(F.regexp_extract("text", HEADER, 1), F.lit(""))
    marked = lines.select("log", "at", sha.alias("header"), "text").where(F.col("header").isNotNull() | F.contains("text", F.lit("\t")))
    # What ranges hand on: their last header; one row a range, so a file's rows are few.
    last = marked.where("header IS NOT NULL").groupBy("at.file", "at.start").agg(F.max_by("header", "at.row").alias("header"))
    ranges = marked.select("log", "at.file", "at.start").distinct().join(last, ["file", "start"], "left")
    # The files of one log go on from each other, in the order of their names.
    one = F.when(F.col("log").isNull(), F.col("file"))
    before = Window.partitionBy("log", one).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    handed = ranges.select("file", "start", F.last("header", ignorenulls=True).over(before).alias("handed"))
    flat = marked.select("at.file", "at.start", "at.row", "header", F.col("header").isNotNull().alias("is_header"), "log", "text")
    filled = flat.mapInArrow(_filled, flat.schema).where("NOT is_header").drop("is_header")
    open_ = filled.where("header IS NULL").drop("header").join(handed.where("handed IS NOT NULL"), ["file", "start"])
    whole = filled.where("header IS NOT NULL").unionByName(open_.withColumnRenamed("handed", "header"))
    trimmed = strip(F.col("text"))
    letter = F.substring_index(trimmed, "\t", 1)
    name = strip(F.substr(trimmed, F.char_length(letter) + F.lit(2)))
    return whole.select("log", F.struct("file", "start", "row").alias("at"), F.col("header").alias("sha"), name.alias("filename"), strip(letter).alias("letter"))


def last_statuses(
    rows: DataFrame, keys: Sequence[str] = ("log", "sha", "filename"), tasks: int | None = None, by: Sequence[str] | None = None
) -> DataFrame:
    """(keys, status): the word of each file's last line; dealt out as in `latest`."""
    dealt = rows if tasks is None else _dealt(rows, by or keys, tasks)
    last = dealt.groupBy(*keys).agg(F.max_by("letter", "at").alias("letter"))
    return last.select(*keys, status_word(F.col("letter")).alias("status"))


def _closed(text: Column) -> Column:
    """A text that ends with one newline: records lose theirs to the separator, and blank lines are no part of a patch."""
    return F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n"))


def _capped(patch: Column, cap: int | None) -> Column:
    return patch if cap is None else within_bytes(patch, cap)


def diff_records(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(log, at, filename, patch) of every file in diffs without commit marks, each read by as many tasks as it has ranges."""
    text = F.regexp_replace(_closed(F.col("text")), "^diff --git ", "")
    found = _records(spark, path, "\ndiff --git ").select("log", "at", text.alias("text")).where(is_patch(F.col("text")))
    name, patch = patch_fields(F.col("text")).values()
    return found.select("log", "at", name.alias("filename"), _capped(patch, cap).alias("patch"))


def commit_patches(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """(log, at, sha, filename, patch) of diffs whose commits stand behind marks, each mark followed by the sha's line."""
    found = _records(spark, path, COMMIT_MARK + "\n").where(F.col("text").rlike(HEADER))
    sha = F.regexp_extract("text", HEADER, 1)
    blocks = F.posexplode(F.split(F.col("text"), r"(?m)^diff --git "))
    cut = found.select("log", "at", sha.alias("sha"), blocks.alias("part", "block"))
    block = _closed(F.col("block"))
    name, patch = patch_fields(block).values()
    at = F.struct("at.file", "at.start", "at.row", "part")
    return cut.where((F.col("part") > 0) & is_patch(block)).select("log", at.alias("at"), "sha", name.alias("filename"), _capped(patch, cap).alias("patch"))
