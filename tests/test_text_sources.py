"""Git text, API records, readers, sinks and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from mergescope.operators.gittext import (
    COMMIT_MARK, MESSAGE_END, build_details, diff_files, log_commits, name_status, numstat_files,
)
from mergescope.schema import COMMITS, PULL_REQUESTS, conform, normalize_prs
from mergescope.session import JOINED_AS_DEALT, settings, stored, stored_by
from mergescope.sources.gitfiles import (
    commit_patches, diff_records, last_statuses, latest, log_files, log_records, read_tasks, status_rows, write_git_text,
)
from mergescope.sources.readers import flatten_commit_files, flatten_commits, flatten_pulls, load_table, only_values, status_documents, status_entries, status_lists
from mergescope.sources.sinks import (
    compact, report, report_rows, schema_diff, write_by_source, write_csv, write_parquet, write_preview, write_report,
)
from mergescope.streaming.incremental import append_to, daily_counts, dedup_stream, keep_latest, monthly_update
from tests.test_operators import rows

A, B, C = "a" * 40, "b" * 40, "c" * 40
LOG = (
    f"preamble\n{COMMIT_MARK}\n{A}\nAnn\nBot\nFix it\n\nbody\n{MESSAGE_END}\n\n3\t1\tsrc/a b.py\n-\t-\tlogo.png\nbroken line\n1\tx\ty\n"
    f"{COMMIT_MARK}\n{B}\nBob\nBob\n\n{MESSAGE_END}\n{COMMIT_MARK}\nno end\n{COMMIT_MARK}\n{A}\nAnn2\nBot\nagain\n{MESSAGE_END}\n5\t0\tz\tq.py\n"
)


def text(spark, value):
    return spark.createDataFrame([(1, value)], "repo int, text string")


def test_numstat_log(spark):
    commits = log_commits(text(spark, LOG), "text", ["repo"])
    assert rows(commits, "sha", "author", "committer", "message") == [(A, "Ann2", "Bot", "again"), (B, "Bob", "Bob", "")]
    once = log_commits(text(spark, LOG.split(f"{COMMIT_MARK}\nno end")[0]), "text", ["repo"])
    assert rows(once.where(F.col("sha") == A), "message") == [("Fix it\n\nbody",)]
    assert rows(numstat_files(once, "numstat", ["sha"])) == [(A, 0, 0, "logo.png"), (A, 3, 1, "src/a b.py")]
    assert rows(numstat_files(commits, "numstat", ["sha"])) == [(A, 5, 0, "z\tq.py")]


def test_name_status(spark):
    doc = f"M\tlost\n{A}\nA\tx.py\nM\ty.py\nR100\tz.py\nQ\tw.py\n\n{B} extra\nD\tx.py\n{A}\nD\tx.py\n"
    assert rows(name_status(text(spark, doc), "text"), "sha", "filename", "status") == [
        (A, "w.py", "Q"), (A, "x.py", "removed"), (A, "y.py", "modified"), (A, "z.py", "renamed"), (B, "x.py", "removed")
    ]


def test_diff(spark):
    doc = "diff --git a/x.py b/x.py\n@@\n+é\ndiff --git a/big b/big\n" + "+" * 40 + "\ndiff --git broken\n\ndiff --git a/x.py b/x.py\nlast"
    assert rows(diff_files(text(spark, doc), "text", cap=20)) == [("big", None), ("x.py", "last")]
    whole = diff_files(text(spark, "diff --git a/x b/x\n@@\n+é\n"), "text")
    assert rows(whole) == [("x", "@@\n+é\n")]


def test_details_are_rebuilt(spark):
    commits = log_commits(text(spark, LOG), "text").withColumn("at", F.col("sha"))
    files = numstat_files(commits, "numstat", ["sha"])
    statuses = spark.createDataFrame([(A, "other", "added")], "sha string, filename string, status string")
    patches = spark.createDataFrame([(7, A, "z\tq.py", "@@"), (8, A, "other", "--")], "at int, sha string, filename string, patch string")
    held = spark.createDataFrame([(A, 1), (A, 2), (B, 1)], "sha string, pr_id long")
    built = build_details(commits, files, statuses, patches, held)
    assert rows(built, "sha", "pr_id", "filename", "status", "changes", "patch", "commit_stats_total", "message") == [
        (A, 1, "z\tq.py", "modified", 5, "@@", 5, "again"), (A, 2, "z\tq.py", "modified", 5, "@@", 5, "again"), (B, 1, None, None, None, None, 0, "")
    ]
    assert rows(build_details(commits, files, statuses, None, held), "sha", "pr_id", "patch") == [(A, 1, None), (A, 2, None), (B, 1, None)]
    plan = plan_of(built)
    for line in plan.splitlines():  # neither message nor patch is put in order or taken into an aggregate
        assert not ("Aggregate" in line and ("patch#" in line or "message#" in line)), line


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of so many bytes."""
    known = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield set_to
    for k, v in known.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [37, 64, 150, 1000, 1 << 20])
def test_git_files_are_whole_wherever_ranges_end(spark, tmp_path, small_ranges, size):
    log = LOG + "".join(f"{COMMIT_MARK}\n{i:040x}\nAnn{i}\nBot\nline\n\nélan {i}\n{MESSAGE_END}\n{i}\t1\tf{i}.py\n" for i in range(1, 40))
    doc = f"M\tlost\n{A}\nA\tx.py\nM\ty.py\nR100\tz.py\n\n{B} extra\n" + "".join(f"M\tf{i}.py\n" for i in range(60)) + f"  {A}\nD\tx.py\nQ\tw.py"
    diff = "preamble\n" + "".join(f"diff --git a/d/f{i % 7} b/d/f{i % 7}\n@@ {i}\n+é diff --git a/q b/q\n" for i in range(30)) + "diff --git a/only b/only\n"
    marked = "".join(f"{COMMIT_MARK}\n{c * 40}\n\ndiff --git a/x b/x\n@@ {c}\ndiff --git a/big b/big\n{'+' * 40}\n" for c in "abca")
    for name, value in (("log", log), ("list", doc), ("diff", diff), ("marked", marked)):
        (tmp_path / name).write_text(value)
    small_ranges(size)
    paths = {n: str(tmp_path / n) for n in ("log", "list", "diff", "marked")}
    found = log_records(spark, paths["log"])
    if size == 37:
        assert found.rdd.getNumPartitions() > 50
    assert found.count() == 3 + 39
    once = latest(found, ["sha"])
    whole = log_commits(text(spark, log), "text")
    assert rows(once.select("sha", "author", "committer", "message")) == rows(whole.select("sha", "author", "committer", "message"))
    listed = rows(log_files(once).select("sha", "additions", "deletions", "filename"))
    assert listed == rows(numstat_files(whole, "numstat", ["sha"]))
    assert rows(last_statuses(status_rows(spark, paths["list"]), ["sha", "filename"])) == rows(name_status(text(spark, doc), "text"))
    all_patches = diff_records(spark, paths["diff"])
    assert all_patches.count() == 31
    assert rows(latest(all_patches, ["filename"]).select("filename", "patch")) == rows(diff_files(text(spark, diff), "text"))
    patches = latest(commit_patches(spark, paths["marked"], cap=20), ["sha", "filename"]).select("sha", "filename", "patch")
    assert rows(patches) == [(c * 40, f, None if f == "big" else f"@@ {c}\n") for c in "abc" for f in ("big", "x")]


def test_one_log_is_written_and_read_by_many_tasks(spark, tmp_path):
    entries = spark.range(4000).selectExpr(
        "id", "0 AS repo", f"concat('{COMMIT_MARK}\\n', sha1(string(id % 1000)), '\\nAnn\\nBot\\nno ', id, '\\n{MESSAGE_END}\\n1\\t0\\tf') AS log"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_git_text(entries, "log", f"{tmp_path}/logs", "repo", ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.text(f"{tmp_path}/logs").inputFiles()) > 1
    last = latest(log_records(spark, f"{tmp_path}/logs"), ["log", "sha"])
    assert sorted(r.message for r in last.collect()) == sorted(f"no {i}" for i in range(3000, 4000))


def test_a_log_goes_on_from_file_to_file(spark, tmp_path):
    for log, files in {"log=1": [f"M\tlost\n{A}\nA\tx.py\n", "D\ty.py\n", f"T\tz.py\n{B}\nM\tx.py\n"], "log=2": ["D\tnone.py\n"]}.items():
        (tmp_path / "lists" / log).mkdir(parents=True)
        for i, value in enumerate(files):
            (tmp_path / "lists" / log / f"part-{i}.txt").write_text(value)
    found = status_rows(spark, f"{tmp_path}/lists").select("log", "sha", "filename", "letter")
    assert rows(found) == [(1, A, "x.py", "A"), (1, A, "y.py", "D"), (1, A, "z.py", "T"), (1, B, "x.py", "M")]


def test_text_is_made_after_rows_are_dealt_out_and_shuffled_by_as_many_tasks_as_read_it(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr("mergescope.sources.gitfiles.ROWS_A_TASK", 100)
    mark = F.concat(F.lit(COMMIT_MARK + "\n"), F.sha1(F.concat(F.col("id") % 70, F.lit(""))), F.concat(F.lit("\nAnn\nBot\nno "), "id", F.lit(f"\n{MESSAGE_END}\n1\t0\tf")))
    write_git_text(spark.range(900).withColumn("repo", F.lit(0)), mark, f"{tmp_path}/logs", "repo", ["id"])
    assert len(spark.read.text(f"{tmp_path}/logs").inputFiles()) > 4  # more than the session's shuffle partitions
    small_ranges(4000)
    tasks = read_tasks(spark, f"{tmp_path}/logs")
    assert tasks > 9
    last = latest(log_records(spark, f"{tmp_path}/logs"), ["log", "sha"], tasks)
    assert sorted(r.message for r in last.collect()) == sorted(f"no {i}" for i in range(830, 900))
    assert f", {tasks})" in plan_of(last) and last.rdd.getNumPartitions() == tasks


def test_texts_are_joined_before_rows_are_repeated_for_their_holders(spark):
    commits = spark.createDataFrame([(A, "Ann", "Bot", "m")], "sha string, author string, committer string, message string")
    files = spark.createDataFrame([(A, "f", 1, 2)], "sha string, filename string, additions long, deletions long")
    statuses = spark.createDataFrame([(A, "f", "added")], "sha string, filename string, status string")
    patches = spark.createDataFrame([(A, "f", "@@")], "sha string, filename string, patch string")
    built = build_details(commits, files, statuses, patches, spark.createDataFrame([(A, 1), (A, 2)], "sha string, pr_id long"))
    assert rows(built, "sha", "pr_id", "message", "patch") == [(A, 1, "m", "@@"), (A, 2, "m", "@@")]


def shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_what_writes_shuffle_does_not_stay(spark, tmp_path):
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled_bytes(spark), spark.conf.get(freed)
    write_git_text(spark.range(9000).withColumn("repo", F.lit(0)), F.concat("id", F.lit(" text")), f"{tmp_path}/logs", "repo", ["id"])
    rows_ = spark.range(9000).withColumn("sha", F.sha1(F.col("id").cast("string")))
    counted = stored(rows_.groupBy("sha").count(), "counted")
    table = stored_by(rows_.repartition(3, "sha"), "dealt", "sha", 3)
    for _ in range(50):  # files go a little later
        left = shuffled_bytes(spark) - before
        if left < 5000:  # counts of rows stay
            break
        time.sleep(0.2)
    assert left < 5000
    assert spark.conf.get(freed) == setting
    assert counted.count() == table.count() == 9000 and len(table.inputFiles()) == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt")]


def test_written_text_is_small_and_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mergescope.sources.gitfiles.ROWS_A_TASK", 2000)
    body = "\nAnn\nBot\nThe same words again and again\n" + MESSAGE_END + "\n1\t0\tsrc/file.py"
    mark = F.concat(F.lit(COMMIT_MARK + "\n"), F.sha1((F.col("id") % 700).cast("string")), F.lit(body + " "), "id")
    write_git_text(spark.range(9000).withColumn("repo", F.col("id") % 2), mark, f"{tmp_path}/logs", "repo", ["id"])
    size = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert size < 9000 * (len(COMMIT_MARK) + 41 + len(body)) / 3
    found = log_records(spark, f"{tmp_path}/logs")
    assert found.count() == 9000
    last = latest(found, ["sha"], read_tasks(spark, f"{tmp_path}/logs"))
    assert sorted(int(r.filename.split()[1]) for r in log_files(last).collect() if r.log == 1) == [i for i in range(8300, 9000) if i % 2]


def test_patches_in_small_files_are_shuffled_by_a_task_for_every_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mergescope.sources.gitfiles.ROWS_A_TASK", 100)
    sha = F.sha1((F.col("id") % 600).cast("string"))
    mark = F.concat(F.lit(COMMIT_MARK + "\n"), sha, F.lit("\n\ndiff --git a/x b/x\n@@ "), "id", F.lit("\ndiff --git a/big b/big\n" + "+" * 60))
    path = f"{tmp_path}/marked"
    write_git_text(spark.range(900).withColumn("repo", F.lit(0)), mark, path, "repo", ["id"])
    files, tasks = len(spark.read.text(path).inputFiles()), read_tasks(spark, path)
    assert files >= 180 and tasks == files // 8
    last = latest(commit_patches(spark, path, cap=50), ["log", "sha", "filename"], tasks)
    assert last.rdd.getNumPartitions() == tasks
    got = last.select("filename", "patch").collect()
    assert sorted(r.patch for r in got if r.filename == "x") == sorted(f"@@ {i}\n" for i in range(300, 900))
    assert [r.patch for r in got if r.filename == "big"] == [None] * 600


def test_shas_of_any_form_are_dealt_out_and_come_back(spark):
    odd = [A, A.upper(), "", "abc", "\x01" + "b" * 19, "b" * 39, "b" * 41, "b" * 40, "b" * 40 + "\n", "0é" * 20, None]
    found = [(s, "f", i, "old") for i, s in enumerate(odd)] + [(s, "f", 100 + i, "new") for i, s in enumerate(odd)]
    given = spark.createDataFrame(found, "sha string, filename string, at int, letter string")
    want = sorted(((s, "f", "new") for s in odd), key=repr)
    for by in (None, ["sha"]):
        last = latest(given, ["sha", "filename"], 5, by)
        assert sorted((tuple(r) for r in last.select("sha", "filename", "letter").collect()), key=repr) == want
        assert sorted((tuple(r) for r in last_statuses(given, ["sha", "filename"], 5, by).collect()), key=repr) == want
        assert plan_of(last).count("Exchange") == 1 and "unhex" in plan_of(last).split("Exchange")[1]


def test_tables_dealt_out_by_sha_are_joined_without_a_shuffle(spark):
    commits = spark.createDataFrame([(A, "Ann", "Bot", "m"), (B, "Bob", "Bob", "n"), (C, "Cy", "Cy", "o")], "sha string, author string, committer string, message string")
    files = spark.createDataFrame([(A, "f", 1, 2), (A, "g", 3, 0), (C, "f", 1, 1)], "sha string, filename string, additions long, deletions long")
    statuses = spark.createDataFrame([(A, "f", "added"), (C, "f", "removed")], "sha string, filename string, status string")
    patches = spark.createDataFrame([(A, "f", "@@"), (C, "f", "--")], "sha string, filename string, patch string")
    held = spark.createDataFrame([(A, 1), (A, 2), (B, 1), (A, 2)], "sha string, pr_id long")
    given = (commits, files, statuses, patches, held)
    tables = [stored_by(df.repartition(4, "sha"), f"t{i}", "sha", 4) for i, df in enumerate(given)]
    shown = ("sha", "pr_id", "filename", "status", "changes", "patch", "commit_stats_total", "message")
    with settings(spark, JOINED_AS_DEALT | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        built = build_details(*tables)
        assert "Exchange" not in plan_of(built) and "SortMergeJoin" in plan_of(built)
        assert rows(built, *shown) == rows(build_details(*given), *shown)
    assert rows(built, "sha", "pr_id", "filename") == [
        (A, 1, "f"), (A, 1, "g"), (A, 2, "f"), (A, 2, "g"), (B, 1, None), (C, None, "f")
    ]


def test_empty_git_files(spark, tmp_path):
    (tmp_path / "none").write_text("")
    path = str(tmp_path / "none")
    for read in (log_records, status_rows, diff_records, commit_patches):
        assert read(spark, path).collect() == []


def test_api_records(spark):
    pull = {"id": 1, "number": 2, "title": None, "user": {"login": "u", "id": 9}, "state": "closed", "created_at": "2025-01-01T00:00:00Z",
            "pull_request": {"merged_at": "2025-01-02T00:00:00Z"}, "html_url": "h"}
    plain = {**pull, "id": 3, "pull_request": None, "merged_at": "2025-01-03T00:00:00Z", "user": None}
    df = spark.createDataFrame([("o/r", json.dumps(p)) for p in (pull, plain)], "repo string, record string")
    ids = spark.createDataFrame([("o/r", 5)], "repo_name string, repo_id long")
    got = flatten_pulls(df, "record", "repo", ids).select("id", "user", "title", "repo_id", F.date_format("merged_at", "yyyy-MM-dd").alias("m"), "repo_url")
    assert rows(got) == [
        (1, "u", "", 5, "2025-01-02", "https://api.github.com/repos/o/r"), (3, "", "", 5, "2025-01-03", "https://api.github.com/repos/o/r")
    ]
    commit = {"sha": "s", "author": {"login": "ann"}, "committer": None, "commit": {"author": {"name": "Ann A"}, "committer": {"name": "Bob"}, "message": "m"},
              "stats": {"total": 3, "additions": 2, "deletions": 1}, "files": [{"filename": "f", "additions": 2, "deletions": 1}]}
    empty = {**commit, "sha": "t", "files": [], "author": {"login": ""}, "stats": None}
    df = spark.createDataFrame([(7, json.dumps(c)) for c in (commit, empty)], "pr_id long, record string")
    assert rows(flatten_commits(df, "record", "pr_id")) == [("s", 7, "ann", "Bob", "m"), ("t", 7, "Ann A", "Bob", "m")]
    assert rows(flatten_commit_files(df, "record"), "sha", "filename", "status", "changes", "commit_stats_total") == [
        ("s", "f", "modified", 3, 3), ("t", None, None, None, 0)
    ]


def test_schema_boundary(spark):
    loose = spark.createDataFrame([("x", "2025-01-01T00:00:00Z", "https://api.github.com/repos/o/r", 4), ("5", "soon", None, 5)],
                                  "id string, merged_at string, repo_url string, number long")
    assert rows(normalize_prs(loose), "id", "is_merged", "repo_name", "match_key", "source") == [
        (5, False, None, None, "human"), (None, True, "o/r", "o/r#4", "human")
    ]
    assert conform(loose, PULL_REQUESTS).schema == PULL_REQUESTS and conform(loose, COMMITS).columns == COMMITS.names


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "agent" if i < 3 else "human", i / 8, 'quo"te\nline') for i in range(60)], "id long, source string, x double, note string")
    write_parquet(df, f"{tmp_path}/t.parquet")
    assert load_table(spark, f"{tmp_path}/t.parquet", ["id", "x"]).columns == ["id", "x"]
    write_csv(df.drop("note"), f"{tmp_path}/t.csv", [F.desc("id")], {"x": 2})
    back = load_table(spark, f"{tmp_path}/t.csv")
    assert back.columns == ["id", "source", "x"] and [r.x for r in back.where("id = 5").collect()] == ["0.62"]
    with pytest.raises(ValueError):
        load_table(spark, f"{tmp_path}/t.json")
    write_by_source(df, f"{tmp_path}/split")
    agents = spark.read.parquet(f"{tmp_path}/split").where("source = 'agent'")
    assert agents.count() == 3 and "PartitionFilters: [isnotnull(source" in agents._jdf.queryExecution().executedPlan().toString()
    write_preview(df.drop("note"), f"{tmp_path}/preview", "id")
    assert spark.read.csv(f"{tmp_path}/preview", header=True).count() == 20
    for i in range(6):
        df.where(F.col("id") == i).select("id", *(["x"] if i else [])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/chunks")
    compact(spark, f"{tmp_path}/chunks", f"{tmp_path}/one", files=2)
    one = spark.read.parquet(f"{tmp_path}/one")
    assert one.count() == 6 and one.where("x IS NULL").count() == 1 and len(one.inputFiles()) == 2
    compact(spark, f"{tmp_path}/chunks", f"{tmp_path}/sized")
    assert len(spark.read.parquet(f"{tmp_path}/sized").inputFiles()) == 1
    pushed = only_values(spark.read.parquet(f"{tmp_path}/t.parquet"), "source", ("agent",)).select("id")
    plan = pushed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source)" in plan or "PushedFilters: [In(source" in plan or "EqualTo(source" in plan
    assert "note" not in plan.split("ReadSchema")[1]


def test_status_schema_and_report(spark, tmp_path):
    (tmp_path / "status.json").write_text(json.dumps({"errors": ["a/b"], "not_found": [], "done_repos": ["a/b", "c/d"], "total_prs": 3}, indent=1))
    assert rows(status_lists(spark, str(tmp_path / "status.json"))) == [("done_repos", "a/b"), ("done_repos", "c/d"), ("errors", "a/b")]
    a = spark.createDataFrame([], "id long, x string, helper int")
    b = spark.createDataFrame([], "id int, y double")
    assert rows(schema_diff(a, b, ["helper"])) == [("id", "bigint", "int", "shared"), ("x", "string", None, "only_a"), ("y", None, "double", "only_b")]
    table = spark.createDataFrame([("g", 1, 2.5)], "g string, n long, v double")
    parts = [report_rows("first", table, "g", ("n", "v")), report_rows("second", table, None, ("n",))]
    assert rows(report(parts)) == [("first", "n", "g", 1.0), ("first", "v", "g", 2.5), ("second", "n", "all", 1.0)]
    write_report(parts, f"{tmp_path}/report")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/report").collect())[0] == "first\tg\tn\t1.0"


def test_status_documents_may_drift_and_break(spark, tmp_path):
    documents = {
        "a": '{"errors": ["x/1", {"name": "x/2", "reason": "r"}],\n "done_repos": "x/3", "extra": {"deep": [1, 2]}}', "b": '{"errors": null}', "c": '{"errors": ["x',
        "d": "[1, 2]", "e": "", "f": '{"not_found": [7, null, "x/1"], "errors": []}',
    }
    for name, value in documents.items():
        (tmp_path / name).write_text(value)
    good, bad = status_documents(spark, str(tmp_path))
    assert rows(status_entries(good)) == [("done_repos", "x/3"), ("errors", "x/1"), ("errors", "x/2"), ("not_found", "7"), ("not_found", "x/1")]
    assert set("cd") <= {r.file[-1] for r in bad.collect()} <= set("cde")  # an empty file may have no row
    assert {r.file[-1] for r in good.collect()} == set("abf")


def test_streams_equal_batch_and_resume(spark, tmp_path):
    day = "concat('2025-01-', lpad(string(1 + id % 9), 2, '0'), ' 10:00:00')"
    df = spark.range(90).selectExpr("id % 60 AS key", f"timestamp({day}) AS ts", "id % 2 = 0 AS is_merged", "if(id % 3 = 0, 'a', 'b') AS g")
    source = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    monthly = keep_latest(monthly_update(stream, "ts", ["g"]), f"{tmp_path}/monthly")
    assert rows(monthly) == rows(df.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "g").agg(F.count("*").alias("total"), F.count_if("is_merged").alias("merged")))
    once = append_to(dedup_stream(stream, ["key"], "ts", "20 days"), f"{tmp_path}/dedup")
    assert once.count() == 60 and once.select("key").distinct().count() == 60
    counts = append_to(daily_counts(stream, "ts", ["g"], "1 hour"), f"{tmp_path}/daily")
    want = df.where("ts < timestamp'2025-01-09'").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "g").agg(F.count("*").alias("n"))
    assert rows(counts) == rows(want)
    plain = append_to(stream, f"{tmp_path}/copy")
    assert append_to(stream, f"{tmp_path}/copy").count() == plain.count() == 90
    df.limit(5).coalesce(1).write.mode("append").parquet(source)
    assert append_to(stream, f"{tmp_path}/copy").count() == 95
