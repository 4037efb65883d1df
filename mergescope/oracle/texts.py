"""SQL of the labelling, parsing and text queries."""

SPACE = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EDGE, TAIL = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
FIX_WORDS = "|".join((
    "fix(es|ed|ing)?", rf"bug[{SPACE}]*fix", "hotfix", "bug", "patch", "resolv(e[ds]?|ing)", "error", "crash(es|ed|ing)?", "defect",
    "regression", "broken",
))
FIX = rf"(?i)^fix(\([^)]*\))?!?[{SPACE}:!/]|{EDGE}({FIX_WORDS}){TAIL}"
HEAD = r"regexp_extract({0}, '^[^\n-\r\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]*')"
KINDS = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore", "other", "revert")


def words(text: str) -> str:
    return f"len(regexp_extract_all(coalesce({text}, ''), '[^{SPACE}]+'))"


def label(head: str) -> str:
    arms = " ".join(rf"WHEN regexp_matches({head}, '(?i)^{k}(\([^)]*\))?!?([^\p{{L}}\p{{N}}_]|$)') THEN '{k}'" for k in KINDS)
    return f"CASE {arms} END"


SHA = "sha1(l_partkey || '-' || l_suppkey)"

RESPONSES = """
b AS (SELECT event_id, value, event_type, user_id, CASE event_type WHEN 'click' THEN 'fix' WHEN 'view' THEN 'docs' WHEN 'signup' THEN 'feature' ELSE 'chore' END AS label,
        CAST(floor(value) AS INT) AS confidence,
        CASE event_type WHEN 'error' THEN 'No reason provided.' ELSE 'because ' || user_id END AS reason,
        '{"output": "' || CASE event_type WHEN 'click' THEN 'Fix' WHEN 'view' THEN 'docs ' WHEN 'signup' THEN 'feature' ELSE 'chore' END || '", "confidence": '
          || CASE event_type WHEN 'view' THEN '"' || CAST(floor(value) AS BIGINT) || '"' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
          || CASE event_type WHEN 'error' THEN '' ELSE ', "reason": " because ' || user_id || ' "' END || '}' AS body FROM events),
r AS (SELECT *, CASE WHEN value > 60 THEN 'no answer given' WHEN value > 40 THEN 'Sure:' || chr(10) || body || chr(10) || 'Done.'
                     WHEN value > 30 THEN '[' || body || ']' WHEN value > 8 AND value < 9 THEN substr(body, 1, 20) ELSE body END AS raw,
        CASE WHEN value > 60 OR (value > 8 AND value < 9) THEN 'no object' WHEN label = 'feature' THEN 'label'
             WHEN confidence NOT BETWEEN 1 AND 10 THEN 'confidence range' END AS problem FROM b)"""

GIT = f"""
g AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey % 10 AS INT) ELSE 10 END AS log, {SHA} AS sha, 'src/' || l_linenumber || '.py' AS file,
        CAST(l_quantity AS BIGINT) AS add, CAST(round(l_discount * 100) AS BIGINT) AS del,
        row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS pos FROM lineitem),
one AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY log, sha ORDER BY pos DESC) = 1),
h AS (SELECT *, last_value(CASE WHEN l_tax > 0 THEN sha END IGNORE NULLS) OVER (PARTITION BY log ORDER BY pos) AS owner FROM g),
lines AS (SELECT log, owner, file AS filename, CASE WHEN l_tax > 0 THEN l_returnflag ELSE 'D' END AS letter, 2 * pos + CASE WHEN l_tax > 0 THEN 0 ELSE 1 END AS place FROM h
          UNION ALL SELECT log, owner, CASE WHEN l_tax > 0 THEN 'logo.png' ELSE 'extra.txt' END, CASE WHEN l_tax > 0 THEN 'M100' ELSE 'T' END,
            2 * pos + CASE WHEN l_tax > 0 THEN 1 ELSE 0 END FROM h),
words AS (SELECT log, owner AS sha, filename, CASE letter WHEN 'A' THEN 'added' WHEN 'R' THEN 'renamed' WHEN 'D' THEN 'removed' WHEN 'T' THEN 'changed' WHEN 'M100' THEN 'modified'
            ELSE letter END AS status FROM lines WHERE owner IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log, owner, filename ORDER BY place DESC) = 1)"""

SQL = {
    "c1_classified_summary": """
SELECT source, count(*) FILTER (type = 'fix') AS fix, count(*) FILTER (type = 'other') AS other FROM v_prs GROUP BY source""",
    "c1_classified_documents": f"""
SELECT lang, CASE WHEN regexp_matches(coalesce(text, ''), '{FIX}') THEN 'fix' ELSE 'other' END AS whole,
  CASE WHEN regexp_matches(coalesce({HEAD.format('text')}, ''), '{FIX}') THEN 'fix' ELSE 'other' END AS head, count(*) AS n FROM documents GROUP BY ALL""",
    "c1_fix_commit_rows": """
WITH f AS (SELECT id FROM v_prs WHERE type = 'fix')
SELECT (SELECT count(*) FROM f) AS prs, (SELECT count(*) FROM v_commits WHERE pr_id IN (SELECT id FROM f)) AS commits,
  (SELECT count(*) FROM v_details WHERE pr_id IN (SELECT id FROM f)) AS details""",
    "c2_conventional_labels": f"""
WITH l AS (SELECT {label('title')} AS label FROM v_prs)
SELECT label, CASE WHEN label IS NOT NULL THEN 10 END AS confidence, CASE WHEN label IS NOT NULL THEN 'title provides conventional commit label' END AS reason,
  count(*) AS n FROM l GROUP BY label""",
    "c2_title_shapes": f"""
WITH t AS (SELECT ['feat!', 'feature', 'FIX(api)', 'docs(readme)!', 'ci/cd', 'Chore', 'revert:', 'testing', 'style', 'perf_x', 'other', 'build(', 'refactor)', 'test'][CAST(l_linenumber + CASE l_linestatus WHEN 'O' THEN 7 ELSE 0 END AS INT)]
             || ' ' || l_returnflag AS head FROM lineitem)
SELECT head, {label('head')} AS label, count(*) AS n FROM t GROUP BY ALL""",
    "c3_incremental_labels": f"""
WITH l AS (SELECT agent, {label("coalesce(title, '')")} AS label FROM v_prs WHERE id NOT IN (SELECT id FROM v_theirs_all))
SELECT agent, count(label) AS labelled, count(DISTINCT label) AS labels, count(*) FILTER (label IS NULL) AS queued FROM l GROUP BY agent""",
    "c4_response_outcomes": f"""
WITH {RESPONSES} SELECT problem, count(*) AS n FROM r GROUP BY problem""",
    "c4_valid_responses": f"""
WITH {RESPONSES} SELECT event_id, label, confidence, reason FROM r WHERE problem IS NULL""",
    "c4_quarantined_responses": f"""
WITH {RESPONSES} SELECT event_id, raw, problem FROM r WHERE problem IS NOT NULL""",
    "c5_attributed_authors": """
WITH u AS (SELECT "user", arg_max(agent, id) AS agent FROM v_theirs_all GROUP BY "user")
SELECT u.agent IS NOT NULL AS is_agent, coalesce(u.agent, 'human') AS agent, count(*) AS n FROM v_prs p LEFT JOIN u ON p."user" = u."user" GROUP BY ALL""",
    "s6_flattened_pulls": """
SELECT state, strftime(created_at, '%Y') AS year, count(*) AS n, count(*) FILTER (is_merged) AS merged, CAST(sum(user_id) AS BIGINT) AS user_ids,
  count(*) AS empty_bodies, count(repo_id) AS with_repo_id, max(repo_url) AS last_repo_url FROM v_prs GROUP BY ALL""",
    "s6_flattened_commits": f"""
SELECT CASE WHEN l_returnflag <> 'N' THEN 'dev-' ELSE 'Name ' END || l_suppkey AS author, '' AS committer, 'msg' AS message, count(*) AS n, min({SHA}) AS first_sha
FROM lineitem GROUP BY ALL""",
    "s6_flattened_commit_files": """
SELECT CASE WHEN l_tax > 0 THEN 'f' || l_linenumber END AS filename, CASE WHEN l_tax > 0 THEN CASE l_linestatus WHEN 'O' THEN 'added' ELSE 'modified' END END AS status,
  sum(CASE WHEN l_tax > 0 THEN 2 ELSE 1 END)::BIGINT AS n, CAST(sum(CASE WHEN l_tax > 0 THEN 2 * l_quantity END) AS BIGINT) AS changes,
  CAST(sum(CASE WHEN l_tax > 0 THEN 0 END) AS BIGINT) AS deletions, CAST(sum(CASE WHEN l_tax > 0 THEN 2 ELSE 1 END * l_quantity) AS BIGINT) AS totals,
  CAST(sum(CASE WHEN l_tax > 0 THEN 2 ELSE 0 END) AS BIGINT) AS patches FROM lineitem GROUP BY 1, 2""",
    "text_page_addresses": r"""
WITH s AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS shape, url FROM pages),
a AS (SELECT page_id, CAST(shape AS INT) AS shape, CASE shape WHEN 0 THEN 'https://api.github.com/repos/own/r' || page_id WHEN 1 THEN 'https://github.com/own/r' || page_id || '/pull/7'
        WHEN 2 THEN 'http://github.com/own/r' || page_id || '/' WHEN 3 THEN url END AS address FROM s)
SELECT page_id, shape, CASE WHEN shape < 3 THEN 'own/r' || page_id END AS repo,
  CASE shape WHEN 1 THEN 'https://github.com/own/r' || page_id || '/' WHEN 2 THEN 'http://github.com/own/r' || page_id || '/' ELSE address END AS canonical FROM a""",
    "text_functions": f"""
SELECT doc_id, CAST({words('text')} AS INT) AS words, md5({HEAD.format('text')}) AS head_hash,
  CAST(length(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS INT) AS stripped,
  CASE WHEN length(text) > 30 THEN substr(replace(text, chr(10), ' '), 1, 27) || '...' ELSE replace(text, chr(10), ' ') END AS short,
  CAST(CASE WHEN strlen(text) <= 2000 THEN strlen(text) END AS INT) AS capped_bytes FROM documents""",
    "text_turn_lengths": f"""
SELECT role, count(*) AS turns, CAST(sum({words('text')}) AS BIGINT) AS words, count(*) FILTER (regexp_matches(text, '{FIX}')) AS fixes
FROM conversations GROUP BY role""",
    "p5_sha_work_list": """
WITH f AS (SELECT c.sha, p.repo_name, row_number() OVER (PARTITION BY c.sha ORDER BY l_linenumber, l_partkey, l_suppkey, pr_id) AS k
           FROM v_commits c JOIN v_prs p ON c.pr_id = p.id)
SELECT repo_name, sha, CAST(floor((row_number() OVER (PARTITION BY repo_name ORDER BY md5(sha), sha) - 1) / 50) AS BIGINT) AS batch FROM f WHERE k = 1""",
    "p1_numstat_totals": f"""
WITH {GIT}
SELECT file AS filename, count(*) AS n, CAST(sum(add) AS BIGINT) AS additions, CAST(sum(del) AS BIGINT) AS deletions FROM one WHERE l_tax > 0 GROUP BY file
UNION ALL SELECT 'logo.png', count(*), 0, 0 FROM one WHERE l_tax > 0""",
    "p1_log_headers": f"""
WITH {GIT}
SELECT 'Name ' || l_suppkey AS author, 'Bot' AS committer, 'Fix line' || chr(10) || chr(10) || 'body of ' || file AS message, count(*) AS n FROM one GROUP BY ALL""",
    "p2_status_words": f"""
WITH {GIT}
SELECT log, filename, status, count(*) AS n FROM words GROUP BY ALL""",
    "p3_patch_sizes": f"""
WITH {GIT},
p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY log, sha, file ORDER BY pos DESC) = 1)
SELECT file AS filename, count(*) AS n, count(*) FILTER (add + 17 <= 50) AS kept, CAST(sum(add + 17) FILTER (add + 17 <= 50) AS BIGINT) AS bytes FROM p GROUP BY file
UNION ALL SELECT 'logo.png', count(*), count(*), count(*) * 20 FROM one""",
    "p3_whole_patch_sizes": f"""
WITH {GIT}
SELECT log, file AS filename, count(*) AS n, CAST(sum(add + 17) AS BIGINT) AS bytes FROM g GROUP BY log, file
UNION ALL SELECT log, 'logo.png', count(*), count(*) * 20 FROM g GROUP BY log""",
    "p4_commit_details": f"""
WITH {GIT},
held AS (SELECT DISTINCT sha, l_orderkey AS pr_id FROM g),
files AS (SELECT sha, file AS filename, add + del AS changes, add + del AS total, add + 17 AS bytes, file AS said FROM one WHERE l_tax > 0
          UNION ALL SELECT sha, 'logo.png', 0, add + del, 20, file FROM one WHERE l_tax > 0
          UNION ALL SELECT sha, NULL, NULL, 0, NULL, file FROM one WHERE l_tax <= 0)
SELECT f.filename, CASE WHEN f.filename IS NOT NULL THEN coalesce(w.status, 'modified') END AS status, count(*) AS n, count(DISTINCT pr_id) AS prs,
  CAST(sum(changes) AS BIGINT) AS changes, CAST(sum(total) AS BIGINT) AS commit_total, CAST(sum(bytes) AS BIGINT) AS patch_bytes,
  CAST(sum(18 + length(said)) AS BIGINT) AS message_length
FROM files f JOIN held USING (sha) LEFT JOIN words w ON f.sha = w.sha AND f.filename = w.filename GROUP BY ALL""",
}
