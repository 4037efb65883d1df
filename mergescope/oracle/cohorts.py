"""SQL of the two-collection comparisons and matched cohorts."""

from mergescope.oracle.reports import AGENT_LIST
from mergescope.oracle.snippets import AGENTS, chi_p, rnd, stars, yates

FIVE = (*AGENTS, "OpenAI_Codex")


def keys_overlap(a: str, b: str, key: str, by: str = "", digits: int = 4) -> str:
    """Counts of distinct keys on either side, grouped when stated."""
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {head} count(*) FILTER (in_a) AS a_keys, count(*) FILTER (in_b) AS b_keys, count(*) FILTER (in_a AND in_b) AS overlap,
  count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_b AND NOT in_a) AS only_b, count(*) AS union_keys
FROM (SELECT {head} {key}, bool_or(a) AS in_a, bool_or(b) AS in_b
      FROM (SELECT {head} {key}, TRUE AS a, FALSE AS b FROM {a} UNION ALL SELECT {head} {key}, FALSE, TRUE FROM {b})
      GROUP BY {head} {key}) {group}"""


def covered(inner: str, head: str = "", digits: int = 4) -> str:
    return f"""SELECT {head} a_keys, b_keys, overlap, only_a, only_b, union_keys,
  {rnd('coalesce(overlap::DOUBLE / nullif(union_keys, 0), 0)', 4)} AS jaccard,
  {rnd('overlap::DOUBLE / nullif(a_keys, 0) * 100', digits)} AS pct_of_a, {rnd('overlap::DOUBLE / nullif(b_keys, 0) * 100', digits)} AS pct_of_b
FROM ({inner})"""


SCOPE = """
bounds AS (SELECT min(created_at) AS lo, max(created_at) AS hi FROM v_theirs),
sa AS (SELECT o.* FROM v_ours o, bounds WHERE agent <> 'human' AND created_at BETWEEN lo AND hi AND repo_name IN (SELECT repo_name FROM v_theirs)),
sb AS (SELECT * FROM v_theirs WHERE repo_name IN (SELECT repo_name FROM v_ours)),
ha AS (SELECT o.* FROM v_ours o, bounds WHERE agent = 'human' AND created_at BETWEEN lo AND hi AND repo_name IN (SELECT repo_name FROM v_theirs_human)),
hb AS (SELECT * FROM v_theirs_human WHERE repo_name IN (SELECT repo_name FROM v_ours WHERE agent = 'human'))"""

PAIRS = """
pairs AS (SELECT o.match_key, o.agent AS ours_agent, t.agent AS theirs_agent, o.state AS ours_state, t.state AS theirs_state,
            o.is_merged AS ours_merged, t.is_merged AS theirs_merged
          FROM v_ours o JOIN v_theirs t ON o.match_key = t.match_key)"""

OURS_MERGED = """
stack AS (SELECT match_key, 0 AS run, id, agent, month, repo_name FROM v_prev WHERE agent <> 'human'
          UNION ALL SELECT match_key, 1, id, agent, month, repo_name FROM v_new),
om AS (SELECT * FROM stack QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY run, id) = 1)"""

FIXES = """
tf AS (SELECT * FROM v_theirs_all WHERE task_type = 'fix' AND state = 'closed' AND agent IS DISTINCT FROM 'OpenAI_Codex'),
uf AS (SELECT * FROM v_ours WHERE agent <> 'human' AND type = 'fix' AND state = 'closed')"""

LATER = """
rest AS (SELECT * FROM uf WHERE created_at > (SELECT max(created_at) FROM tf) AND created_at <= TIMESTAMP '2001-02-28'),
same AS (SELECT * FROM uf WHERE match_key IN (SELECT match_key FROM tf)),
later AS (SELECT * FROM rest WHERE repo_name IN (SELECT repo_name FROM same)),
want AS (SELECT agent, count(*) AS target FROM same GROUP BY agent)"""

MATCHED = """
agents AS (SELECT id FROM v_fixes WHERE source = 'agent'),
humans AS (SELECT id FROM v_fixes WHERE source <> 'agent' QUALIFY row_number() OVER (ORDER BY md5(id || ':42')) <= (SELECT count(*) FROM agents)),
cohort AS (SELECT id FROM agents UNION ALL SELECT id FROM humans)"""

MONTHLY = f"""
{FIXES},
af AS (SELECT * FROM v_ours WHERE source = 'agent' AND type = 'fix' AND state = 'closed'),
keyed AS (SELECT * FROM af WHERE match_key IN (SELECT match_key FROM tf)),
ag AS (SELECT * FROM keyed UNION ALL SELECT * FROM af WHERE month NOT IN (SELECT month FROM keyed)),
want AS (SELECT month, count(*) AS target FROM ag GROUP BY month),
pool AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5(id || ':42')) AS k FROM v_ours
         WHERE source = 'human' AND type = 'fix' AND state = 'closed' AND repo_name IN (SELECT repo_name FROM ag)),
cohort AS (SELECT id FROM ag UNION ALL SELECT id FROM pool JOIN want USING (month) WHERE k <= target)"""


def cohort_report(views: str) -> str:
    return f"""
WITH {views},
t AS (SELECT * FROM v_closed WHERE id IN (SELECT id FROM cohort)),
r AS (SELECT 'All agents' AS category, * FROM t WHERE is_agent UNION ALL SELECT CASE WHEN is_agent THEN agent ELSE 'Human' END, * FROM t),
c AS (SELECT category, {rnd('count(*) FILTER (num_commits = 1)::DOUBLE / count(*) * 100', 4)} AS single_pct FROM r JOIN v_per_pr ON id = pr_id WHERE is_merged GROUP BY category)
SELECT r.category, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS rejected,
  {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} AS acceptance_rate, {rnd('median(hours_to_merge)', 4)} AS median_hours, first(single_pct) AS single_pct
FROM r LEFT JOIN c ON r.category = c.category GROUP BY r.category"""


def rate_row(label: str, source: str) -> str:
    return f"SELECT '{label}' AS cut, count(*) AS total, count(*) FILTER (is_merged) AS merged, {rnd('count(*) FILTER (is_merged)::DOUBLE / nullif(count(*), 0) * 100', 4)} AS rate FROM {source}"


def ladder_row(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS cohort, coalesce(agent, 'OVERALL') AS agent, count(*) AS total, count(*) FILTER (is_merged) AS merged,
  count(*) FILTER (NOT is_merged) AS rejected, {rnd('count(*) FILTER (is_merged)::DOUBLE / nullif(count(*), 0) * 100', 4)} AS acceptance_rate
FROM {source} GROUP BY ROLLUP (agent)"""


def column_counts(side: str, agents: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"count(*) FILTER ({side} AND agent = '{a}') AS \"{prefix}{a}\"" for a in agents)


REPO_TABLE = f"""
stacked AS (SELECT repo_name, match_key, agent, 'theirs' AS origin FROM v_theirs_all
            UNION ALL SELECT repo_name, match_key, agent, 'prev' FROM v_prev WHERE agent <> 'human'
            UNION ALL SELECT repo_name, match_key, agent, 'new' FROM v_new),
theirs AS (SELECT repo_name, count(DISTINCT match_key) AS their_prs,
             count(DISTINCT match_key) FILTER (agent IN ({AGENT_LIST})) AS their_target_prs,
             {', '.join(f'count(DISTINCT match_key) FILTER (agent = {chr(39)}{a}{chr(39)}) AS "their_{a}"' for a in FIVE)},
             count(DISTINCT match_key) FILTER (match_key IN (SELECT match_key FROM stacked WHERE origin <> 'theirs')) AS overlap_count
           FROM stacked WHERE origin = 'theirs' GROUP BY repo_name),
mine AS (SELECT repo_name, count(DISTINCT match_key) FILTER (origin = 'prev') AS p, count(DISTINCT match_key) FILTER (origin = 'new') AS n,
           count(DISTINCT match_key) AS d FROM stacked WHERE origin <> 'theirs' GROUP BY repo_name),
repos AS (SELECT t.*, coalesce(p, 0) AS prev_prs, coalesce(n, 0) AS new_prs, coalesce(d, 0) AS our_distinct_prs, coalesce(p, 0) + coalesce(n, 0) AS our_total
          FROM theirs t LEFT JOIN mine USING (repo_name)),
classed AS (SELECT *, CASE
    WHEN their_target_prs > 0 AND our_total >= their_target_prs THEN 'fully_collected'
    WHEN repo_name IN (SELECT repo_name FROM v_status WHERE list = 'errors') THEN 'error_accessing_repo'
    WHEN repo_name IN (SELECT repo_name FROM v_status WHERE list = 'not_found') THEN 'repo_not_found_or_deleted'
    WHEN their_target_prs = 0 THEN 'no_target_agent_prs (only OpenAI_Codex or other)'
    WHEN repo_name IN (SELECT repo_name FROM v_status WHERE list = 'done_repos') THEN
      CASE WHEN our_total > 0 THEN 'partially_collected' ELSE 'processed_but_no_matching_prs_found' END
    ELSE 'not_attempted (repo not in our collection scope)' END AS status FROM repos)"""

DUAL = """
bm AS (SELECT id FROM v_theirs_all WHERE (repo_id, number) IN (SELECT (repo_id, number) FROM v_ours)),
bs AS (SELECT pr_id AS id FROM v_commits WHERE pr_id IN (SELECT id FROM v_theirs_all)
         AND sha IN (SELECT sha FROM v_commits WHERE pr_id IN (SELECT id FROM v_ours))),
hits AS (SELECT id FROM bm UNION SELECT id FROM bs)"""

SQL = {
    "q21_dataset_overlap": f"""
WITH oa AS (SELECT * FROM v_ours WHERE agent <> 'human'), oh AS (SELECT * FROM v_ours WHERE agent = 'human')
{covered(keys_overlap('oa', 'v_theirs', 'match_key'), "'agent' AS scope,")}
UNION ALL {covered(keys_overlap('oh', 'v_theirs_human', 'match_key'), "'human' AS scope,")}""",
    "q21_repository_overlap": covered(keys_overlap("v_ours", "v_theirs", "repo_name")),
    "q22_overlap_by_agent": f"""
WITH s AS (SELECT 'ours' AS side, agent, match_key IN (SELECT match_key FROM v_theirs) AS hit FROM v_ours WHERE agent <> 'human'
           UNION ALL SELECT 'theirs', agent, match_key IN (SELECT match_key FROM v_ours) FROM v_theirs)
SELECT side, agent, count(*) AS total, count(*) FILTER (hit) AS in_other, count(*) FILTER (NOT hit) AS not_in_other,
  {rnd('count(*) FILTER (hit)::DOUBLE / count(*) * 100', 1)} AS overlap_pct FROM s GROUP BY side, agent""",
    "q22_overlap_by_repo": f"""
SELECT * EXCLUDE (jaccard, union_keys) FROM ({covered(keys_overlap('v_ours', 'v_theirs', 'match_key', 'repo_name'), 'repo_name,', 1)}) WHERE a_keys > 0 AND b_keys > 0""",
    "q22_repo_overlap_histogram": f"""
WITH r AS (SELECT pct_of_b AS x FROM ({covered(keys_overlap('v_ours', 'v_theirs', 'match_key', 'repo_name'), 'repo_name,', 1)}) WHERE a_keys > 0 AND b_keys > 0),
l AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 20.0::DOUBLE AS w FROM r),
b AS (SELECT CAST(least(floor((x - lo) / w), 19) AS INT) AS bin, lo, w FROM r, l)
SELECT bin, lo + bin * w AS bin_low, lo + (bin + 1) * w AS bin_high, count(*) AS "rows" FROM b GROUP BY bin, lo, w""",
    "q22_overlap_by_month": f"""
SELECT * EXCLUDE (jaccard, union_keys) FROM ({covered(keys_overlap('v_ours', 'v_theirs', 'match_key', 'month'), 'month,', 1)})""",
    "q22_missing_repositories": """
(SELECT 'theirs only' AS side, repo_name, count(DISTINCT match_key) AS n FROM v_theirs WHERE match_key NOT IN (SELECT match_key FROM v_ours)
 GROUP BY repo_name ORDER BY n DESC, repo_name LIMIT 20)
UNION ALL
(SELECT 'ours only', repo_name, count(DISTINCT match_key) AS n FROM v_ours WHERE match_key NOT IN (SELECT match_key FROM v_theirs)
 GROUP BY repo_name ORDER BY n DESC, repo_name LIMIT 20)""",
    "q22_exclusive_time_ranges": """
WITH s AS (SELECT 'ours' AS side, created_at, match_key IN (SELECT match_key FROM v_theirs) AS hit FROM v_ours
           UNION ALL SELECT 'theirs', created_at, match_key IN (SELECT match_key FROM v_ours) FROM v_theirs)
SELECT side, CASE WHEN hit THEN 'shared' ELSE 'exclusive' END AS part, strftime(min(created_at), '%Y-%m-%d') AS first_day,
  strftime(max(created_at), '%Y-%m-%d') AS last_day, count(*) AS "rows" FROM s GROUP BY side, hit""",
    "q23_agent_crosstab": f"""
WITH {PAIRS}
SELECT coalesce(ours_agent, 'Total') AS ours_agent, {', '.join(f'count(*) FILTER (theirs_agent = {chr(39)}{a}{chr(39)}) AS "{a}"' for a in AGENTS)}, count(*) FILTER (theirs_agent NOT IN ({', '.join(repr(a) for a in AGENTS)})) AS "Unlisted", count(*) AS "Total"
FROM pairs GROUP BY ROLLUP (ours_agent)""",
    "q23_state_crosstab": f"""
WITH {PAIRS}
SELECT coalesce(ours_state, 'Total') AS ours_state, count(*) FILTER (theirs_state = 'closed') AS closed, count(*) FILTER (theirs_state = 'open') AS open, count(*) FILTER (theirs_state NOT IN ('open', 'closed')) AS "Unlisted", count(*) AS "Total"
FROM pairs GROUP BY ROLLUP (ours_state)""",
    "q23_label_agreement": f"""
WITH {PAIRS}
SELECT count(*) AS pairs, count(*) FILTER (ours_agent = theirs_agent) AS agree, count(*) FILTER (ours_agent <> theirs_agent) AS disagree,
  {rnd('count(*) FILTER (ours_agent = theirs_agent)::DOUBLE / count(*) * 100', 4)} AS agree_pct FROM pairs""",
    "q23_merge_agreement": f"""
WITH {PAIRS}
SELECT count(*) AS pairs, count(*) FILTER (ours_merged = theirs_merged) AS agree, count(*) FILTER (ours_merged <> theirs_merged) AS disagree,
  count(*) FILTER (ours_merged AND NOT theirs_merged) AS only_left_true, count(*) FILTER (theirs_merged AND NOT ours_merged) AS only_right_true,
  {rnd('count(*) FILTER (ours_merged = theirs_merged)::DOUBLE / count(*) * 100', 4)} AS agree_pct FROM pairs""",
    "q24_coverage_by_agent": f"""
WITH {SCOPE},
c AS (SELECT agent, a_keys, b_keys, overlap FROM ({keys_overlap('sa', 'sb', 'match_key', 'agent')})
      UNION ALL SELECT 'TOTAL', a_keys, b_keys, overlap FROM ({keys_overlap('sa', 'sb', 'match_key')}))
SELECT agent, a_keys, b_keys, overlap, b_keys - overlap AS missed, {rnd('coalesce(overlap::DOUBLE / nullif(b_keys, 0), 0) * 100', 4)} AS coverage_pct FROM c""",
    "q24_coverage_summary": f"""
WITH {SCOPE},
c AS (SELECT 'Agent PRs' AS category, a_keys, b_keys, overlap FROM ({keys_overlap('sa', 'sb', 'match_key')})
      UNION ALL SELECT 'Human PRs', a_keys, b_keys, overlap FROM ({keys_overlap('ha', 'hb', 'match_key')})),
f AS (SELECT coalesce(category, 'TOTAL') AS category, CAST(sum(a_keys) AS BIGINT) AS a_keys, CAST(sum(b_keys) AS BIGINT) AS b_keys, CAST(sum(overlap) AS BIGINT) AS overlap FROM c GROUP BY ROLLUP (category))
SELECT category, a_keys, b_keys, overlap, {rnd('overlap::DOUBLE / nullif(b_keys, 0) * 100', 4)} AS a_covers_b, {rnd('overlap::DOUBLE / nullif(a_keys, 0) * 100', 4)} AS b_covers_a FROM f""",
    "q25_missed_and_extra": f"""
WITH {SCOPE}
SELECT 'missed' AS side, agent, count(*) AS n FROM sb WHERE match_key NOT IN (SELECT match_key FROM sa) GROUP BY agent
UNION ALL SELECT 'extra', agent, count(*) FROM sa WHERE match_key NOT IN (SELECT match_key FROM sb) GROUP BY agent""",
    "q25_missed_repositories": f"""
WITH {SCOPE},
m AS (SELECT DISTINCT repo_name FROM sb WHERE match_key NOT IN (SELECT match_key FROM sa))
SELECT count(*) FILTER (repo_name IN (SELECT repo_name FROM sa)) AS partly_missing,
  count(*) FILTER (repo_name NOT IN (SELECT repo_name FROM sa)) AS wholly_missing FROM m""",
    "q26_repo_coverage": f"""
WITH {REPO_TABLE}
SELECT *, {rnd('overlap_count::DOUBLE / their_prs * 100', 1)} AS overlap_pct, {rnd('our_total::DOUBLE / nullif(their_target_prs, 0) * 100', 1)} AS pct_of_target,
  {rnd('our_total::DOUBLE / their_prs * 100', 1)} AS pct_of_all FROM classed""",
    "f13_ordered_status": f"""
WITH {REPO_TABLE} SELECT repo_name, status FROM classed""",
    "j12_key_or_commit_match": f"""
WITH {DUAL} SELECT id FROM hits""",
    "e06_overlap_per_group": f"""
WITH oa AS (SELECT * FROM v_ours WHERE agent <> 'human')
{covered(keys_overlap('oa', 'v_theirs', 'match_key', 'agent'), 'agent,')}""",
    "q26_status_breakdown": f"""
WITH {REPO_TABLE}
SELECT status, count(*) AS repo_count, {rnd('count(*)::DOUBLE / (SELECT count(*) FROM classed) * 100', 2)} AS percentage FROM classed GROUP BY status""",
    "q27_monthly_coverage": f"""
WITH {OURS_MERGED},
t AS (SELECT *, repo_name IN (SELECT repo_name FROM v_status WHERE list <> 'done_repos') AS gone FROM v_theirs_all),
a AS (SELECT month, match_key, agent, gone, TRUE AS th FROM t UNION ALL SELECT month, match_key, agent, FALSE, FALSE FROM om),
tk AS (SELECT DISTINCT month, match_key FROM t), ok AS (SELECT DISTINCT month, match_key FROM om),
m AS (SELECT month, count(*) FILTER (th) AS their_prs, count(*) FILTER (th AND agent IN ({AGENT_LIST})) AS their_target_prs,
        count(*) FILTER (th AND agent NOT IN ({AGENT_LIST})) AS their_out_of_scope, count(*) FILTER (th AND gone) AS their_unreachable,
        count(*) FILTER (NOT th) AS our_prs, {column_counts('th', FIVE, 'their_')}, {column_counts('NOT th', AGENTS, 'our_')} FROM a GROUP BY month),
x AS (SELECT coalesce(tk.month, ok.month) AS month, count(*) FILTER (tk.match_key IS NOT NULL AND ok.match_key IS NOT NULL) AS overlap,
        count(*) FILTER (tk.match_key IS NULL) AS our_unique FROM tk FULL JOIN ok ON tk.month = ok.month AND tk.match_key = ok.match_key GROUP BY 1),
y AS (SELECT month, count(DISTINCT match_key) AS target_missed FROM t WHERE agent IN ({AGENT_LIST}) AND (month, match_key) NOT IN (SELECT (month, match_key) FROM ok) GROUP BY month),
f AS (SELECT m.*, overlap, our_unique, coalesce(target_missed, 0) AS target_missed FROM m JOIN x USING (month) LEFT JOIN y USING (month))
SELECT coalesce(month, 'TOTAL') AS month, {', '.join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in (
    'their_prs', 'their_target_prs', 'their_out_of_scope', 'their_unreachable', 'our_prs', 'overlap', 'our_unique', 'target_missed',
    *[f'their_{a}' for a in FIVE], *[f'our_{a}' for a in AGENTS]))} FROM f GROUP BY ROLLUP (month)""",
    "q27_merged_runs": f"""
WITH {OURS_MERGED} SELECT run, count(*) AS kept FROM om GROUP BY run""",
    "q28_agent_coverage": f"""
WITH {OURS_MERGED}
SELECT agent, count(*) AS total, count(*) FILTER (match_key IN (SELECT match_key FROM om)) AS overlap,
  {rnd('count(*) FILTER (match_key IN (SELECT match_key FROM om))::DOUBLE / count(*) * 100', 1)} AS overlap_pct FROM v_theirs_all GROUP BY agent""",
    "q29_dual_key_overlap": f"""
WITH {DUAL},
m AS (SELECT month, count(*) AS their_prs, count(*) FILTER (id IN (SELECT id FROM hits)) AS overlap FROM v_theirs_all GROUP BY month),
o AS (SELECT month, count(*) AS our_prs FROM v_ours GROUP BY month),
j AS (SELECT coalesce(m.month, o.month) AS month, coalesce(our_prs, 0) AS our_prs, coalesce(their_prs, 0) AS their_prs, coalesce(overlap, 0) AS overlap FROM m FULL JOIN o ON m.month = o.month),
f AS (SELECT coalesce(month, 'TOTAL') AS month, CAST(sum(our_prs) AS BIGINT) AS our_prs, CAST(sum(their_prs) AS BIGINT) AS their_prs, CAST(sum(overlap) AS BIGINT) AS overlap FROM j GROUP BY ROLLUP (month))
SELECT *, {rnd('coalesce(overlap::DOUBLE / nullif(their_prs, 0), 0) * 100', 1)} AS overlap_pct FROM f""",
    "q29_dual_key_deep_dive": f"""
WITH {DUAL},
s AS (SELECT repo_id, count(*) AS their_total, count(*) FILTER (id IN (SELECT id FROM hits)) AS overlap_count FROM v_theirs_all WHERE month = '1997-07' GROUP BY repo_id),
n AS (SELECT s.*, coalesce(full_name, 'Unknown') AS name FROM s LEFT JOIN v_repos r ON s.repo_id = r.repo_id)
SELECT repo_id, their_total, overlap_count, CASE WHEN length(name) > 30 THEN substr(name, 1, 27) || '...' ELSE name END AS repo_name,
  {rnd('overlap_count::DOUBLE / their_total * 100', 1)} AS overlap_pct FROM n""",
    "q29_shared_commit_pairs": """
SELECT DISTINCT sha, pr_id FROM v_commits WHERE pr_id IN (SELECT id FROM v_theirs_all WHERE month = '1997-07')
  AND sha IN (SELECT sha FROM v_commits WHERE pr_id IN (SELECT id FROM v_ours))""",
    "q30_gap_agent_mix": f"""
WITH {FIXES},
t AS (SELECT agent, {rnd('count(*)::DOUBLE / (SELECT count(*) FROM tf) * 100', 1)} AS their_pct, {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 1)} AS their_rate FROM tf GROUP BY agent),
u AS (SELECT agent, {rnd('count(*)::DOUBLE / (SELECT count(*) FROM uf) * 100', 1)} AS our_pct, {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 1)} AS our_rate FROM uf GROUP BY agent)
SELECT coalesce(t.agent, u.agent) AS agent, coalesce(their_pct, 0) AS their_pct, coalesce(their_rate, 0) AS their_rate, coalesce(our_pct, 0) AS our_pct, coalesce(our_rate, 0) AS our_rate
FROM t FULL JOIN u ON t.agent = u.agent""",
    "q30_gap_cuts": f"""
WITH {FIXES}
{rate_row('their all', 'tf')} UNION ALL {rate_row('our all', 'uf')}
UNION ALL {rate_row('our within their range', '(SELECT * FROM uf WHERE created_at BETWEEN (SELECT min(created_at) FROM tf) AND (SELECT max(created_at) FROM tf))')}
UNION ALL {rate_row('our beyond their range', '(SELECT * FROM uf WHERE created_at > (SELECT max(created_at) FROM tf))')}
UNION ALL {rate_row('their shared repos', '(SELECT * FROM tf WHERE repo_name IN (SELECT repo_name FROM uf))')}
UNION ALL {rate_row('our shared repos', '(SELECT * FROM uf WHERE repo_name IN (SELECT repo_name FROM tf))')}
UNION ALL {rate_row('their same keys', '(SELECT * FROM tf WHERE match_key IN (SELECT match_key FROM uf))')}
UNION ALL {rate_row('our same keys', '(SELECT * FROM uf WHERE match_key IN (SELECT match_key FROM tf))')}
UNION ALL {rate_row('our other keys', '(SELECT * FROM uf WHERE match_key NOT IN (SELECT match_key FROM tf))')}""",
    "q30_gap_exclusive_agents": f"""
WITH {FIXES}
SELECT agent, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS rejected,
  {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} AS acceptance_rate FROM uf WHERE match_key NOT IN (SELECT match_key FROM tf) GROUP BY agent""",
    "q30_gap_disagreement": f"""
WITH {FIXES},
p AS (SELECT tf.is_merged AS t, uf.is_merged AS u FROM tf JOIN uf ON tf.match_key = uf.match_key)
SELECT count(*) AS pairs, count(*) FILTER (t = u) AS agree, count(*) FILTER (t <> u) AS disagree, count(*) FILTER (t AND NOT u) AS only_left_true,
  count(*) FILTER (u AND NOT t) AS only_right_true, {rnd('count(*) FILTER (t = u)::DOUBLE / count(*) * 100', 4)} AS agree_pct FROM p""",
    "q30_column_values": """
SELECT 'type' AS "column", type AS value, count(*) AS n FROM v_prs GROUP BY type UNION ALL SELECT 'source', source, count(*) FROM v_prs GROUP BY source
UNION ALL SELECT 'agent', agent, count(*) FROM v_prs GROUP BY agent UNION ALL SELECT 'state', state, count(*) FROM v_prs GROUP BY state""",
    "q31_repository_export": r"""
WITH p AS (SELECT repo_id, count(*) AS pr_count, arg_min(repo_url, id) AS repo_url, arg_min(html_url, id) AS html_url FROM v_theirs_all GROUP BY repo_id)
SELECT p.repo_id, CASE WHEN full_name IS NOT NULL AND full_name <> 'Unknown' THEN full_name ELSE regexp_extract(html_url, 'github\.com/([^/]+/[^/]+)', 1) END AS repository,
  pr_count, r.repo_id IS NOT NULL AS in_metadata, language, license, stars, forks, repo_url, regexp_extract(html_url, 'https?://github\.com/[^/]+/[^/]+') || '/' AS html_url
FROM p LEFT JOIN v_repos r ON p.repo_id = r.repo_id""",
    "q31_repository_export_stats": f"""
WITH p AS (SELECT DISTINCT repo_id FROM v_theirs_all)
SELECT (SELECT count(*) FROM v_repos) AS in_metadata, count(*) AS with_prs, count(*) FILTER (repo_id IN (SELECT repo_id FROM v_repos)) AS overlap,
  count(*) FILTER (repo_id NOT IN (SELECT repo_id FROM v_repos)) AS missing,
  {rnd('count(*) FILTER (repo_id IN (SELECT repo_id FROM v_repos))::DOUBLE / count(*) * 100', 4)} AS coverage_pct,
  count(*) FILTER (repo_id NOT IN (SELECT repo_id FROM v_repos)) AS recovered FROM p""",
    "q32_matched_report": cohort_report(MATCHED),
    "q32_matched_tests": f"""
WITH {MATCHED},
t AS (SELECT *, source = 'agent' AS is_first FROM v_closed WHERE id IN (SELECT id FROM cohort)),
c AS (SELECT count(*) FILTER (is_first AND is_merged) AS a, count(*) FILTER (is_first) AS na, count(*) FILTER (NOT is_first AND is_merged) AS b, count(*) FILTER (NOT is_first) AS nb FROM t),
g AS (SELECT hours_open AS t, count(*) FILTER (is_first) AS n1, count(*) FILTER (NOT is_first) AS n2, count(*) FILTER (is_first AND is_merged) AS d1,
        count(*) FILTER (is_merged) AS d FROM t GROUP BY hours_open),
k AS (SELECT *, sum(n1) OVER (ORDER BY t DESC)::DOUBLE AS r1, sum(n2) OVER (ORDER BY t DESC)::DOUBLE AS r2 FROM g),
s AS (SELECT pow(sum(d1) - sum(d * r1 / (r1 + r2)), 2) / sum(CASE WHEN r1 + r2 > 1 THEN d * (r1 / (r1 + r2)) * (r2 / (r1 + r2)) * (r1 + r2 - d) / (r1 + r2 - 1) ELSE 0 END) AS x FROM k),
u AS (SELECT 'acceptance' AS test, {yates('a', 'na', 'b', 'nb')} AS x FROM c UNION ALL SELECT 'merge time', x FROM s),
v AS (SELECT *, {chi_p('x')} AS pv FROM u)
SELECT test, {rnd('x', 4)} AS chi2, {rnd('pv', 6)} AS p, {stars('pv')} AS sig FROM v""",
    "q32_month_matched_report": cohort_report(MONTHLY),
    "q32_month_matched_shortfall": f"""
WITH {MONTHLY},
h AS (SELECT month, count(*) AS available FROM pool GROUP BY month)
SELECT month, target, coalesce(available, 0) AS available, greatest(target - coalesce(available, 0), 0) AS shortfall FROM want LEFT JOIN h USING (month)""",
    "q33_cohort_ladder": f"""
WITH {FIXES}, {LATER},
numbered AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY md5(id || ':42')) AS k FROM later),
mix AS (SELECT numbered.* FROM numbered JOIN want USING (agent) WHERE k <= target)
{ladder_row('matched keys', 'same')}
UNION ALL {ladder_row('period in their repos', '(SELECT * FROM uf WHERE repo_name IN (SELECT repo_name FROM tf) AND created_at BETWEEN (SELECT min(created_at) FROM tf) AND (SELECT max(created_at) FROM tf))')}
UNION ALL {ladder_row('rest in their repos', '(SELECT * FROM rest WHERE repo_name IN (SELECT repo_name FROM tf))')}
UNION ALL {ladder_row('rest in matched repos', 'later')}
UNION ALL {ladder_row('rest with matched mix', 'mix')}""",
    "q33_stratified_shortfall": f"""
WITH {FIXES}, {LATER},
h AS (SELECT agent, count(*) AS available FROM later GROUP BY agent)
SELECT agent, target, coalesce(available, 0) AS available, greatest(target - coalesce(available, 0), 0) AS shortfall FROM want LEFT JOIN h USING (agent)""",
    "q34_own_vs_external": f"""
WITH s AS (SELECT agent, is_merged, TRUE AS th FROM v_theirs_all WHERE type = 'fix' AND state = 'closed' AND agent IN ({AGENT_LIST})
           UNION ALL SELECT agent, is_merged, FALSE FROM v_ours WHERE type = 'fix' AND state = 'closed' AND agent IN ({AGENT_LIST})),
c AS (SELECT coalesce(agent, 'ALL AGENTS') AS agent, count(*) FILTER (th) AS their_total, count(*) FILTER (th AND is_merged) AS their_merged,
        count(*) FILTER (NOT th) AS our_total, count(*) FILTER (NOT th AND is_merged) AS our_merged FROM s GROUP BY ROLLUP (agent)),
r AS (SELECT *, coalesce(their_merged::DOUBLE / nullif(their_total, 0), 0) * 100 AS x, coalesce(our_merged::DOUBLE / nullif(our_total, 0), 0) * 100 AS y FROM c)
SELECT agent, their_total, their_merged, our_total, our_merged, {rnd('x', 4)} AS their_rate, {rnd('y', 4)} AS our_rate, {rnd('y - x', 4)} AS diff_pp FROM r""",
    "q34_id_overlap_rates": f"""
WITH t AS (SELECT id, is_merged FROM v_theirs_all WHERE type = 'fix' AND state = 'closed' AND agent <> 'OpenAI_Codex'),
u AS (SELECT id, is_merged FROM v_ours WHERE agent <> 'human' AND type = 'fix' AND state = 'closed')
SELECT (SELECT count(DISTINCT id) FROM t) AS their_ids, (SELECT count(DISTINCT id) FROM u) AS our_ids,
  (SELECT count(*) FROM t WHERE id IN (SELECT id FROM u)) AS overlap, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM u)) AS only_their,
  (SELECT count(*) FROM u WHERE id NOT IN (SELECT id FROM t)) AS only_our,
  (SELECT {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} FROM t WHERE id IN (SELECT id FROM u)) AS their_rate,
  (SELECT {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} FROM u WHERE id IN (SELECT id FROM t)) AS our_rate""",
    "q35_missing_work_list": f"""
SELECT repo_name, count(*) AS expected FROM v_theirs_all WHERE agent IN ({AGENT_LIST}) AND repo_name NOT IN (SELECT repo_name FROM v_prev WHERE is_agent)
GROUP BY repo_name""",
    "q36_one_month_validation": f"""
WITH m AS (SELECT * FROM v_ours WHERE month = '1996-01'),
o AS (SELECT DISTINCT repo_id FROM m WHERE is_agent), t AS (SELECT DISTINCT repo_id FROM v_theirs_all)
SELECT (SELECT count(*) FROM m) AS total_prs, (SELECT count(*) FROM m WHERE is_agent) AS agent_prs, (SELECT count(*) FROM o) AS our_repos,
  (SELECT count(*) FROM t) AS their_repos, (SELECT count(*) FROM o WHERE repo_id IN (SELECT repo_id FROM t)) AS overlap,
  {rnd('(SELECT count(*) FROM o WHERE repo_id IN (SELECT repo_id FROM t))::DOUBLE / (SELECT count(*) FROM t) * 100', 4)} AS coverage_pct""",
}
