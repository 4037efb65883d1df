"""SQL of the acceptance, timing, size, revision and trend reports."""

from mergescope.oracle.snippets import AGENTS, GROUPS, chi_p, rnd, stars, u_test, wide, yates

AGENT_LIST = ", ".join(f"'{a}'" for a in AGENTS)

EFFORT_MEDIANS = """
SELECT source, median(rev_files)::DOUBLE AS rev_files, median(rev_lines_added)::DOUBLE AS rev_lines_added,
  median(rev_lines_deleted)::DOUBLE AS rev_lines_deleted"""

MERGED_COUNTS = "SELECT f.*, c.num_commits FROM v_fixes f JOIN v_per_pr c ON f.id = c.pr_id WHERE f.is_merged"

LOG_RANK = """
events AS (SELECT hours_open AS t, source = 'agent' AS is_first, is_merged AS died FROM v_timed WHERE hours_open IS NOT NULL),
grouped AS (SELECT t, count(*) FILTER (is_first) AS n1, count(*) FILTER (NOT is_first) AS n2,
              count(*) FILTER (is_first AND died) AS d1, count(*) FILTER (died) AS d FROM events GROUP BY t),
risk AS (SELECT *, sum(n1) OVER (ORDER BY t DESC)::DOUBLE AS r1, sum(n2) OVER (ORDER BY t DESC)::DOUBLE AS r2 FROM grouped)"""


def gated_median(source: str, column: str, digits: int, groups: tuple[str, ...]) -> str:
    return f"""
WITH m AS (SELECT month, grp, CASE WHEN count(*) >= 5 THEN {rnd(f'median({column})', digits)} END AS v
           FROM ({source}) WHERE grp IS NOT NULL GROUP BY month, grp)
SELECT month, {wide(groups, 'grp', 'v')} FROM m GROUP BY month"""


SQL = {
    "q01_dataset_overview": """
WITH f AS (SELECT * FROM v_prs WHERE type = 'fix')
SELECT strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day,
  count(*) AS total_prs, count(*) FILTER (is_agent) AS agent_prs, count(*) FILTER (NOT is_agent) AS human_prs,
  count(DISTINCT repo_name) AS repositories,
  (SELECT count(*) FROM v_commits WHERE pr_id IN (SELECT id FROM f)) AS commits,
  (SELECT count(DISTINCT author) FROM v_commits WHERE pr_id IN (SELECT id FROM f)) AS committers
FROM f""",
    "q01_overview_agents": """
SELECT agent, count(*) AS n FROM v_prs WHERE type = 'fix' AND is_agent GROUP BY agent""",
    "q02_acceptance_by_agent": f"""
WITH g AS (SELECT coalesce(agent, 'Overall') AS agent, count(*) AS total, count(*) FILTER (is_merged) AS merged
           FROM v_fixes WHERE is_agent GROUP BY ROLLUP (agent))
SELECT agent, total, merged, total - merged AS rejected, {rnd('merged * 100.0 / total', 4)} AS acceptance_rate FROM g""",
    "q02_acceptance_all_agents": f"""
WITH g AS (SELECT coalesce(agent, 'TOTAL') AS agent, count(*) AS total, count(*) FILTER (is_merged) AS merged
           FROM v_prs WHERE type = 'fix' AND state = 'closed' AND is_agent GROUP BY ROLLUP (agent))
SELECT agent, total, merged, total - merged AS rejected, {rnd('merged * 100.0 / total', 4)} AS acceptance_rate,
  {rnd('100.0::DOUBLE - merged * 100.0::DOUBLE / total', 4)} AS rejection_rate FROM g""",
    "q03_acceptance_time_table": f"""
WITH r AS (SELECT 'All agents' AS category, * FROM v_timed WHERE is_agent
           UNION ALL SELECT CASE WHEN is_agent THEN agent ELSE 'Human' END, * FROM v_timed)
SELECT category, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS rejected,
  {rnd('count(*) FILTER (is_merged) * 100.0 / count(*)', 4)} AS acceptance_rate, {rnd('median(hours_to_merge)', 4)} AS median_hours
FROM r GROUP BY category""",
    "q04_agent_vs_human_chi_square": f"""
WITH c AS (SELECT count(*) FILTER (is_agent AND is_merged) AS hit_a, count(*) FILTER (is_agent) AS total_a,
             count(*) FILTER (NOT is_agent AND is_merged) AS hit_b, count(*) FILTER (NOT is_agent) AS total_b FROM v_fixes),
t AS (SELECT *, {yates('hit_a', 'total_a', 'hit_b', 'total_b')} AS x FROM c),
p AS (SELECT *, {chi_p('x')} AS pv FROM t)
SELECT hit_a, total_a, hit_b, total_b, {rnd('hit_a * 100.0 / total_a', 4)} AS rate_a, {rnd('hit_b * 100.0 / total_b', 4)} AS rate_b,
  {rnd('x', 4)} AS chi2, {rnd('pv', 6)} AS p, {stars('pv')} AS sig FROM p""",
    "q05_time_to_merge_boxes": f"""
WITH m AS (SELECT grp, hours_to_merge AS h FROM v_timed WHERE is_merged AND grp IS NOT NULL),
q AS (SELECT grp, median(h) AS med, quantile_cont(h, 0.95) AS p95 FROM m GROUP BY grp),
k AS (SELECT m.grp, least(h, p95) AS c FROM m JOIN q ON m.grp = q.grp),
b AS (SELECT grp, quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.75) AS q3 FROM k GROUP BY grp)
SELECT k.grp AS "group", {rnd('first(med)', 4)} AS median_hours, {rnd('first(p95)', 4)} AS p95_hours, count(*) AS n,
  {rnd('first(q1)', 4)} AS q1, {rnd('first(q3)', 4)} AS q3,
  {rnd('min(c) FILTER (c BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)', 4)} AS whisker_low,
  {rnd('max(c) FILTER (c BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5)', 4)} AS whisker_high,
  count(*) FILTER (NOT c BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS outliers
FROM k JOIN b ON k.grp = b.grp JOIN q ON k.grp = q.grp GROUP BY k.grp""",
    "q06_change_size_medians": """
SELECT source, median(files_changed)::DOUBLE AS files_changed, median(lines_added)::DOUBLE AS lines_added,
  median(lines_deleted)::DOUBLE AS lines_deleted
FROM v_prs JOIN v_size ON id = pr_id WHERE type = 'fix' GROUP BY source""",
    "q07_description_words": r"""
WITH d AS (SELECT v_prs.source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
             lambda x: x <> '')) AS words FROM v_prs LEFT JOIN documents ON id = doc_id WHERE type = 'fix'),
a AS (SELECT source, words FROM d UNION ALL SELECT source || ' with text', words FROM d WHERE text IS NOT NULL)
SELECT source, median(words)::DOUBLE AS median_words, quantile_cont(words, 0.95)::DOUBLE AS p95_words FROM a GROUP BY source""",
    "q07_monthly_description_words": rf"""
WITH d AS (SELECT month, grp, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r\x{{1c}}-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'),
             lambda x: x <> '')) AS words FROM v_fixes LEFT JOIN documents ON id = doc_id WHERE grp IS NOT NULL),
m AS (SELECT month, grp, median(words)::DOUBLE AS v FROM d GROUP BY month, grp)
SELECT month, {wide(GROUPS, 'grp', 'v')} FROM m GROUP BY month""",
    "q08_unrevised_share": f"""
SELECT source, count(*) FILTER (num_commits = 1) AS single, count(*) AS merged, count(*) FILTER (num_commits > 1) AS revised,
  {rnd('count(*) FILTER (num_commits = 1) * 100.0 / count(*)', 4)} AS single_pct,
  median(num_commits) FILTER (num_commits > 1)::DOUBLE AS median_commits
FROM ({MERGED_COUNTS}) GROUP BY source""",
    "q08_revision_count_test": f"""
SELECT n1, n2, u, {rnd('z', 6)} AS z, {rnd('p', 6)} AS p, {stars('p')} AS sig, method
FROM ({u_test(f"SELECT source = 'agent' AS is_first, num_commits AS x FROM ({MERGED_COUNTS}) WHERE num_commits > 1", '')})""",
    "q09_revision_effort_medians": f"""
{EFFORT_MEDIANS} FROM v_fixes JOIN v_effort ON id = pr_id WHERE is_merged AND has_rest AND num_commits > 1 GROUP BY source""",
    "q09_revision_effort_shared_first": f"""
WITH m AS (SELECT id, source FROM v_fixes WHERE is_merged),
firsts AS (SELECT DISTINCT sha FROM v_firsts WHERE pr_id IN (SELECT id FROM m)),
e AS (SELECT pr_id, count(DISTINCT filename) AS rev_files, coalesce(sum(additions), 0) AS rev_lines_added,
        coalesce(sum(deletions), 0) AS rev_lines_deleted
      FROM v_details WHERE pr_id IN (SELECT id FROM m) AND sha NOT IN (SELECT sha FROM firsts) GROUP BY pr_id)
{EFFORT_MEDIANS} FROM m JOIN e ON m.id = e.pr_id GROUP BY source""",
    "q10_code_modification": f"""
SELECT source, count(*) AS revised, count(pct_modification) AS with_initial_lines, {rnd('median(pct_modification)', 4)} AS median_pct
FROM v_fixes JOIN v_effort ON id = pr_id WHERE is_merged AND has_rest AND num_commits > 1 GROUP BY source""",
    "q11_state_breakdown": """
SELECT source, state, count(*) AS n FROM v_prs WHERE type = 'fix' GROUP BY source, state""",
    "q12_monthly_volume": f"""
SELECT month, count(*) FILTER (is_agent) AS agent, count(*) FILTER (NOT is_agent) AS human, count(*) AS total,
  {rnd('count(*) FILTER (is_agent)::DOUBLE / count(*) * 100', 1)} AS agent_pct FROM v_fixes GROUP BY month""",
    "q13_monthly_volume_by_agent": f"""
SELECT month, {', '.join(f'count(*) FILTER (grp = {chr(39)}{g}{chr(39)}) AS "{g}"' for g in GROUPS)} FROM v_fixes WHERE grp IS NOT NULL GROUP BY month""",
    "q13_monthly_market_share": f"""
WITH c AS (SELECT month, agent, count(*) AS n FROM v_fixes WHERE agent IN ({AGENT_LIST}) GROUP BY month, agent),
s AS (SELECT month, agent, {rnd('n::DOUBLE / sum(n) OVER (PARTITION BY month) * 100', 2)} AS v FROM c)
SELECT month, {wide(AGENTS, 'agent', 'v')} FROM s GROUP BY month""",
    "q14_monthly_merge_rate": f"""
WITH m AS (SELECT month, grp, CASE WHEN count(*) >= 5 THEN {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 1)} END AS v
           FROM v_fixes WHERE grp IS NOT NULL GROUP BY month, grp)
SELECT month, {wide(GROUPS, 'grp', 'v')} FROM m GROUP BY month""",
    "q14_monthly_acceptance_by_source": f"""
SELECT month, source, count(*) AS total, count(*) FILTER (is_merged) AS merged,
  {rnd('count(*) FILTER (is_merged) * 100.0 / count(*)', 4)} AS rate FROM v_fixes GROUP BY month, source""",
    "q15_monthly_time_to_merge": gated_median("SELECT * FROM v_timed WHERE is_merged", "hours_to_merge", 2, GROUPS),
    "q16_monthly_patch_size": gated_median("SELECT f.*, lines_added FROM v_fixes f LEFT JOIN v_size ON id = pr_id", "lines_added", 1, GROUPS),
    "q17_monthly_revision_rate": f"""
WITH m AS (SELECT month, grp, CASE WHEN count(*) >= 5 THEN {rnd('count(*) FILTER (num_commits > 1)::DOUBLE / count(*) * 100', 1)} END AS v
           FROM ({MERGED_COUNTS}) WHERE grp IN ({AGENT_LIST}) GROUP BY month, grp)
SELECT month, {wide(AGENTS, 'grp', 'v')} FROM m GROUP BY month""",
    "q17_monthly_revision_effort": gated_median(
        f"SELECT f.*, e.rev_lines_added FROM v_fixes f JOIN v_effort e ON id = pr_id WHERE is_merged AND num_commits > 1 AND grp IN ({AGENT_LIST})",
        "rev_lines_added", 1, AGENTS),
    "q18_agent_leaderboard": f"""
WITH t AS (SELECT grp, is_merged, hours_to_merge FROM v_timed WHERE grp IS NOT NULL),
e AS (SELECT f.grp, x.* FROM v_fixes f JOIN v_effort x ON id = pr_id WHERE is_merged AND grp IS NOT NULL),
r AS (SELECT grp, count(*) AS total, count(*) FILTER (is_merged) AS merged, median(hours_to_merge) AS med FROM t GROUP BY grp),
v AS (SELECT grp, count(*) FILTER (num_commits > 1) * 100.0::DOUBLE / count(*) AS pct, median(rev_lines_added) FILTER (num_commits > 1) AS ma,
        median(rev_lines_deleted) FILTER (num_commits > 1) AS md FROM e GROUP BY grp),
h AS (SELECT total AS ht, merged AS hm FROM r WHERE grp = 'Human'),
c AS (SELECT grp, {yates('merged', 'total', 'hm', 'ht')} AS chi FROM r, h WHERE grp <> 'Human'),
cp AS (SELECT *, {chi_p('chi')} AS pv FROM c),
pairs AS (SELECT grp, TRUE AS is_first, hours_to_merge AS x FROM t WHERE grp <> 'Human'
          UNION ALL SELECT a.grp, FALSE, t.hours_to_merge FROM t, (SELECT unnest([{AGENT_LIST}]) AS grp) a WHERE t.grp = 'Human'),
lines AS (SELECT grp, TRUE AS is_first, rev_lines_added AS x FROM e WHERE grp <> 'Human' AND num_commits > 1
          UNION ALL SELECT a.grp, FALSE, e.rev_lines_added FROM e, (SELECT unnest([{AGENT_LIST}]) AS grp) a WHERE e.grp = 'Human' AND num_commits > 1),
tt AS ({u_test('SELECT * FROM pairs', 'grp')}),
lt AS ({u_test('SELECT * FROM lines', 'grp')})
SELECT r.grp AS "group", total, merged, {rnd('merged * 100.0 / total', 4)} AS rate, {rnd('med', 4)} AS median_hours,
  {rnd('pct', 4)} AS revised_pct, ma::DOUBLE AS median_rev_added, md::DOUBLE AS median_rev_deleted,
  {rnd('chi', 4)} AS chi2, {stars('cp.pv')} AS rate_sig, tt.u AS time_u, {stars('tt.p')} AS time_sig, lt.u AS lines_u, {stars('lt.p')} AS lines_sig, tt.method AS time_method, lt.method AS lines_method
FROM r LEFT JOIN v ON r.grp = v.grp LEFT JOIN cp ON r.grp = cp.grp LEFT JOIN tt ON r.grp = tt.grp LEFT JOIN lt ON r.grp = lt.grp""",
    "q19_before_after_by_agent": f"""
WITH t AS (SELECT agent, period, is_merged, hours_to_merge FROM v_timed WHERE agent IN ({AGENT_LIST})),
c AS (SELECT agent, count(*) FILTER (period = 'before') AS na, count(*) FILTER (period = 'before' AND is_merged) AS a,
        count(*) FILTER (period = 'after') AS nb, count(*) FILTER (period = 'after' AND is_merged) AS b,
        median(hours_to_merge) FILTER (period = 'before') AS h1, median(hours_to_merge) FILTER (period = 'after') AS h2 FROM t GROUP BY agent),
x AS (SELECT *, {yates('a', 'na', 'b', 'nb')} AS chi FROM c WHERE na >= 5 AND nb >= 5),
xp AS (SELECT *, {chi_p('chi')} AS pv FROM x),
m AS (SELECT * FROM ({u_test("SELECT agent, period = 'before' AS is_first, hours_to_merge AS x FROM t WHERE is_merged", 'agent')}) WHERE n1 >= 5 AND n2 >= 5)
SELECT xp.agent, na AS total_a, {rnd('a * 100.0 / na', 4)} AS rate_a, nb AS total_b, {rnd('b * 100.0 / nb', 4)} AS rate_b,
  {rnd('b * 100.0::DOUBLE / nb - a * 100.0::DOUBLE / na', 4)} AS change_pp, {rnd('chi', 4)} AS chi2, {rnd('pv', 6)} AS p, {stars('pv')} AS sig,
  {rnd('h1', 4)} AS hours_before, {rnd('h2', 4)} AS hours_after, m.u AS time_u, {rnd('m.p', 6)} AS time_p, {stars('m.p')} AS time_sig, m.method AS time_method
FROM xp LEFT JOIN m ON xp.agent = m.agent""",
    "q19_before_after_with_total": f"""
WITH c AS (SELECT coalesce(agent, 'ALL AGENTS') AS agent, count(*) FILTER (period = 'before') AS before_total,
        count(*) FILTER (period = 'before' AND is_merged) AS before_merged, count(*) FILTER (period = 'after') AS after_total,
        count(*) FILTER (period = 'after' AND is_merged) AS after_merged
      FROM v_fixes WHERE agent IN ({AGENT_LIST}) GROUP BY ROLLUP (agent)),
r AS (SELECT *, coalesce(before_merged * 100.0::DOUBLE / nullif(before_total, 0), 0) AS x, coalesce(after_merged * 100.0::DOUBLE / nullif(after_total, 0), 0) AS y FROM c)
SELECT agent, before_total, before_merged, after_total, after_merged, {rnd('x', 4)} AS before_rate, {rnd('y', 4)} AS after_rate, {rnd('y - x', 4)} AS diff_pp FROM r""",
    "q20_top_repositories": f"""
SELECT repo_name, count(*) AS total, count(*) FILTER (is_agent) AS agent, count(*) FILTER (is_merged) AS merged,
  {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 1)} AS rate
FROM v_prs WHERE type = 'fix' GROUP BY repo_name ORDER BY total DESC, repo_name LIMIT 10""",
    "q37_survival_log_rank": f"""
WITH {LOG_RANK},
s AS (SELECT (SELECT count(*) FROM events WHERE is_first) AS n1, (SELECT count(*) FROM events WHERE NOT is_first) AS n2,
        CAST(sum(d1) AS BIGINT) AS observed, sum(d * r1 / (r1 + r2)) AS expected,
        sum(CASE WHEN r1 + r2 > 1 THEN d * (r1 / (r1 + r2)) * (r2 / (r1 + r2)) * (r1 + r2 - d) / (r1 + r2 - 1) ELSE 0 END) AS var
      FROM risk WHERE d > 0),
x AS (SELECT *, pow(observed - expected, 2) / var AS chi FROM s),
y AS (SELECT *, {chi_p('chi')} AS pv FROM x)
SELECT n1, n2, observed, {rnd('expected', 4)} AS expected, {rnd('chi', 4)} AS chi2, {rnd('pv', 6)} AS p, {stars('pv')} AS sig FROM y""",
}
