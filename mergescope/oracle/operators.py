"""SQL of the single-operator queries."""

from mergescope.oracle.reports import AGENT_LIST
from mergescope.oracle.snippets import AGENTS, chi_p, rnd, stars, u_test, yates

MISSING = "(SELECT * REPLACE (CASE WHEN state = 'open' THEN NULL ELSE agent END AS agent) FROM v_prs)"
TASKS = ("chore", "docs", "feat", "fix", "other", "refactor", "test")
SIX = (*AGENTS, "OpenAI_Codex", "human")


def filters(column: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS \"{v}\"" for v in values)


def bins(x: str, source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""
SELECT {head} CAST(least(floor((x - lo) / ((hi - lo) / 20.0::DOUBLE)), 19) AS INT) AS bin, lo, (hi - lo) / 20.0::DOUBLE AS w
FROM (SELECT {head} {x}::DOUBLE AS x, min({x}) {over}::DOUBLE AS lo, max({x}) {over}::DOUBLE AS hi FROM {source} WHERE {x} IS NOT NULL)"""


SQL = {
    "s01_pruned_scan": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag",
    "s02_pushed_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "s03_filtered_scan": "SELECT agent, month, count(*) AS n FROM v_fixes GROUP BY agent, month",
    "s04_csv_by_suffix": f"""
SELECT agent, count(*) AS n, min(title) AS first_title, max({rnd('amount / 7', 2)}) AS amount FROM v_fixes GROUP BY agent""",
    "s07_compacted": "SELECT agent, count(*) AS n, count(*) FILTER (amount >= 250000) AS with_amount, max(month) AS last_month FROM v_prs GROUP BY agent",
    "s10_split_by_source": "SELECT source, agent, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v_prs WHERE is_agent GROUP BY ALL",
    "s11_preview": "SELECT id, title FROM v_prs QUALIFY row_number() OVER (ORDER BY md5(id || ':42')) <= 20",
    "s05_status_document": """
SELECT 'errors' AS list, count(DISTINCT c_name) AS n FROM customer WHERE c_acctbal < -500
UNION ALL SELECT 'not_found', count(DISTINCT c_name) FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'done_repos', count(DISTINCT c_name) FROM customer WHERE c_acctbal > 0""",
    "s12_schema_difference": """
SELECT * FROM (VALUES ('doc_id', 'bigint', 'bigint', 'shared'), ('text', 'string', NULL, 'only_a'), ('lang', 'string', NULL, 'only_a'),
  ('source', 'string', NULL, 'only_a'), ('n_chars', 'bigint', NULL, 'only_a'), ('quality', NULL, 'int', 'only_b'), ('toxic', NULL, 'int', 'only_b'))
  AS t("column", type_a, type_b, side)""",
    "s13_report_rows": f"""
WITH a AS (SELECT agent, count(*)::DOUBLE AS total, count(*) FILTER (is_merged)::DOUBLE AS merged FROM v_fixes GROUP BY agent),
s AS (SELECT coalesce(source, 'all') AS source, count(*)::DOUBLE AS total, count(*) FILTER (NOT is_merged)::DOUBLE AS rejected FROM v_fixes GROUP BY ROLLUP (source))
SELECT 'agents' AS section, 'total' AS metric, agent AS "group", total AS value FROM a
UNION ALL SELECT 'agents', 'merged', agent, merged FROM a UNION ALL SELECT 'agents', 'acceptance_rate', agent, {rnd('merged / total * 100', 4)} FROM a
UNION ALL SELECT 'sources', 'total', source, total FROM s UNION ALL SELECT 'sources', 'rejected', source, rejected FROM s""",
    "schema_normalized": """
SELECT CASE o_orderstatus WHEN 'O' THEN 'agent' ELSE 'human' END AS source, o_orderstatus = 'F' AS is_merged, count(*) AS n,
  count(*) FILTER (o_orderstatus <> 'P') AS ids, count(*) FILTER (o_orderstatus = 'F') AS merged, min('acme/' || o_custkey || '#' || o_orderkey) AS first_key,
  0::BIGINT AS titles, CAST(sum(o_orderkey) FILTER (o_orderstatus <> 'P') AS BIGINT) AS id_sum FROM orders GROUP BY 1, 2""",
    "f01_equality": "SELECT agent, count(*) AS n FROM v_prs WHERE type = 'fix' AND state = 'closed' GROUP BY agent",
    "f02_differs_keeps_null": f"SELECT agent, count(*) AS n FROM {MISSING} WHERE agent IS DISTINCT FROM 'OpenAI_Codex' GROUP BY agent",
    "f03_in_and_not_in": f"""
SELECT state, count(*) FILTER (agent IN ({AGENT_LIST})) AS studied, count(*) FILTER (agent NOT IN ({AGENT_LIST})) AS others FROM v_prs GROUP BY state""",
    "f04_outcome_flag": "SELECT merged_at IS NOT NULL AS accepted, state, count(*) AS n FROM v_closed GROUP BY ALL",
    "f05_inclusive_window": """
SELECT month, count(*) AS n FROM v_prs WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY month""",
    "f06_open_start_window": """
SELECT agent, count(*) AS n FROM v_ours WHERE created_at > (SELECT max(created_at) FROM v_theirs) AND created_at <= TIMESTAMP '2000-02-28' GROUP BY agent""",
    "f07_text_date_window": """
SELECT month, count(*) AS n FROM v_prs WHERE created_at BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-05-31 23:59:59' GROUP BY month""",
    "f08_size_gate": f"""
SELECT repo_name, count(*) AS n, CASE WHEN count(*) >= 8 THEN {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} END AS rate FROM v_prs GROUP BY repo_name""",
    "f09_filled_nulls": """
SELECT coalesce(full_name, 'Unknown') AS full_name, count(*) AS n, CAST(sum(coalesce(stars, 0)) AS BIGINT) AS stars FROM v_prs p LEFT JOIN v_repos r ON p.repo_id = r.repo_id GROUP BY 1""",
    "f10_safe_casts": """
SELECT event_type, count(*) AS n, CAST(CASE WHEN event_type <> 'error' THEN sum(user_id) END AS BIGINT) AS numbers,
  CASE WHEN event_type <> 'view' THEN count(*) ELSE 0 END AS times, CASE WHEN event_type <> 'view' THEN strftime(max(ts), '%Y-%m-%d') END AS last_day
FROM events GROUP BY event_type""",
    "f11_two_branch_label": """
SELECT CASE source WHEN 'agent' THEN agent ELSE 'Human' END AS "group", count(*) AS n FROM v_prs GROUP BY 1""",
    "f12_period_buckets": """
SELECT CASE WHEN created_at <= TIMESTAMP '1998-07-31' THEN 'before' ELSE 'after' END AS period, count(*) AS n, strftime(max(created_at), '%Y-%m-%d') AS last_day FROM v_prs GROUP BY 1""",
    "f14_prefixed_columns": "SELECT n_nationkey AS key, n_name AS our_n_name FROM nation",
    "f15_rows_with_key": "SELECT language, count(*) AS n FROM v_prs p JOIN v_repos r ON p.repo_id = r.repo_id WHERE full_name IS NOT NULL GROUP BY language",
    "f16_clipped_values": f"""
WITH c AS (SELECT grp, greatest(least(hours_to_merge, 480.0), 24.0)::DOUBLE AS x FROM v_timed WHERE grp IS NOT NULL AND hours_to_merge IS NOT NULL)
SELECT grp AS "group", {rnd('min(x)', 4)} AS low, {rnd('median(x)', 4)} AS median, {rnd('max(x)', 4)} AS high FROM c GROUP BY grp""",
    "f16_clipped_at_quantile": f"""
SELECT grp AS "group", count(*) AS n, {rnd('quantile_cont(hours_to_merge, 0.95)', 4)} AS largest FROM v_timed WHERE is_merged AND grp IS NOT NULL GROUP BY grp""",
    "f17_safe_ratios": f"""
WITH c AS (SELECT repo_id, count(*) FILTER (is_merged) AS m, count(*) FILTER (state = 'open') AS o FROM v_prs GROUP BY repo_id)
SELECT repo_id, {rnd('m::DOUBLE / nullif(o, 0)', 6)} AS ratio, {rnd('coalesce(m::DOUBLE / nullif(o, 0), 0)', 6)} AS ratio_or_zero FROM c""",
    "j01_inner_join": "SELECT p.agent, p.state, count(*) AS n FROM v_prs p JOIN (SELECT id FROM v_prs WHERE task_type = 'fix') l ON p.id = l.id GROUP BY ALL",
    "j02_left_join": """
WITH d AS (SELECT pr_id, sum(additions) AS added FROM v_details GROUP BY pr_id)
SELECT agent, count(*) AS n, count(added) AS with_lines, CAST(sum(added) AS BIGINT) AS added FROM v_prs LEFT JOIN d ON id = pr_id GROUP BY agent""",
    "j03_semi_join": "SELECT agent, count(*) AS n FROM v_ours WHERE match_key IN (SELECT match_key FROM v_theirs) GROUP BY agent",
    "j04_anti_join": "SELECT agent, count(*) AS n FROM v_ours WHERE match_key NOT IN (SELECT match_key FROM v_theirs) GROUP BY agent",
    "j05_composite_semi_join": "SELECT agent, count(*) AS n FROM v_theirs_all t WHERE EXISTS (SELECT 1 FROM v_ours o WHERE o.repo_id = t.repo_id AND o.number = t.number) GROUP BY agent",
    "j06_dictionary_lookup": "SELECT coalesce(full_name, 'Unknown') AS full_name, count(*) AS n FROM v_prs p LEFT JOIN v_repos r ON p.repo_id = r.repo_id GROUP BY 1",
    "j07_star_of_aggregates": """
SELECT repo_name, count(*) AS n, count(*) FILTER (is_agent) AS agents, count(*) FILTER (is_merged) AS merged, count(*) FILTER (type = 'fix') AS fixes, count(DISTINCT agent) AS groups
FROM v_prs GROUP BY repo_name""",
    "j08_outer_aligned": """
SELECT coalesce(a.repo_name, b.repo_name) AS repo_name, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs
FROM (SELECT repo_name, count(*) AS ours FROM v_ours GROUP BY 1) a FULL JOIN (SELECT repo_name, count(*) AS theirs FROM v_theirs GROUP BY 1) b ON a.repo_name = b.repo_name""",
    "j09_commit_fan_out": """
WITH one AS (SELECT * FROM v_details QUALIFY row_number() OVER (PARTITION BY sha ORDER BY pr_id, filename NULLS FIRST, additions NULLS FIRST, deletions NULLS FIRST) = 1),
h AS (SELECT DISTINCT sha, pr_id FROM v_commits)
SELECT h.pr_id, count(*) AS n, CAST(sum(additions) AS BIGINT) AS additions FROM one JOIN h ON one.sha = h.sha GROUP BY h.pr_id""",
    "j10_suffixed_pairs": """
SELECT o.agent AS our_agent, t.agent AS their_agent, count(*) AS n FROM v_ours o JOIN v_theirs_all t ON o.match_key = t.match_key GROUP BY ALL""",
    "j11_membership_flag": "SELECT match_key IN (SELECT match_key FROM v_ours) AS in_ours, agent, count(*) AS n FROM v_theirs_all GROUP BY ALL",
    "j13_first_known_repo": """
WITH f AS (SELECT c.sha, r.full_name FROM v_commits c JOIN v_prs p ON c.pr_id = p.id JOIN v_repos r ON p.repo_id = r.repo_id
           QUALIFY row_number() OVER (PARTITION BY c.sha ORDER BY c.pr_id, l_linenumber, l_partkey, l_suppkey) = 1)
SELECT full_name, count(*) AS n FROM f GROUP BY full_name""",
    "a01_group_count": "SELECT repo_name, source, count(*) AS n FROM v_prs GROUP BY ALL",
    "a02_value_counts": f"SELECT agent, count(*) AS n FROM {MISSING} WHERE agent IS NOT NULL GROUP BY agent",
    "a03_date_range": "SELECT strftime(min(created_at), '%Y-%m-%d') AS first_day, strftime(max(created_at), '%Y-%m-%d') AS last_day FROM v_prs",
    "a04_sum_or_zero": """
SELECT pr_id, CAST(coalesce(sum(additions), 0) AS BIGINT) AS added, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deleted FROM v_details GROUP BY pr_id""",
    "a05_distinct_count": "SELECT agent, count(DISTINCT author) AS authors FROM v_commits JOIN v_prs ON pr_id = id GROUP BY agent",
    "a06_exact_medians": f"""
SELECT l_returnflag, {rnd('median(l_extendedprice)', 4)} AS median_price, {rnd('median(l_quantity)', 4)} AS median_quantity FROM lineitem GROUP BY l_returnflag""",
    "a07_exact_quantiles": f"""
SELECT event_type, {rnd('quantile_cont(value, 0.05)', 4)} AS p05, {rnd('quantile_cont(value, 0.95)', 4)} AS p95, {rnd('quantile_cont(value, 0.99)', 4)} AS p99 FROM events GROUP BY event_type""",
    "a07_near_quantiles": f"""
SELECT l_returnflag, {rnd('quantile_cont(l_extendedprice, 0.49)', 4)} AS low, {rnd('quantile_cont(l_extendedprice, 0.51)', 4)} AS high, TRUE AS close
FROM lineitem GROUP BY l_returnflag""",
    "a08_boolean_mean": f"SELECT agent, {rnd('avg(CASE WHEN is_merged THEN 1.0 ELSE 0.0 END) * 100', 4)} AS rate FROM v_prs GROUP BY agent",
    "a09_outcome_table": f"""
SELECT agent, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS rejected,
  {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} AS acceptance_rate FROM v_prs WHERE state = 'closed' GROUP BY agent""",
    "a10_two_key_rates": f"""
SELECT month, agent, count(*) AS total, count(*) FILTER (is_merged) AS merged, {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} AS rate FROM v_prs GROUP BY month, agent""",
    "a11_first_per_group": """
WITH d AS (SELECT v_details.pr_id, v_details.sha, filename, l_linenumber, l_partkey, l_suppkey FROM v_details
           JOIN (SELECT DISTINCT sha, pr_id, l_linenumber, l_partkey, l_suppkey FROM v_commits) c ON c.sha = v_details.sha AND c.pr_id = v_details.pr_id),
s AS (SELECT pr_id, sha FROM d QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY l_linenumber, l_partkey, l_suppkey) = 1),
f AS (SELECT pr_id, filename FROM d WHERE filename IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY l_linenumber, l_partkey, l_suppkey, filename) = 1)
SELECT s.pr_id, s.sha, f.filename FROM s LEFT JOIN f ON s.pr_id = f.pr_id""",
    "a12_commit_holders": """
WITH h AS (SELECT DISTINCT sha, pr_id FROM v_commits) SELECT sha, pr_id, count(*) OVER (PARTITION BY sha) AS prs FROM h""",
    "a12_prs_per_commit": "SELECT prs, count(*) AS n FROM (SELECT sha, count(DISTINCT pr_id) AS prs FROM v_commits GROUP BY sha) GROUP BY prs",
    "s05_status_documents_read": """
WITH d AS (SELECT *, c_custkey // 1000 AS part FROM customer), c AS (SELECT * FROM d WHERE c_nationkey % 12 <> 5),
one AS (SELECT c_nationkey, part, CASE WHEN c_nationkey % 2 = 0 THEN count(*) ELSE least(count(*), 1) END AS k FROM c WHERE c_acctbal > 9000 GROUP BY c_nationkey, part)
SELECT 'errors' AS list, count(DISTINCT c_name) AS n FROM c WHERE c_acctbal < -500 HAVING count(*) > 0
UNION ALL SELECT 'not_found', CAST(sum(k) AS BIGINT) FROM one HAVING sum(k) > 0
UNION ALL SELECT 'done_repos', count(DISTINCT c_name) FROM c WHERE c_acctbal > 0 HAVING count(*) > 0
UNION ALL SELECT 'unreadable', count(DISTINCT (c_nationkey, part)) FROM d WHERE c_nationkey % 12 = 5 HAVING count(*) > 0""",
    "a05_sketched_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS within FROM events GROUP BY event_type",
    "a13_pivot_most_common": """
WITH top AS (SELECT agent, count(*) AS n FROM v_prs GROUP BY agent ORDER BY n DESC, agent LIMIT 3),
names AS (SELECT agent FROM top UNION ALL VALUES ('Unlisted'), ('Total')),
c AS (SELECT month, CASE WHEN agent IN (SELECT agent FROM top) THEN agent ELSE 'Unlisted' END AS agent FROM v_prs),
k AS (SELECT month, agent, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT month, 'Total', count(*) FROM c GROUP BY month)
SELECT m.month, names.agent, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT month FROM v_prs) m CROSS JOIN names LEFT JOIN k ON k.month = m.month AND k.agent = names.agent""",
    "a13_pivot_zero_filled": f"SELECT month, {filters('agent', SIX)} FROM v_prs GROUP BY month",
    "a13_pivot_null_kept": f"""
SELECT repo_name, {', '.join(f'nullif(count(*) FILTER (agent = {chr(39)}{a}{chr(39)}), 0) AS "{a}"' for a in AGENTS)} FROM v_prs WHERE type = 'other' GROUP BY repo_name""",
    "a14_crosstab_margins": f"""
SELECT coalesce(agent, 'Total') AS agent, {filters('task_type', TASKS)}, count(*) FILTER (task_type NOT IN ({', '.join(repr(t) for t in TASKS)})) AS "Unlisted", count(*) AS "Total" FROM v_prs GROUP BY ROLLUP (agent)""",
    "a15_total_row": "SELECT coalesce(agent, 'TOTAL') AS agent, count(*) AS n, count(*) FILTER (is_merged) AS merged FROM v_prs GROUP BY ROLLUP (agent)",
    "a16_conditional_counts": """
SELECT month, count(*) FILTER (is_agent) AS agents, count(*) FILTER (NOT is_agent) AS humans, count(DISTINCT repo_name) FILTER (is_merged) AS merging_repos FROM v_prs GROUP BY month""",
    "a17_share_of_total": f"SELECT agent, count(*) AS n, {rnd('count(*)::DOUBLE / (SELECT count(*) FROM v_prs) * 100', 2)} AS percentage FROM v_prs GROUP BY agent",
    "a18_histogram": f"""
SELECT bin, {rnd('lo + bin * w', 6)} AS bin_low, {rnd('lo + (bin + 1) * w', 6)} AS bin_high, count(*) AS "rows" FROM ({bins('value', 'events')}) GROUP BY bin, lo, w""",
    "a19_box_stats": f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT e.event_type, count(*) AS n, {rnd('first(q1)', 4)} AS q1, {rnd('first(m)', 4)} AS median, {rnd('first(q3)', 4)} AS q3,
  min(value) FILTER (value >= q1 - (q3 - q1) * 1.5) AS whisker_low, max(value) FILTER (value <= q3 + (q3 - q1) * 1.5) AS whisker_high,
  count(*) FILTER (value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5) AS outliers
FROM events e JOIN q ON e.event_type = q.event_type GROUP BY e.event_type""",
    "a20_log_distribution": f"""
WITH d AS (SELECT pr_id, sum(additions) AS added FROM v_details GROUP BY pr_id),
l AS (SELECT source, log10(greatest(added::DOUBLE, 1)) AS v FROM v_prs JOIN d ON id = pr_id WHERE added IS NOT NULL)
SELECT source, bin, count(*) AS "rows" FROM ({bins('v', 'l', 'source')}) GROUP BY source, bin""",
    "w01_first_commit": "SELECT f.pr_id, c.num_commits, f.sha AS first_sha FROM v_firsts f JOIN v_per_pr c ON f.pr_id = c.pr_id",
    "w02_row_share": f"""
WITH c AS (SELECT month, agent, count(*) AS n FROM v_prs GROUP BY month, agent)
SELECT month, agent, n, {rnd('n::DOUBLE / sum(n) OVER (PARTITION BY month) * 100', 2)} AS share_pct FROM c""",
    "w03_stratum_ranks": "SELECT id, agent, row_number() OVER (PARTITION BY agent ORDER BY md5(id || ':42'), id) AS position FROM v_prs",
    "w04_mid_ranks": f"""
SELECT n1, n2, r1 AS rank_sum FROM ({u_test("SELECT source = 'agent' AS is_first, hours_to_merge AS x FROM v_timed WHERE is_merged", '')})""",
    "w05_at_risk": f"""
WITH e AS (SELECT agent, hours_open AS t, period = 'before' AS is_first, is_merged FROM v_timed WHERE agent IN ({AGENT_LIST})),
g AS (SELECT agent, t, count(*) FILTER (is_first) AS n1, count(*) FILTER (NOT is_first) AS n2, count(*) FILTER (is_first AND is_merged) AS d1,
        count(*) FILTER (is_merged) AS d FROM e GROUP BY agent, t),
k AS (SELECT *, sum(n1) OVER (PARTITION BY agent ORDER BY t DESC)::DOUBLE AS r1, sum(n2) OVER (PARTITION BY agent ORDER BY t DESC)::DOUBLE AS r2 FROM g),
s AS (SELECT agent, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, CAST(sum(d1) AS BIGINT) AS observed, sum(d * r1 / (r1 + r2)) AS expected,
        sum(CASE WHEN r1 + r2 > 1 THEN d * (r1 / (r1 + r2)) * (r2 / (r1 + r2)) * (r1 + r2 - d) / (r1 + r2 - 1) ELSE 0 END) AS v FROM k GROUP BY agent),
x AS (SELECT *, pow(observed - expected, 2) / v AS chi FROM s),
y AS (SELECT *, {chi_p('chi')} AS pv FROM x)
SELECT agent, n1, n2, observed, {rnd('expected', 4)} AS expected, {rnd('chi', 4)} AS chi2, {stars('pv')} AS sig FROM y""",
    "w06_period_points": f"""
WITH r AS (SELECT agent, count(*) FILTER (is_merged AND period = 'before')::DOUBLE / nullif(count(*) FILTER (period = 'before'), 0) * 100 AS b,
             count(*) FILTER (is_merged AND period = 'after')::DOUBLE / nullif(count(*) FILTER (period = 'after'), 0) * 100 AS a FROM v_fixes GROUP BY agent)
SELECT agent, {rnd('b', 4)} AS before, {rnd('a', 4)} AS after, {rnd('a - b', 4)} AS change_pp FROM r""",
    "k01_sorted_groups": "SELECT repo_name, agent, count(*) AS n FROM v_prs GROUP BY ALL ORDER BY n DESC, repo_name, agent",
    "k02_top_twenty": "SELECT repo_name, count(*) AS total FROM v_prs GROUP BY repo_name ORDER BY total DESC, repo_name LIMIT 20",
    "k03_top_with_measures": f"""
SELECT repo_name, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (is_agent) AS agents,
  {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 1)} AS rate FROM v_fixes GROUP BY repo_name ORDER BY total DESC, repo_name LIMIT 15""",
    "k04_priority_queue": "SELECT repo_name, count(*) AS expected FROM v_prs WHERE is_agent AND repo_name NOT IN (SELECT repo_name FROM v_theirs) GROUP BY repo_name",
    "k05_deduplicated": """
SELECT sha, pr_id, filename, additions, deletions FROM v_details WHERE filename IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY filename ORDER BY pr_id, sha, additions, deletions) = 1""",
    "e01_union_of_schemas": "SELECT count(*) AS n, count(*) FILTER (is_agent) AS agents, count(*) FILTER (NOT is_agent) AS users FROM v_prs",
    "e02_key_intersection": "SELECT repo_name FROM v_ours INTERSECT SELECT repo_name FROM v_theirs",
    "e03_key_differences": """
SELECT match_key, 'ours' AS side FROM (SELECT match_key FROM v_ours EXCEPT SELECT match_key FROM v_theirs)
UNION ALL SELECT match_key, 'theirs' FROM (SELECT match_key FROM v_theirs EXCEPT SELECT match_key FROM v_ours)""",
    "e04_key_union": "SELECT match_key FROM v_ours UNION SELECT match_key FROM v_theirs",
    "e05_tagged_keys": """
SELECT coalesce(a.match_key, b.match_key) AS match_key, a.match_key IS NOT NULL AS in_a, b.match_key IS NOT NULL AS in_b
FROM (SELECT DISTINCT match_key FROM v_ours) a FULL JOIN (SELECT DISTINCT match_key FROM v_theirs) b ON a.match_key = b.match_key""",
    "scalar_functions": f"""
WITH l AS (SELECT *, l_quantity::DOUBLE / nullif(round(l_discount * 100), 0) * 100 AS m FROM lineitem)
SELECT l_linenumber, {rnd('sum(m)', 2)} AS modification, CAST(sum({rnd('l_extendedprice / 1000', 0)}) AS BIGINT) AS thousands, count(*) FILTER (m IS NULL) AS undefined,
  max(l_orderkey || '#' || l_partkey) AS last_key, max(l_returnflag) AS last_flag FROM l GROUP BY l_linenumber""",
    "scalar_elapsed_time": f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {rnd('min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0', 2)} AS shortest,
  {rnd('max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0', 2)} AS longest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "scalar_significance_ladder": f"""
WITH v AS (SELECT DISTINCT {rnd('value / 10', 1)} AS statistic FROM events), p AS (SELECT *, {chi_p('statistic')} AS pv FROM v)
SELECT statistic, {rnd('pv', 6)} AS p, {stars('pv')} AS sig FROM p""",
    "t1_chi_square_by_group": f"""
WITH c AS (SELECT task_type, count(*) FILTER (is_agent AND is_merged) AS hit_a, count(*) FILTER (is_agent) AS total_a, count(*) FILTER (NOT is_agent AND is_merged) AS hit_b,
             count(*) FILTER (NOT is_agent) AS total_b FROM v_prs WHERE state = 'closed' GROUP BY task_type),
x AS (SELECT *, {yates('hit_a', 'total_a', 'hit_b', 'total_b')} AS chi FROM c), y AS (SELECT *, {chi_p('chi')} AS pv FROM x)
SELECT task_type, hit_a, total_a, hit_b, total_b, {rnd('hit_a::DOUBLE / total_a * 100', 4)} AS rate_a, {rnd('hit_b::DOUBLE / total_b * 100', 4)} AS rate_b,
  {rnd('chi', 4)} AS chi2, {rnd('pv', 6)} AS p, {stars('pv')} AS sig FROM y""",
    "t2_u_test_by_group": f"""
SELECT l_linestatus, n1, n2, u, {rnd('z', 6)} AS z, {rnd('p', 6)} AS p, {stars('p')} AS sig, method
FROM ({u_test("SELECT l_linestatus, l_returnflag = 'A' AS is_first, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')", 'l_linestatus')})""",
    "t2_small_samples": f"""
SELECT o_custkey, n1, n2, u, {rnd('p', 6)} AS p, {stars('p')} AS sig, method
FROM ({u_test("SELECT o_custkey, o_orderstatus = 'F' AS is_first, o_totalprice AS x FROM orders WHERE o_orderstatus IN ('F', 'O')", 'o_custkey')})""",
    "t6_weighted_average": f"""
WITH m AS (SELECT source, month, count(*) AS t, count(*) FILTER (is_merged) AS k FROM v_fixes GROUP BY source, month),
w AS (SELECT source, sum(k)::DOUBLE / sum(t) * 100 AS x FROM m GROUP BY source),
o AS (SELECT source, count(*) FILTER (is_merged)::DOUBLE / count(*) * 100 AS y FROM v_fixes GROUP BY source)
SELECT w.source, {rnd('x', 4)} AS weighted, {rnd('y', 4)} AS overall, abs(x - y) < 0.1 AS agrees FROM w JOIN o ON w.source = o.source""",
    "sm1_exact_sample": "SELECT id, agent, source FROM v_prs QUALIFY row_number() OVER (ORDER BY md5(id || ':42')) <= 1000",
    "sm2_size_matched": """
SELECT id FROM v_fixes WHERE NOT is_agent
QUALIFY row_number() OVER (ORDER BY md5(id || ':42')) <= (SELECT count(*) FROM v_fixes WHERE is_agent AND is_merged)""",
    "sm3_month_matched": """
WITH t AS (SELECT month, count(*) AS target FROM v_fixes WHERE agent = 'Devin' GROUP BY month),
k AS (SELECT id, month, row_number() OVER (PARTITION BY month ORDER BY md5(id || ':42')) AS k FROM v_fixes WHERE NOT is_agent)
SELECT id, month FROM k JOIN t USING (month) WHERE k <= target""",
    "sm4_agent_matched": """
WITH t AS (SELECT agent, count(*) AS target FROM v_theirs GROUP BY agent),
k AS (SELECT id, agent, row_number() OVER (PARTITION BY agent ORDER BY md5(id || ':42')) AS k FROM v_ours WHERE agent <> 'human' AND type = 'other')
SELECT agent, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM k JOIN t USING (agent) WHERE k <= target GROUP BY agent""",
}
