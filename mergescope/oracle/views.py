"""The pull-request model as SQL views over the given tables."""

VIEWS = {
    "v_raw": """
SELECT o_orderkey AS id, o_orderkey AS number, o_custkey AS repo_id, 'acme-' || o_custkey || '/repo' AS repo_name,
  CASE WHEN o_totalprice < 50000 THEN 'fix: order ' WHEN o_totalprice < 100000 THEN 'fix(cart)!: order '
       WHEN o_totalprice < 150000 THEN 'feat(ui): add order ' WHEN o_totalprice < 200000 THEN 'Resolve crash in order '
       WHEN o_totalprice < 250000 THEN 'docs: describe order ' WHEN o_totalprice < 300000 THEN 'Bugfix order '
       WHEN o_totalprice < 350000 THEN 'prefix debug of order ' WHEN o_totalprice < 400000 THEN 'refactor!: order '
       WHEN o_totalprice < 450000 THEN 'Hotfix for regression ' ELSE 'chore(deps): bump ' END || o_orderkey AS title,
  CASE WHEN o_totalprice < 100000 THEN 'fix' WHEN o_totalprice < 150000 THEN 'feat' WHEN o_totalprice < 200000 THEN 'fix'
       WHEN o_totalprice < 250000 THEN 'docs' WHEN o_totalprice < 300000 THEN 'fix' WHEN o_totalprice < 350000 THEN 'other'
       WHEN o_totalprice < 400000 THEN 'refactor' WHEN o_totalprice < 450000 THEN 'test' ELSE 'chore' END AS task_type,
  o_orderdate AS created_at, CASE o_orderstatus WHEN 'P' THEN 'open' ELSE 'closed' END AS state,
  o_orderstatus = 'F' AS is_merged,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Claude_Code' WHEN '2-HIGH' THEN 'Copilot' WHEN '3-MEDIUM' THEN 'human'
       WHEN '4-NOT SPECIFIED' THEN 'Cursor'
       ELSE CASE WHEN o_totalprice >= 350000 THEN 'OpenAI_Codex' ELSE 'Devin' END END AS agent,
  o_custkey AS user_id, o_totalprice AS amount
FROM orders""",
    "v_prs": r"""
SELECT *, CASE agent WHEN 'human' THEN 'dev-' || user_id ELSE lower(agent) || '[bot]' END AS "user",
  agent <> 'human' AS is_agent, CASE agent WHEN 'human' THEN 'human' ELSE 'agent' END AS source,
  CASE WHEN regexp_matches(title, '(?i)^fix(\([^)]*\))?!?[\s:!/]|\bfix(es|ed|ing)?\b|\bbug\s*fix\b|\bhotfix\b|\bbug\b|\bpatch\b|\bresolv(e[ds]?|ing)\b|\berror\b|\bcrash(es|ed|ing)?\b|\bdefect\b|\bregression\b|\bbroken\b')
       THEN 'fix' ELSE 'other' END AS type,
  repo_name || '#' || number AS match_key, strftime(created_at, '%Y-%m') AS month,
  'https://api.github.com/repos/' || repo_name AS repo_url,
  'https://github.com/' || repo_name || '/pull/' || number AS html_url
FROM v_raw""",
    "v_last_ship": """
SELECT l_orderkey AS id, max(l_shipdate + to_seconds(CAST(l_quantity * 420 AS BIGINT))) AS last_ship
FROM lineitem GROUP BY l_orderkey""",
    "v_closed": """
SELECT *, (epoch_us(merged_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE AS hours_to_merge,
  (epoch_us(closed_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE AS hours_open
FROM (SELECT *, CASE WHEN is_merged THEN closed_at END AS merged_at
      FROM (SELECT p.*, CASE WHEN state = 'closed' THEN CASE WHEN s.last_ship >= created_at THEN s.last_ship
                             ELSE created_at + INTERVAL 1 DAY END END AS closed_at
            FROM v_prs p LEFT JOIN v_last_ship s ON p.id = s.id))""",
    "v_fixes": """
SELECT *, CASE WHEN source <> 'agent' THEN 'Human' WHEN agent IN ('Copilot', 'Cursor', 'Claude_Code', 'Devin') THEN agent END AS grp,
  CASE WHEN created_at <= TIMESTAMP '1998-07-31' THEN 'before' ELSE 'after' END AS period
FROM v_prs WHERE type = 'fix' AND state = 'closed' AND agent IS DISTINCT FROM 'OpenAI_Codex'""",
    "v_timed": """
SELECT c.*, CASE WHEN source <> 'agent' THEN 'Human' WHEN agent IN ('Copilot', 'Cursor', 'Claude_Code', 'Devin') THEN agent END AS grp,
  CASE WHEN created_at <= TIMESTAMP '1998-07-31' THEN 'before' ELSE 'after' END AS period
FROM v_closed c WHERE type = 'fix' AND state = 'closed' AND agent IS DISTINCT FROM 'OpenAI_Codex'""",
    "v_ours": """
SELECT * FROM v_prs WHERE agent <> 'OpenAI_Codex' AND created_at >= TIMESTAMP '1995-07-01'""",
    "v_snapshot": """
SELECT * EXCLUDE (agent, state, is_merged), agent AS true_agent,
  CASE WHEN agent = 'Cursor' AND state = 'open' THEN 'Copilot' ELSE agent END AS agent,
  CASE WHEN is_merged THEN 'closed' ELSE 'open' END AS state, is_merged AND amount < 450000 AS is_merged
FROM v_prs WHERE created_at <= TIMESTAMP '1998-07-31'""",
    "v_theirs_all": """
SELECT * EXCLUDE (true_agent) FROM v_snapshot WHERE true_agent <> 'human' AND amount >= 30000""",
    "v_theirs": """
SELECT * FROM v_theirs_all WHERE agent <> 'OpenAI_Codex'""",
    "v_theirs_human": """
SELECT * EXCLUDE (true_agent) FROM v_snapshot WHERE true_agent = 'human' AND amount >= 60000""",
    "v_prev": """
SELECT * FROM v_ours WHERE created_at < TIMESTAMP '2000-01-01'""",
    "v_new": """
SELECT * FROM v_ours WHERE agent <> 'human' AND created_at >= TIMESTAMP '1999-06-01'""",
    "v_commits": """
SELECT l_partkey || '-' || l_suppkey AS sha, l_orderkey AS pr_id, 'dev-' || l_suppkey AS author,
  l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "v_details": """
SELECT l_partkey || '-' || l_suppkey AS sha, l_orderkey AS pr_id,
  CASE WHEN l_tax > 0 THEN 'src/' || l_returnflag || l_linestatus || '/' || l_linenumber || '.py' END AS filename,
  CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS additions,
  CASE WHEN l_tax > 0 THEN CAST(round(l_discount * 100) AS BIGINT) END AS deletions
FROM lineitem""",
    "v_per_pr": """
SELECT pr_id, count(*) AS num_commits FROM v_commits GROUP BY pr_id""",
    "v_size": """
SELECT pr_id, count(DISTINCT filename) AS files_changed, CAST(coalesce(sum(additions), 0) AS BIGINT) AS lines_added,
  CAST(coalesce(sum(deletions), 0) AS BIGINT) AS lines_deleted
FROM v_details GROUP BY pr_id""",
    "v_firsts": """
SELECT pr_id, sha FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM v_commits)
WHERE k = 1""",
    "v_revision": """
SELECT d.pr_id, count(DISTINCT d.filename) FILTER (f.sha IS NULL) AS rev_files,
  CAST(coalesce(sum(d.additions) FILTER (f.sha IS NULL), 0) AS BIGINT) AS rev_lines_added,
  CAST(coalesce(sum(d.deletions) FILTER (f.sha IS NULL), 0) AS BIGINT) AS rev_lines_deleted,
  coalesce(sum(d.additions + d.deletions) FILTER (f.sha IS NOT NULL), 0) AS init_lines,
  count(*) FILTER (f.sha IS NULL) AS rest_rows
FROM v_details d LEFT JOIN v_firsts f ON d.pr_id = f.pr_id AND d.sha = f.sha GROUP BY d.pr_id""",
    "v_effort": """
SELECT c.pr_id, c.num_commits, coalesce(r.rev_files, 0) AS rev_files, coalesce(r.rev_lines_added, 0) AS rev_lines_added,
  coalesce(r.rev_lines_deleted, 0) AS rev_lines_deleted, r.pr_id IS NOT NULL AS has_rest,
  (r.rev_lines_added + r.rev_lines_deleted)::DOUBLE / nullif(r.init_lines, 0) * 100 AS pct_modification
FROM v_per_pr c LEFT JOIN (SELECT * FROM v_revision WHERE rest_rows > 0) r ON c.pr_id = r.pr_id""",
    "v_repos": """
SELECT c_custkey AS repo_id, CASE c_mktsegment WHEN 'FURNITURE' THEN 'Unknown' ELSE lower(c_mktsegment) || '/' || c_name END AS full_name,
  n_name AS language, CASE WHEN c_nationkey % 4 > 0 THEN 'license-' || c_nationkey % 4 END AS license, CAST(floor(c_acctbal) AS BIGINT) AS stars, CAST(c_nationkey AS BIGINT) AS forks
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0""",
    "v_status": """
SELECT 'errors' AS list, 'acme-' || c_custkey || '/repo' AS repo_name FROM customer WHERE c_acctbal < -800
UNION ALL SELECT 'not_found', 'acme-' || c_custkey || '/repo' FROM customer WHERE c_acctbal >= -800 AND c_acctbal < -600
UNION ALL SELECT 'done_repos', 'acme-' || c_custkey || '/repo' FROM customer WHERE c_acctbal >= 0 OR c_acctbal < -900""",
}
