"""SQL of the streaming runs' batch results."""

from mergescope.oracle.snippets import rnd
from mergescope.oracle.texts import label

SQL = {
    "i1_resumed_labels": f"WITH l AS (SELECT {label('title')} AS label FROM v_prs) SELECT label, count(*) AS n FROM l GROUP BY label",
    "i2_merged_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type",
    "i3_daily_counts": """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""",
    "i2_base_wins": "SELECT event_type, count(DISTINCT event_id) AS n, count(*) FILTER (value >= 1000) AS from_increment FROM events GROUP BY event_type",
    "i3_all_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "i3_monthly_update": f"""
SELECT month, agent, count(*) AS total, count(*) FILTER (is_merged) AS merged, {rnd('count(*) FILTER (is_merged)::DOUBLE / count(*) * 100', 4)} AS rate
FROM v_prs GROUP BY month, agent""",
    "i4_filtered_in_steps": "SELECT month, agent, count(*) AS n FROM v_fixes GROUP BY month, agent",
    "i4_steps_with_restart": "SELECT month, agent, count(*) AS n, count(DISTINCT id) AS ids FROM v_fixes GROUP BY month, agent",
    "i3_closed_months": """
WITH a AS (SELECT month, agent, is_merged, created_at, date_trunc('month', created_at) + INTERVAL 1 MONTH AS closes,
             CASE WHEN id % 97 = 0 THEN 3 WHEN created_at < TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS step FROM v_prs),
m AS (SELECT *, CASE step WHEN 2 THEN (SELECT max(created_at) FROM a WHERE step = 1) WHEN 3 THEN (SELECT max(created_at) FROM a WHERE step < 3) END - INTERVAL 10 DAY AS passed FROM a),
k AS (SELECT *, CASE WHEN closes <= passed THEN 'late' WHEN closes <= (SELECT max(created_at) - INTERVAL 10 DAY FROM a) THEN 'closed' END AS kind FROM m)
SELECT kind, month, agent, 1::BIGINT AS given_out, count(*) AS total, count(*) FILTER (is_merged) AS merged FROM k WHERE kind IS NOT NULL GROUP BY kind, month, agent""",
    "i2_corrected_stream": """
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0 OR value >= 1000) AS from_increment, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS changes
FROM events GROUP BY event_type""",
}
