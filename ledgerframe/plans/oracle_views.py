"""The fixture views of FIXTURES.md §3 as plain SQL, for the DuckDB oracle.

These are deliberately written the textbook way (row_number windows,
self-joins) rather than the way the Spark jobs run, so the oracle is an
independent statement of the same semantics.
"""

from __future__ import annotations

FLOWS = "('revenue', 'net_income', 'eps_diluted')"

VIEW_CTES = {
    "companies_v": """
  SELECT s_suppkey AS company_id, s_name AS ticker, s_name AS name, n_name AS sic_description
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "raw_facts": """
  SELECT l_suppkey AS company_id,
    CASE p_size % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'net_income' WHEN 2 THEN 'total_assets'
                    WHEN 3 THEN 'total_liabilities' ELSE 'eps_diluted' END AS metric,
    l_returnflag AS tag,
    CAST(year(l_shipdate) AS INT) AS fy,
    CASE quarter(l_shipdate) WHEN 4 THEN 'FY' ELSE 'Q' || quarter(l_shipdate) END AS fp,
    CASE WHEN o_orderpriority LIKE '5%' THEN '8-K'
         ELSE (CASE quarter(l_shipdate) WHEN 4 THEN '10-K' ELSE '10-Q' END)
              || (CASE WHEN o_orderpriority LIKE '1%' THEN '/A' ELSE '' END) END AS form,
    CAST(l_shipdate AS DATE) - CAST(CASE quarter(l_shipdate) WHEN 4 THEN 320 ELSE 60 END
                            + l_quantity AS INT) AS start_date,
    CAST(l_shipdate AS DATE) AS end_date,
    CAST(l_shipdate AS DATE) + 30 + l_linenumber AS filed,
    l_orderkey * 10 + l_linenumber AS accn,
    CAST(CASE WHEN p_size % 5 = 4 THEN l_quantity ELSE l_extendedprice END AS DECIMAL(20,4)) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "usable_facts": f"""
  SELECT * FROM (
    SELECT company_id, metric, tag, fy, fp, trim(split_part(form, '/', 1)) AS form,
           start_date, end_date, filed, accn, val,
           CASE tag WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS prio
    FROM raw_facts) r
  WHERE form IN ('10-K', '10-Q') AND fy BETWEEN {{fy_min}} AND {{fy_max}}
    AND form IS NOT NULL AND fy IS NOT NULL AND fp IS NOT NULL AND end_date IS NOT NULL
    AND filed IS NOT NULL AND val IS NOT NULL
    AND CASE WHEN metric IN {FLOWS} THEN start_date IS NOT NULL AND (
               (fp = 'FY' AND form = '10-K' AND datediff('day', start_date, end_date) BETWEEN 330 AND 380)
            OR (fp IN ('Q1','Q2','Q3') AND form = '10-Q'
                AND datediff('day', start_date, end_date) BETWEEN 70 AND 100))
        ELSE (fp = 'FY' AND form = '10-K') OR (fp IN ('Q1','Q2','Q3') AND form = '10-Q') END""",
    "selected_facts": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, metric, tag, fy, fp
                                 ORDER BY end_date DESC, filed DESC, accn, val) AS rn
    FROM usable_facts) s WHERE rn = 1""",
    "merged_facts": """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, metric, fy, fp ORDER BY prio) AS rn
    FROM selected_facts) m WHERE rn = 1""",
    "q4_facts": f"""
  SELECT f.company_id, f.metric, f.fy, 'Q4' AS fp,
         CAST(f.val - (q1.val + q2.val + q3.val) AS DECIMAL(20,4)) AS val,
         q3.end_date + 1 AS start_date, f.end_date, f.accn, f.form, f.filed
  FROM merged_facts f
  JOIN merged_facts q1 ON q1.company_id = f.company_id AND q1.metric = f.metric AND q1.fy = f.fy AND q1.fp = 'Q1'
  JOIN merged_facts q2 ON q2.company_id = f.company_id AND q2.metric = f.metric AND q2.fy = f.fy AND q2.fp = 'Q2'
  JOIN merged_facts q3 ON q3.company_id = f.company_id AND q3.metric = f.metric AND q3.fy = f.fy AND q3.fp = 'Q3'
  WHERE f.fp = 'FY' AND f.metric IN {FLOWS}""",
    "financial_metrics_v": f"""
  SELECT company_id, metric, fy AS fiscal_year, fp AS fiscal_period, CAST(val AS DECIMAL(20,4)) AS value,
         CASE WHEN metric = 'eps_diluted' THEN 'USD/share' ELSE 'USD' END AS unit,
         CASE WHEN metric IN {FLOWS} THEN start_date END AS start_date, end_date, accn
  FROM merged_facts
  UNION ALL
  SELECT company_id, metric, fy, fp, val,
         CASE WHEN metric = 'eps_diluted' THEN 'USD/share' ELSE 'USD' END, start_date, end_date, accn
  FROM q4_facts""",
    "attempt_log_v": """
  SELECT printf('%d-%s-%d', user_id, strftime(ts, '%Y-%m-%d'), place // 3) AS request_id, user_id, event_id, ts,
         CAST(place % 3 + 1 AS INTEGER) AS attempt_number,
         outcome, CASE WHEN outcome <> 'success' THEN props END AS error_message,
         CAST(round(value * 100) AS BIGINT) AS duration_ms,
         CASE WHEN user_id % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS place,
               CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'execution_error'
                 WHEN 'view' THEN 'empty_result' WHEN 'click' THEN 'guard_rejected'
                 WHEN 'signup' THEN 'unanswerable' END AS outcome
        FROM events) e""",
}


def with_views(body: str, fy_min: int = 1996, fy_max: int = 2000, **extra_ctes: str) -> str:
    """Prefix ``body`` with the view CTEs (and any extra named CTEs)."""
    parts = []
    for name, sql in {**VIEW_CTES, **extra_ctes}.items():
        parts.append(f"{name} AS ({sql.replace('{fy_min}', str(fy_min)).replace('{fy_max}', str(fy_max))}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body
