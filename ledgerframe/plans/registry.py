"""Registered queries: one Spark callable per operator of the inventory, each
with an independent DuckDB SQL oracle where the semantics are SQL-expressible.

Every query reads the driver tables (through the fixture views) in full;
parameters such as a ticker or a year are the question being asked, not a
subset taken to make the check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.operators import coverage, derived, metrics, periods, quality, universe
from ledgerframe.plans import fixture_views as fv
from ledgerframe.plans.oracle_views import FLOWS, with_views
from ledgerframe.sources import sinks
from ledgerframe.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Question parameters used across the registered queries.
YEAR, FP = 1998, "FY"
T_A, T_B = "Supplier#000000001", "Supplier#000000003"
SECTOR = ["%nation_1%"]
SECTORS = ["%nation_1%", "%nation_2%"]
FY_LO, FY_HI = fv.FIXTURE_FY_MIN, fv.FIXTURE_FY_MAX


def _v(spark: SparkSession, sf_dir: str):
    """(tables, companies, metrics table); the metrics table is the one the
    ETL wrote (see fixture_views.metrics_table)."""
    from ledgerframe.session import prepare
    prepare(spark)
    t = Tables(spark, sf_dir)
    return t, fv.companies_v(t), fv.metrics_table(spark, sf_dir)


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables alone, for queries that do not read the metrics table."""
    from ledgerframe.session import prepare
    prepare(spark)
    return Tables(spark, sf_dir)


def _merged(t: Tables) -> DataFrame:
    return fv.merged_facts(t, FY_LO, FY_HI)


def _filings(t: Tables) -> DataFrame:
    return derived.extract_filings(_merged(t))


# ============================================================ ETL (E, S)
@register("E1_E2_E6_usable_facts", with_views("SELECT * EXCLUDE (prio) FROM usable_facts"))
def q_usable(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return periods.usable_facts(fv.raw_facts(t), FY_LO, FY_HI)


@register("E7_select_periods", with_views("SELECT * EXCLUDE (prio) FROM selected_facts"))
def q_select(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return periods.select_periods(periods.usable_facts(fv.raw_facts(t), FY_LO, FY_HI))


@register("E8_merge_tags", with_views("SELECT * EXCLUDE (prio) FROM merged_facts"))
def q_merge(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _merged(t)


@register("E10_derive_q4", with_views("SELECT * FROM q4_facts"))
def q_q4(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return periods.derive_q4(_merged(t))


@register("E11_missing_quarters", with_views(f"""
SELECT f.company_id, f.metric, f.fy AS fiscal_year,
       concat_ws(',', CASE WHEN q1.fy IS NULL THEN 'Q1' END, CASE WHEN q2.fy IS NULL THEN 'Q2' END,
                      CASE WHEN q3.fy IS NULL THEN 'Q3' END) AS missing
FROM merged_facts f
LEFT JOIN merged_facts q1 ON q1.company_id = f.company_id AND q1.metric = f.metric AND q1.fy = f.fy AND q1.fp = 'Q1'
LEFT JOIN merged_facts q2 ON q2.company_id = f.company_id AND q2.metric = f.metric AND q2.fy = f.fy AND q2.fp = 'Q2'
LEFT JOIN merged_facts q3 ON q3.company_id = f.company_id AND q3.metric = f.metric AND q3.fy = f.fy AND q3.fp = 'Q3'
WHERE f.fp = 'FY' AND f.metric IN {FLOWS} AND (q1.fy IS NULL OR q2.fy IS NULL OR q3.fy IS NULL)"""))
def q_missing(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return periods.missing_quarters(_merged(t))


@register("E12_financial_metrics", with_views("SELECT * FROM financial_metrics_v"))
def q_fm(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return fv.financial_metrics_v(t)


E9_SQL = with_views("""
SELECT t.company_id, 'total_liabilities' AS metric, t.fiscal_year, t.fiscal_period,
       CAST(t.value - e.value AS DECIMAL(20,4)) AS value, 'USD' AS unit, CAST(NULL AS DATE) AS start_date,
       t.end_date, t.accn
FROM totals t
JOIN equities e ON e.company_id = t.company_id AND e.fiscal_year = t.fiscal_year
               AND e.fiscal_period = t.fiscal_period AND e.end_date = t.end_date
WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.company_id = t.company_id
                  AND x.fiscal_year = t.fiscal_year AND x.fiscal_period = t.fiscal_period)""",
    totals="SELECT * FROM financial_metrics_v WHERE metric = 'total_assets'",
    equities="""SELECT company_id, fiscal_year, fiscal_period, CAST(value * 0.4 AS DECIMAL(20,4)) AS value,
       CASE WHEN accn % 4 = 0 THEN end_date - 1 ELSE end_date END AS end_date
       FROM financial_metrics_v WHERE metric = 'total_assets'""",
    existing="SELECT * FROM financial_metrics_v WHERE metric = 'total_liabilities'")


@register("E9_derive_liabilities", E9_SQL)
def q_liab(spark, sf_dir):
    _, _, fm = _v(spark, sf_dir)
    totals = fm.where(F.col("metric") == "total_assets")
    equities = totals.select(
        "company_id", "fiscal_year", "fiscal_period",
        (F.col("value") * F.lit(0.4).cast("decimal(2,1)")).cast(domain.VALUE_TYPE).alias("value"),
        F.when(F.col("accn") % 4 == 0, F.date_sub("end_date", 1)).otherwise(F.col("end_date")).alias("end_date"))
    existing = fm.where(F.col("metric") == "total_liabilities")
    return derived.derive_liabilities(totals, equities, existing)


@register("E13_extract_filings", with_views("""
SELECT accn, company_id, form, filed, fy AS fiscal_year, fp AS fiscal_period FROM (
  SELECT *, row_number() OVER (PARTITION BY accn ORDER BY
      CASE metric WHEN 'revenue' THEN 0 WHEN 'net_income' THEN 1 WHEN 'total_assets' THEN 2
                  WHEN 'total_liabilities' THEN 3 ELSE 4 END, fy, fp, company_id) AS rn
  FROM merged_facts) x WHERE rn = 1"""))
def q_filings(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _filings(t)


@register("E14_load_summary", with_views("""
SELECT company_id,
  count(*) FILTER (WHERE metric = 'revenue') AS revenue,
  count(*) FILTER (WHERE metric = 'net_income') AS net_income,
  count(*) FILTER (WHERE metric = 'total_assets') AS total_assets,
  count(*) FILTER (WHERE metric = 'total_liabilities') AS total_liabilities,
  count(*) FILTER (WHERE metric = 'eps_diluted') AS eps_diluted,
  count(*) AS total
FROM financial_metrics_v GROUP BY ROLLUP (company_id)"""))
def q_summary(spark, sf_dir):
    return derived.load_summary(_v(spark, sf_dir)[2])


@register("E15_no_usable_facts", with_views("""
SELECT c.company_id, m.metric
FROM companies_v c CROSS JOIN (VALUES ('revenue'), ('net_income'), ('total_assets'),
                                      ('total_liabilities'), ('eps_diluted')) m(metric)
WHERE NOT EXISTS (SELECT 1 FROM financial_metrics_v f WHERE f.company_id = c.company_id
                  AND f.metric = m.metric AND f.fiscal_year = 2000 AND f.fiscal_period = 'FY')"""))
def q_nofacts(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    scoped = fm.where((F.col("fiscal_year") == 2000) & (F.col("fiscal_period") == "FY"))
    return derived.no_usable_facts(co, scoped)


@register("E15_no_facts_at_all", with_views("""
SELECT c.company_id, m.metric
FROM companies_v c CROSS JOIN (VALUES ('revenue'), ('net_income'), ('total_assets'),
                                      ('total_liabilities'), ('eps_diluted')) m(metric)
WHERE NOT EXISTS (SELECT 1 FROM financial_metrics_v f WHERE f.company_id = c.company_id
                  AND f.metric = m.metric)"""))
def q_nofacts_all(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return derived.no_usable_facts(co, fm)


def ticker_map_v(t: Tables) -> DataFrame:
    """Fixture ticker map: rank = s_suppkey, cik = s_nationkey, ticker = s_name."""
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return s.select(F.col("s_suppkey").alias("rank"),
                    F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("cik"),
                    F.upper("s_name").alias("ticker"), F.col("s_name").alias("title"))


@register("E3_top_n_universe", """
SELECT rank, cik, ticker, title FROM (
  SELECT s_suppkey AS rank, lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, upper(s_name) AS ticker,
         s_name AS title, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn
  FROM supplier) x WHERE rn = 1 ORDER BY rank LIMIT 20""")
def q_topn(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return universe.top_n_universe(ticker_map_v(t), 20)


E5_REQUEST = [" supplier#000000001 ", "SUPPLIER#000000005", "supplier#000000007", "NO-SUCH-TICKER", "  "]


@register("E5_resolve_universe", """
WITH req(ticker) AS (SELECT DISTINCT upper(trim(r)) FROM (VALUES (' supplier#000000001 '),
      ('SUPPLIER#000000005'), ('supplier#000000007'), ('NO-SUCH-TICKER'), ('  ')) v(r) WHERE trim(r) <> ''),
m AS (SELECT upper(s_name) AS ticker, lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, s_name AS title,
             row_number() OVER (PARTITION BY upper(s_name) ORDER BY s_suppkey) AS rn FROM supplier)
SELECT req.ticker, m.ticker IS NOT NULL AS found, m.cik, m.title
FROM req LEFT JOIN m ON m.ticker = req.ticker AND m.rn = 1""")
def q_resolve(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return universe.resolve_universe(universe.requested_tickers(spark, E5_REQUEST), ticker_map_v(t))


UPSERT_COLS = ["value", "unit", "accn", "start_date", "end_date"]


@register("S4_upsert", with_views("""
SELECT COALESCE(t.company_id, u.company_id) AS company_id, COALESCE(t.metric, u.metric) AS metric,
       COALESCE(t.fiscal_year, u.fiscal_year) AS fiscal_year,
       COALESCE(t.fiscal_period, u.fiscal_period) AS fiscal_period,
       CASE WHEN u.company_id IS NOT NULL THEN u.value ELSE t.value END AS value,
       CASE WHEN u.company_id IS NOT NULL THEN u.unit ELSE t.unit END AS unit,
       CASE WHEN u.company_id IS NOT NULL THEN u.start_date ELSE t.start_date END AS start_date,
       CASE WHEN u.company_id IS NOT NULL THEN u.end_date ELSE t.end_date END AS end_date,
       CASE WHEN u.company_id IS NOT NULL THEN u.accn ELSE t.accn END AS accn
FROM tgt t FULL OUTER JOIN upd u
  ON t.company_id = u.company_id AND t.metric = u.metric AND t.fiscal_year = u.fiscal_year
 AND t.fiscal_period = u.fiscal_period""",
    tgt="SELECT * FROM financial_metrics_v WHERE fiscal_year <= 1999",
    upd="""SELECT * REPLACE (CAST(value * 1.1 AS DECIMAL(20,4)) AS value)
           FROM financial_metrics_v WHERE fiscal_year >= 1999"""))
def q_upsert(spark, sf_dir):
    _, _, fm = _v(spark, sf_dir)
    target = fm.where(F.col("fiscal_year") <= 1999)
    updates = fm.where(F.col("fiscal_year") >= 1999).withColumn(
        "value", (F.col("value") * F.lit(1.1).cast("decimal(2,1)")).cast(domain.VALUE_TYPE))
    return sinks.upsert(target, updates, ["company_id", "metric", "fiscal_year", "fiscal_period"], UPSERT_COLS)


@register("S6_capped", with_views("""
SELECT *, (SELECT count(*) > 200 FROM financial_metrics_v WHERE metric = 'revenue') AS truncated
FROM financial_metrics_v WHERE metric = 'revenue'
ORDER BY company_id, fiscal_year, fiscal_period LIMIT 200"""))
def q_capped(spark, sf_dir):
    _, _, fm = _v(spark, sf_dir)
    return sinks.capped(fm.where(F.col("metric") == "revenue"), ["company_id", "fiscal_year", "fiscal_period"])


@register("S7_json_safe", with_views("""
SELECT company_id, metric, fiscal_year, fiscal_period, CAST(value AS DOUBLE) AS value, unit,
       strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, accn
FROM financial_metrics_v"""))
def q_json(spark, sf_dir):
    return sinks.json_safe(_v(spark, sf_dir)[2])


# ============================================================ quality (D)
@register("D1_uniqueness", with_views("""
SELECT 'metrics_key' AS rule, count(*) AS violations FROM (
  SELECT company_id, metric, fiscal_year, fiscal_period FROM financial_metrics_v GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'company_id', count(*) FROM (SELECT company_id FROM companies_v GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'ticker', count(*) FROM (SELECT ticker FROM companies_v GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'raw_accession', count(*) FROM (SELECT accn FROM merged_facts GROUP BY ALL HAVING count(*) > 1)"""))
def q_unique(spark, sf_dir):
    t, co, fm = _v(spark, sf_dir)
    report = quality.uniqueness_report({
        "metrics_key": (fm, quality.METRIC_KEY),
        "company_id": (co, ["company_id"]),
        "ticker": (co, ["ticker"]),
    })
    # Facts per accession were counted when the filings were written.
    repeated = fv.filings_table(spark, sf_dir).agg(F.count_if(F.col("n_facts") > 1).alias("violations"))
    return report.unionByName(repeated.select(F.lit("raw_accession").alias("rule"), "violations"))


@register("D2_referential", with_views("""
SELECT 'metrics_company' AS rule, count(*) AS violations FROM financial_metrics_v f
  WHERE f.company_id IS NOT NULL AND f.company_id NOT IN (SELECT company_id FROM companies_v)
UNION ALL SELECT 'metrics_filing', count(*) FROM financial_metrics_v f
  WHERE f.accn IS NOT NULL AND f.accn NOT IN (SELECT accn FROM merged_facts)
UNION ALL SELECT 'filings_company', count(*) FROM (SELECT DISTINCT accn, company_id FROM merged_facts) g
  WHERE g.company_id NOT IN (SELECT company_id FROM companies_v)"""))
def q_refs(spark, sf_dir):
    t, co, fm = _v(spark, sf_dir)
    return quality.referential_report(fm, co, fv.filings_table(spark, sf_dir))


D3_SQL = with_views(f"""
SELECT count(*) FILTER (WHERE metric NOT IN ('revenue','net_income','total_assets','total_liabilities',
                                             'eps_diluted') OR metric IS NULL) AS bad_metric,
  count(*) FILTER (WHERE fiscal_period NOT IN ('FY','Q1','Q2','Q3','Q4') OR fiscal_period IS NULL) AS bad_period,
  count(*) FILTER (WHERE unit NOT IN ('USD','USD/share') OR unit IS NULL) AS bad_unit,
  count(*) FILTER (WHERE unit <> CASE WHEN metric = 'eps_diluted' THEN 'USD/share' ELSE 'USD' END) AS unit_mismatch,
  count(*) FILTER (WHERE metric IN ('total_assets','total_liabilities') AND fiscal_period = 'Q4') AS instant_q4,
  count(*) FILTER (WHERE metric IN ('total_assets','total_liabilities') AND start_date IS NOT NULL)
    AS instant_with_start,
  count(*) FILTER (WHERE value IS NULL OR fiscal_year IS NULL OR end_date IS NULL) AS missing_required,
  count(*) AS rows
FROM financial_metrics_v""")


@register("D3_domain", D3_SQL)
def q_domain(spark, sf_dir):
    return quality.domain_report(_v(spark, sf_dir)[2])


@register("D3_observed_while_writing", D3_SQL)
def q_domain_observed(spark, sf_dir):
    """The same rules, counted in the pass that wrote the metrics table."""
    _tables(spark, sf_dir)
    seen = fv.metrics_observed(spark, sf_dir)
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{c} long" for c in seen))


@register("D4_reconciliation", with_views(f"""
SELECT company_id, metric, fiscal_year, fy_value, quarter_sum, fy_value - quarter_sum AS difference FROM (
  SELECT company_id, metric, fiscal_year,
         sum(value) FILTER (WHERE fiscal_period = 'FY') AS fy_value,
         sum(value) FILTER (WHERE fiscal_period <> 'FY') AS quarter_sum,
         count(*) FILTER (WHERE fiscal_period <> 'FY') AS quarters,
         count(*) FILTER (WHERE fiscal_period = 'FY') AS fy_rows
  FROM financial_metrics_v WHERE metric IN {FLOWS} GROUP BY ALL) x
WHERE quarters = 4 AND fy_rows = 1"""))
def q_recon(spark, sf_dir):
    return quality.reconcile_quarters(_v(spark, sf_dir)[2])


# ============================================================ metric queries (Q)
def _pin_sql(metric, year=YEAR, period=FP, alias="fm"):
    return f"{alias}.metric = '{metric}' AND {alias}.fiscal_year = {year} AND {alias}.fiscal_period = '{period}'"


@register("Q1_lookup_annual", with_views(f"""
SELECT c.ticker, fm.metric, fm.fiscal_year, fm.fiscal_period, fm.value
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE c.ticker = '{T_A}' AND {_pin_sql('revenue')}"""))
def q_q1a(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.lookup_value(fm, co, T_A, "revenue", YEAR, "FY")


@register("Q1_lookup_quarterly", with_views(f"""
SELECT c.ticker, fm.metric, fm.fiscal_year, fm.fiscal_period, fm.value
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE c.ticker = '{T_A}' AND {_pin_sql('net_income', YEAR, 'Q2')}"""))
def q_q1q(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.lookup_value(fm, co, T_A, "net_income", YEAR, "Q2")


@register("Q2_name_ilike", with_views("""
SELECT company_id, ticker, name, sic_description FROM companies_v WHERE name ILIKE '%plier#00000000%'"""))
def q_q2(spark, sf_dir):
    co = fv.companies_v(_tables(spark, sf_dir))
    return metrics.companies_like(co, "%plier#00000000%")


@register("Q3_net_loss", with_views(f"""
SELECT c.ticker, fm.fiscal_year, fm.fiscal_period, fm.value
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE {_pin_sql('net_income', YEAR, 'Q4')} AND fm.value < 0"""))
def q_q3(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.threshold_filter(fm, co, "net_income", YEAR, "Q4", "<", 0)


@register("Q3_threshold", with_views(f"""
SELECT c.ticker, fm.fiscal_year, fm.fiscal_period, fm.value
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE {_pin_sql('revenue')} AND fm.value > 100000"""))
def q_q3b(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.threshold_filter(fm, co, "revenue", YEAR, "FY", ">", 100000)


@register("Q4_end_date_window", with_views("""
SELECT c.ticker, fm.fiscal_year, fm.fiscal_period, fm.end_date, fm.value
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE fm.metric = 'revenue' AND fm.end_date BETWEEN DATE '1998-06-01' AND DATE '1998-07-31'"""))
def q_q4w(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.end_date_window(fm, co, "revenue", "1998-06-01", "1998-07-31")


@register("Q5_scaled", with_views(f"""
SELECT c.ticker, ROUND(CAST(fm.value AS DOUBLE) / 1000.0, 6) AS value_scaled
FROM financial_metrics_v fm JOIN companies_v c USING (company_id) WHERE {_pin_sql('revenue')}"""))
def q_q5(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.scaled(fm, co, "revenue", YEAR, "FY", scale=1e3)


@register("Q6_quarterly_series", with_views(f"""
SELECT fm.fiscal_period, fm.value, fm.end_date
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE c.ticker = '{T_A}' AND fm.metric = 'net_income' AND fm.fiscal_year = {YEAR}
  AND fm.fiscal_period IN ('Q1','Q2','Q3','Q4') ORDER BY fm.fiscal_period"""))
def q_q6(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.quarterly_series(fm, co, T_A, "net_income", YEAR)


FILINGS_CTE = """SELECT accn, company_id, form, filed FROM (
  SELECT *, row_number() OVER (PARTITION BY accn ORDER BY
      CASE metric WHEN 'revenue' THEN 0 WHEN 'net_income' THEN 1 WHEN 'total_assets' THEN 2
                  WHEN 'total_liabilities' THEN 3 ELSE 4 END, fy, fp, company_id) AS rn
  FROM merged_facts) x WHERE rn = 1"""


@register("Q7_provenance", with_views(f"""
SELECT fm.company_id, fm.metric, fm.fiscal_year, fm.fiscal_period, fm.value, f.form, f.filed AS filed_date, fm.accn
FROM financial_metrics_v fm LEFT JOIN filings f ON f.accn = fm.accn
WHERE {_pin_sql('revenue', YEAR, 'Q4')} OR {_pin_sql('net_income')}""", filings=FILINGS_CTE))
def q_q7(spark, sf_dir):
    t, _, fm = _v(spark, sf_dir)
    rows = fm.where((F.col("metric") == "revenue") & (F.col("fiscal_year") == YEAR) & (F.col("fiscal_period") == "Q4")
                    | (F.col("metric") == "net_income") & (F.col("fiscal_year") == YEAR)
                    & (F.col("fiscal_period") == "FY"))
    return metrics.with_provenance(rows, fv.filings_table(spark, sf_dir), "left")


@register("Q8_compare_companies", with_views(f"""
SELECT c.ticker, c.name, fm.value AS revenue
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE c.ticker IN ('{T_A}', '{T_B}') AND {_pin_sql('revenue')}"""))
def q_q8(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.compare_companies(fm, co, [T_A, T_B], "revenue", YEAR)


@register("Q9_in_subquery", with_views(f"""
SELECT company_id, ticker FROM companies_v WHERE company_id IN (
  SELECT company_id FROM financial_metrics_v fm WHERE {_pin_sql('revenue')} AND fm.value > 100000)"""))
def q_q9(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.members_with(co, fm, "revenue", YEAR, "FY", 100000)


# ============================================================ joins (J)
@register("J1_ratio_self_join", with_views(f"""
SELECT c.ticker, n.fiscal_year, n.fiscal_period,
       ROUND(CAST(n.value AS DOUBLE) / NULLIF(CAST(d.value AS DOUBLE), 0), 6) AS net_margin
FROM financial_metrics_v n
JOIN financial_metrics_v d ON d.company_id = n.company_id AND d.fiscal_year = n.fiscal_year
 AND d.fiscal_period = n.fiscal_period AND d.metric = 'revenue'
JOIN companies_v c ON c.company_id = n.company_id
WHERE {_pin_sql('net_income', alias='n')}"""))
def q_j1(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.ratio_by_join(fm, co, "net_income", "revenue", YEAR, "FY", name="net_margin")


GROWTH_SQL = "(CAST(cur.value AS DOUBLE) - CAST(prev.value AS DOUBLE)) / NULLIF(CAST(prev.value AS DOUBLE), 0) * 100.0"


GROWTH_JOIN = """FROM financial_metrics_v cur
JOIN financial_metrics_v prev ON prev.company_id = cur.company_id AND prev.metric = cur.metric
 AND prev.fiscal_period = cur.fiscal_period AND prev.fiscal_year = cur.fiscal_year - {back}
JOIN companies_v c ON c.company_id = cur.company_id"""


@register("J2_yoy_growth", with_views(f"""
SELECT c.ticker, cur.value AS current_value, prev.value AS prior_value,
       ROUND({GROWTH_SQL}, 6) AS yoy_growth_pct
{GROWTH_JOIN.format(back=1)}
WHERE {_pin_sql('revenue', alias='cur')}"""))
def q_j2(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.yoy_growth(fm, co, "revenue", YEAR)


@register("J3_two_year_difference", with_views(f"""
SELECT c.ticker, cur.value - prev.value AS difference
{GROWTH_JOIN.format(back=3)}
WHERE {_pin_sql('revenue', 2000, 'FY', alias='cur')}"""))
def q_j3(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.year_difference(fm, co, "revenue", 2000, 3)


@register("J4_sector_growth", with_views(f"""
SELECT c.ticker, c.name, ROUND({GROWTH_SQL}, 1) AS growth_pct
{GROWTH_JOIN.format(back=1)}
WHERE {_pin_sql('revenue', alias='cur')} AND c.sic_description ILIKE '%nation_1%'"""))
def q_j4(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.sector_growth(fm, co, SECTOR, "revenue", YEAR)


@register("J5_sector_filter", with_views("""
SELECT company_id, ticker, sic_description FROM companies_v
WHERE sic_description ILIKE '%nation_1%' OR sic_description ILIKE '%nation_2%'"""))
def q_j5(spark, sf_dir):
    co = fv.companies_v(_tables(spark, sf_dir))
    return metrics.sector_members(co, SECTORS)


# ============================================================ aggregations (A)
def _ratio_sql(num: str, den: str, name: str, guard: bool, year=YEAR, period=FP, order: str = "") -> str:
    having = "WHERE num IS NOT NULL AND den > 0" if guard else ""
    return with_views(f"""
SELECT c.ticker,
  ROUND(CAST(num AS DOUBLE) / NULLIF(CAST(den AS DOUBLE), 0), 6) AS {name},
  ROUND(CAST(num AS DOUBLE) / NULLIF(CAST(den AS DOUBLE), 0) * 100.0, 4) AS {name}_pct
FROM (SELECT company_id, SUM(value) FILTER (WHERE metric = '{num}') AS num,
             SUM(value) FILTER (WHERE metric = '{den}') AS den
      FROM financial_metrics_v WHERE metric IN ('{num}', '{den}') AND fiscal_year = {year}
        AND fiscal_period = '{period}' GROUP BY company_id) a
JOIN companies_v c USING (company_id) {having} {order}""")


@register("A1_net_margin", _ratio_sql("net_income", "revenue", "net_margin", guard=False))
def q_a1(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.ratio(fm, co, "net_income", "revenue", YEAR, "FY", name="net_margin", guard=False)


@register("A2_debt_ratio", _ratio_sql("total_liabilities", "total_assets", "debt_ratio", guard=True))
def q_a2(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.ratio(fm, co, "total_liabilities", "total_assets", YEAR, "FY", name="debt_ratio")


@register("A3_return_on_assets", _ratio_sql("net_income", "total_assets", "roa", guard=True))
def q_a3(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.ratio(fm, co, "net_income", "total_assets", YEAR, "FY", name="roa")


@register("A4_shareholders_equity", with_views(f"""
SELECT c.ticker, a.shareholders_equity FROM (
  SELECT company_id, SUM(value) FILTER (WHERE metric = 'total_assets')
                   - SUM(value) FILTER (WHERE metric = 'total_liabilities') AS shareholders_equity
  FROM financial_metrics_v WHERE metric IN ('total_assets', 'total_liabilities')
    AND fiscal_year = {YEAR} AND fiscal_period = 'FY' GROUP BY company_id) a
JOIN companies_v c USING (company_id)"""))
def q_a4(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.equity(fm, co, YEAR)


@register("A5_side_by_side", with_views(f"""
SELECT c.ticker, a.revenue, a.net_income, a.total_assets FROM (
  SELECT company_id, SUM(value) FILTER (WHERE metric = 'revenue') AS revenue,
         SUM(value) FILTER (WHERE metric = 'net_income') AS net_income,
         SUM(value) FILTER (WHERE metric = 'total_assets') AS total_assets
  FROM financial_metrics_v WHERE metric IN ('revenue', 'net_income', 'total_assets')
    AND fiscal_year = {YEAR} AND fiscal_period = 'FY' GROUP BY company_id) a
JOIN companies_v c USING (company_id)"""))
def q_a5(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.side_by_side(fm, co, ["revenue", "net_income", "total_assets"], YEAR)


@register("A6_sector_total", with_views(f"""
SELECT SUM(fm.value) AS sector_total, count(*) AS companies
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE {_pin_sql('revenue')} AND c.sic_description ILIKE '%nation_1%'"""))
def q_a6(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.sector_total(fm, co, SECTOR, "revenue", YEAR)


@register("A7_guarded_top_margin", _ratio_sql("net_income", "revenue", "net_margin", guard=True,
                                               order="ORDER BY CAST(num AS DOUBLE) / NULLIF(CAST(den AS DOUBLE), 0) DESC NULLS LAST, c.ticker LIMIT 1"))
def q_a7(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.top_ratio(fm, co, "net_income", "revenue", YEAR, "FY", n=1, name="net_margin")


@register("A8_ttm", with_views("""
SELECT c.ticker, a.ttm_value, a.quarters, a.through FROM (
  SELECT company_id, SUM(value) AS ttm_value, count(*) AS quarters, max(end_date) AS through FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id
                                 ORDER BY end_date DESC, fiscal_year DESC, fiscal_period DESC) AS rn
    FROM financial_metrics_v WHERE metric = 'revenue' AND fiscal_period IN ('Q1','Q2','Q3','Q4')) q
  WHERE rn <= 4 GROUP BY company_id) a
JOIN companies_v c USING (company_id)"""))
def q_a8(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.ttm(fm, co, "revenue")


def _wide_fm(t: Tables) -> DataFrame:
    return fv.metrics_table(t.spark, t.sf_dir, fv.FIXTURE_WIDE_FY_MIN, fv.FIXTURE_WIDE_FY_MAX)


def _wide_sql(body: str) -> str:
    return with_views(body, fy_min=fv.FIXTURE_WIDE_FY_MIN, fy_max=fv.FIXTURE_WIDE_FY_MAX)


@register("A9_coverage_stats", _wide_sql("""
SELECT (SELECT count(*) FROM companies_v) AS n_companies,
       (SELECT count(DISTINCT sic_description) FROM companies_v) AS n_industries,
       min(fiscal_year) AS year_min, max(fiscal_year) AS year_max, count(*) AS n_rows
FROM financial_metrics_v"""))
def q_a9(spark, sf_dir):
    t = _tables(spark, sf_dir)
    co = fv.companies_v(t)
    return coverage.coverage_stats(_wide_fm(t), co)


@register("A10_latest_fy_companies", _wide_sql("""
SELECT count(DISTINCT company_id) AS n_with_fy_latest FROM financial_metrics_v
WHERE fiscal_period = 'FY' AND metric = 'revenue'
  AND fiscal_year = (SELECT max(fiscal_year) FROM financial_metrics_v)"""))
def q_a10(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return coverage.companies_with_latest_fy(_wide_fm(t), metric="revenue")


@register("A11_broad_coverage", with_views("""
SELECT (SELECT max(n) FROM per_year) AS peak_fy_companies,
       COALESCE((SELECT max(fiscal_year) FROM per_year f
                 WHERE f.n >= (SELECT max(n) FROM per_year) * 0.8),
                (SELECT max(fiscal_year) FROM financial_metrics_v)) AS last_broad_year""",
    fy_min=fv.FIXTURE_WIDE_FY_MIN, fy_max=fv.FIXTURE_WIDE_FY_MAX,
    per_year="""SELECT fiscal_year, count(DISTINCT company_id) AS n FROM financial_metrics_v
                WHERE fiscal_period = 'FY' AND metric = 'revenue' GROUP BY fiscal_year"""))
def q_a11(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return coverage.broad_coverage(_wide_fm(t), threshold=0.8, metric="revenue")


@register("A10_latest_fy_any_metric", _wide_sql("""
SELECT count(DISTINCT company_id) AS n_with_fy_latest FROM financial_metrics_v
WHERE fiscal_period = 'FY' AND fiscal_year = (SELECT max(fiscal_year) FROM financial_metrics_v)"""))
def q_a10_any(spark, sf_dir):
    return coverage.companies_with_latest_fy(_wide_fm(_tables(spark, sf_dir)))


@register("A11_broad_coverage_any_metric", with_views("""
SELECT (SELECT max(n) FROM per_year) AS peak_fy_companies,
       COALESCE((SELECT max(fiscal_year) FROM per_year f
                 WHERE f.n >= (SELECT max(n) FROM per_year) * 0.5),
                (SELECT max(fiscal_year) FROM financial_metrics_v)) AS last_broad_year""",
    fy_min=fv.FIXTURE_WIDE_FY_MIN, fy_max=fv.FIXTURE_WIDE_FY_MAX,
    per_year="""SELECT fiscal_year, count(DISTINCT company_id) AS n FROM financial_metrics_v
                WHERE fiscal_period = 'FY' GROUP BY fiscal_year"""))
def q_a11_any(spark, sf_dir):
    return coverage.broad_coverage(_wide_fm(_tables(spark, sf_dir)))


def _a12_sql(scope: str, threshold: float) -> str:
    return with_views(f"""
SELECT 'glossary' AS doc_type, 'what is loaded: companies and fiscal years' AS title,
  printf('What is loaded, counted in the tables:' || chr(10)
      || '* %d companies in %d industries, %d metric rows' || chr(10)
      || '* fiscal years %d to %d; nothing outside them can be answered' || chr(10)
      || '* annual rows for %d: %d of %d companies so far' || chr(10)
      || '* latest year that most companies have closed: %d',
      n_companies, n_industries, n_rows, year_min, year_max, year_max, n_latest, n_companies, last_broad) AS content
FROM (SELECT (SELECT count(*) FROM companies_v) AS n_companies,
             (SELECT count(DISTINCT sic_description) FROM companies_v) AS n_industries,
             min(fiscal_year) AS year_min, max(fiscal_year) AS year_max, count(*) AS n_rows,
             (SELECT count(DISTINCT company_id) FROM financial_metrics_v WHERE fiscal_period = 'FY' {scope}
                AND fiscal_year = (SELECT max(fiscal_year) FROM financial_metrics_v)) AS n_latest,
             COALESCE((SELECT max(fiscal_year) FROM per_year f
                       WHERE f.n >= (SELECT max(n) FROM per_year) * {threshold}),
                      (SELECT max(fiscal_year) FROM financial_metrics_v)) AS last_broad
      FROM financial_metrics_v) s""",
        fy_min=fv.FIXTURE_WIDE_FY_MIN, fy_max=fv.FIXTURE_WIDE_FY_MAX,
        per_year=f"""SELECT fiscal_year, count(DISTINCT company_id) AS n FROM financial_metrics_v
                    WHERE fiscal_period = 'FY' {scope} GROUP BY fiscal_year""")


@register("A12_coverage_document", _a12_sql("", 0.5))
def q_a12(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return coverage.coverage_document(_wide_fm(t), fv.companies_v(t))


@register("A12_coverage_of_metric", _a12_sql("AND metric = 'revenue'", 0.8))
def q_a12m(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return coverage.coverage_document(_wide_fm(t), fv.companies_v(t), threshold=0.8, metric="revenue")


# ============================================================ windows, top-k, sets (W)
@register("W1_qoq_growth", with_views("""
SELECT c.ticker, fm.fiscal_year, fm.fiscal_period, fm.end_date, fm.value,
  ROUND((CAST(fm.value AS DOUBLE) - CAST(LAG(fm.value) OVER w AS DOUBLE))
        / NULLIF(CAST(LAG(fm.value) OVER w AS DOUBLE), 0) * 100.0, 6) AS qoq_growth_pct
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE fm.metric = 'revenue' AND fm.fiscal_period IN ('Q1','Q2','Q3','Q4') AND fm.fiscal_year IN (1998, 1999)
WINDOW w AS (PARTITION BY fm.company_id, fm.metric ORDER BY fm.end_date, fm.fiscal_year, fm.fiscal_period)"""))
def q_w1(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.qoq_growth(fm, co, "revenue", fiscal_years=[1998, 1999])


@register("W2_top_revenue", with_views(f"""
SELECT c.name, c.ticker, fm.value AS revenue
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE {_pin_sql('revenue')} ORDER BY revenue DESC NULLS LAST, c.ticker LIMIT 3"""))
def q_w2(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.top_values(fm, co, "revenue", YEAR, "FY", n=3, highest=True)


@register("W2_lowest_net_income", with_views(f"""
SELECT c.name, c.ticker, fm.value AS net_income
FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE {_pin_sql('net_income')} ORDER BY net_income ASC NULLS LAST, c.ticker LIMIT 1"""))
def q_w2b(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.top_values(fm, co, "net_income", YEAR, "FY", n=1, highest=False)


@register("W3_fastest_growing", with_views(f"""
SELECT c.ticker, cur.value AS current_value, prev.value AS prior_value,
       ROUND({GROWTH_SQL}, 6) AS yoy_growth_pct
{GROWTH_JOIN.format(back=1)}
WHERE {_pin_sql('revenue', alias='cur')} AND prev.value > 0
ORDER BY {GROWTH_SQL} DESC NULLS LAST, c.ticker LIMIT 3"""))
def q_w3(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.fastest_growing(fm, co, "revenue", YEAR, n=3)


@register("W3_most_leveraged", _ratio_sql("total_liabilities", "total_assets", "debt_ratio", guard=True,
                                           order="ORDER BY CAST(num AS DOUBLE) / NULLIF(CAST(den AS DOUBLE), 0) DESC NULLS LAST, c.ticker LIMIT 1"))
def q_w3b(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.top_ratio(fm, co, "total_liabilities", "total_assets", YEAR, "FY", n=1, name="debt_ratio")


@register("W4_latest_fy_row", with_views("""
SELECT c.ticker, x.fiscal_year, x.value FROM (
  SELECT company_id, fiscal_year, value,
         row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS rn
  FROM financial_metrics_v WHERE metric = 'revenue' AND fiscal_period = 'FY') x
JOIN companies_v c USING (company_id) WHERE rn = 1"""))
def q_w4(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.latest_fy_rows(fm, co, "revenue")


@register("W5_latest_year", with_views("SELECT max(fiscal_year) AS latest_year FROM financial_metrics_v"))
def q_w5(spark, sf_dir):
    return metrics.latest_year(_v(spark, sf_dir)[2])


@register("W5_rows_in_latest_year", with_views("""
SELECT c.ticker, fm.fiscal_year, fm.value FROM financial_metrics_v fm JOIN companies_v c USING (company_id)
WHERE fm.metric = 'net_income' AND fm.fiscal_period = 'FY'
  AND fm.fiscal_year = (SELECT max(fiscal_year) FROM financial_metrics_v)"""))
def q_w5b(spark, sf_dir):
    _, co, fm = _v(spark, sf_dir)
    return metrics.rows_in_latest_year(fm, co, "net_income")


def _set_inputs(fm: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = fm.where((F.col("metric") == "revenue") & (F.col("fiscal_year") == YEAR)
                 & (F.col("fiscal_period") == "FY") & (F.col("value") > 100000)).select("company_id")
    b = fm.where((F.col("metric") == "net_income") & (F.col("fiscal_year") == YEAR)
                 & (F.col("fiscal_period") == "FY") & (F.col("value") > 100000)).select("company_id")
    return a, b


SET_A = f"SELECT company_id FROM financial_metrics_v fm WHERE {_pin_sql('revenue')} AND value > 100000"
SET_B = f"SELECT company_id FROM financial_metrics_v fm WHERE {_pin_sql('net_income')} AND value > 100000"

for _op, _kw in [("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")]:
    def _mk(op):
        def q(spark, sf_dir):
            a, b = _set_inputs(_v(spark, sf_dir)[2])
            return metrics.set_op(a, b, op)
        return q
    register(f"W6_{_op}", with_views(f"{SET_A} {_kw} {SET_B}"))(_mk(_op))


def all_queries() -> dict[str, QueryFn]:
    _load_modules()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_modules()
    return dict(ORACLE)


def _load_modules() -> None:
    """Registrations that live in other modules (imported for their side effect)."""
    import importlib
    for mod in EXTRA_MODULES:
        importlib.import_module(mod)


EXTRA_MODULES: list[str] = ["ledgerframe.plans.registry_events", "ledgerframe.plans.registry_questions"]
