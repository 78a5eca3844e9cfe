"""Registered queries for the templated question batch: linking (N2),
answering (N3), outcome classification (N4), row-set match (V1), verdicts
(V3), scoreboard and gate over the questions (V4, V5).

The batch is derived from the companies table by Spark (so it grows with
it); the item set keeps the questions whose reference answer - computed from
the parameters the question was generated from - has rows, plus the questions
that are expected to fail, as a golden set would."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.operators import evaluate, questions
from ledgerframe.plans import fixture_views as fv
from ledgerframe.plans.oracle_views import with_views
from ledgerframe.plans.registry import register
from ledgerframe.session import checkpoint_dir, prepare
from ledgerframe.sources.tables import Tables

YEARS = list(range(fv.FIXTURE_FY_MIN, fv.FIXTURE_FY_MAX + 1))
OUT_OF_RANGE_YEAR = 1990


# The reference answer of a question from the parameters it was generated from, in SQL that Spark
# and DuckDB both read: {truth}, {facts} (company_id, metric, fiscal_year, fiscal_period, v) and
# {labels} (company_id, ticker, sector_key) are put in.
REFERENCE_SQL = """
WITH n AS (
  SELECT item_id, intent, metric, num_metric, den_metric, year_from, fiscal_year, fiscal_period, company_id AS cid
  FROM {truth} WHERE company_id IS NOT NULL
  UNION ALL
  SELECT item_id, intent, metric, num_metric, den_metric, year_from, fiscal_year, fiscal_period, company2_id
  FROM {truth} WHERE company2_id IS NOT NULL),
said AS (
  SELECT n.item_id, n.intent, l.ticker, f.v
  FROM n JOIN {facts} f ON f.company_id = n.cid AND f.metric = n.metric AND f.fiscal_year = n.fiscal_year
                       AND f.fiscal_period = n.fiscal_period
  JOIN {labels} l ON l.company_id = n.cid WHERE n.intent IN ('lookup', 'comparison', 'combined')),
moved AS (
  SELECT n.item_id, n.intent, l.ticker, cur.v AS now, old.v AS was
  FROM n JOIN {facts} cur ON cur.company_id = n.cid AND cur.metric = n.metric AND cur.fiscal_year = n.fiscal_year
                         AND cur.fiscal_period = n.fiscal_period
  JOIN {facts} old ON old.company_id = n.cid AND old.metric = n.metric AND old.fiscal_period = n.fiscal_period
    AND old.fiscal_year = CASE WHEN n.intent = 'growth' AND n.year_from = n.fiscal_year THEN n.fiscal_year - 1
                               ELSE n.year_from END
  JOIN {labels} l ON l.company_id = n.cid WHERE n.intent IN ('growth', 'difference')),
ranked AS (
  SELECT t.item_id, l.ticker, f.v AS k, t.direction, t.top_n
  FROM {truth} t JOIN {facts} f ON f.metric = t.metric AND f.fiscal_year = t.fiscal_year
                               AND f.fiscal_period = t.fiscal_period
  JOIN {labels} l ON l.company_id = f.company_id WHERE t.intent = 'superlative' AND t.metric IS NOT NULL
  UNION ALL
  SELECT t.item_id, l.ticker, a.v / b.v, t.direction, t.top_n
  FROM {truth} t JOIN {facts} a ON a.metric = t.num_metric AND a.fiscal_year = t.fiscal_year
                               AND a.fiscal_period = t.fiscal_period
  JOIN {facts} b ON b.company_id = a.company_id AND b.metric = t.den_metric AND b.fiscal_year = t.fiscal_year
                AND b.fiscal_period = t.fiscal_period
  JOIN {labels} l ON l.company_id = a.company_id WHERE t.intent = 'superlative' AND b.v > 0
  UNION ALL
  SELECT t.item_id, l.ticker, (a.v - b.v) / b.v * 100, t.direction, t.top_n
  FROM {truth} t JOIN {facts} a ON a.metric = t.metric AND a.fiscal_year = t.fiscal_year
                               AND a.fiscal_period = t.fiscal_period
  JOIN {facts} b ON b.company_id = a.company_id AND b.metric = t.metric AND b.fiscal_year = t.fiscal_year - 1
                AND b.fiscal_period = t.fiscal_period
  JOIN {labels} l ON l.company_id = a.company_id WHERE t.intent = 'growth_rank' AND b.v > 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN direction = 'asc' THEN k ELSE -k END, ticker) AS place
  FROM ranked WHERE k IS NOT NULL),
closed AS (
  SELECT n.item_id, l.ticker, f.v, row_number() OVER (PARTITION BY n.item_id, n.cid ORDER BY f.fiscal_year DESC) AS rn
  FROM n JOIN {facts} f ON f.company_id = n.cid AND f.metric = n.metric AND f.fiscal_period = 'FY'
  JOIN {labels} l ON l.company_id = n.cid WHERE n.intent = 'latest')
SELECT item_id, ticker AS label, v AS value FROM said WHERE intent <> 'combined'
UNION ALL SELECT item_id, 'combined', SUM(v) FROM said WHERE intent = 'combined' GROUP BY item_id
UNION ALL
SELECT n.item_id, l.ticker, SUM(CASE WHEN f.metric = n.num_metric THEN f.v END)
                            / NULLIF(SUM(CASE WHEN f.metric = n.den_metric THEN f.v END), 0)
FROM n JOIN {facts} f ON f.company_id = n.cid AND f.fiscal_year = n.fiscal_year AND f.fiscal_period = n.fiscal_period
                     AND f.metric IN (n.num_metric, n.den_metric)
JOIN {labels} l ON l.company_id = n.cid WHERE n.intent = 'ratio' GROUP BY n.item_id, n.cid, l.ticker
UNION ALL SELECT item_id, ticker, (now - was) / NULLIF(was, 0) * 100 FROM moved WHERE intent = 'growth'
UNION ALL SELECT item_id, ticker, now - was FROM moved WHERE intent = 'difference'
UNION ALL SELECT item_id, ticker, k FROM placed WHERE place <= top_n
UNION ALL SELECT item_id, ticker, v FROM closed WHERE rn = 1
UNION ALL
SELECT t.item_id, t.sector, SUM(f.v)
FROM {truth} t JOIN {labels} l ON l.sector_key = t.sector
JOIN {facts} f ON f.company_id = l.company_id AND f.metric = t.metric AND f.fiscal_year = t.fiscal_year
              AND f.fiscal_period = t.fiscal_period
WHERE t.intent = 'sector_total' GROUP BY t.item_id, t.sector"""


class QA:
    """The frames of one evaluation run, each built on first use."""

    def __init__(self, spark, sf_dir):
        prepare(spark)
        checkpoint_dir(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.co = fv.companies_v(Tables(spark, sf_dir))

    @cached_property
    def fm(self) -> DataFrame:
        return fv.metrics_table(self.spark, self.sf_dir)  # written once by the ETL

    @cached_property
    def batch(self) -> DataFrame:
        return questions.question_batch(self.co, YEARS, OUT_OF_RANGE_YEAR)

    @cached_property
    def linked(self) -> DataFrame:
        return questions.link_entities(self.batch.select("item_id", "question"), self.co)

    @cached_property
    def _linked_cut(self) -> DataFrame:
        # The batch and its links feed a dozen branches each; a reliable
        # checkpoint in the shared checkpoint folder cuts their lineage, so
        # planning stays small and a lost executor does not recompute them.
        return self.linked.checkpoint()

    @cached_property
    def _batch_cut(self) -> DataFrame:
        return self.batch.checkpoint()

    @cached_property
    def answers(self) -> DataFrame:
        # Read by outcomes and matches, each several times.
        return questions.answer_batch(self._linked_cut, self.fm, self.co).checkpoint()

    @cached_property
    def outcomes(self) -> DataFrame:
        ymin = self.fm.agg(F.min("fiscal_year")).scalar()
        ymax = self.fm.agg(F.max("fiscal_year")).scalar()
        return questions.classify_outcomes(self._linked_cut, self.answers, ymin, ymax)

    @cached_property
    def expected(self) -> DataFrame:
        """The reference answers: SQL over the metrics table, apart from the routing that is tested."""
        truth = self._batch_cut.where(~F.col("expect_failure")).select("item_id", *questions.TRUTH_COLS)
        facts = questions.read_by(self.fm, truth).select("company_id", "metric", "fiscal_year", "fiscal_period", F.col("value").cast("double").alias("v"))
        labels = self.co.select("company_id", "ticker", F.lower("sic_description").alias("sector_key"))
        return self.spark.sql(REFERENCE_SQL, truth=truth, facts=facts, labels=labels).checkpoint()

    @cached_property
    def items(self) -> DataFrame:
        # Every item stays; one whose reference has no rows is a reference error (V3).
        return self._batch_cut.select("item_id", "split", "question", "check", "expect_failure")

    @cached_property
    def matches(self) -> DataFrame:
        succeeded = self.outcomes.where(F.col("success")).select("item_id")
        actual = self.answers.join(succeeded, "item_id", "left_semi")
        exp = self.expected.join(self.items.select("item_id", "check"), "item_id")
        return evaluate.rowset_match(exp, actual, by="item_id", check="check",
                                     expected_cols=["label", "value"], actual_cols=["label", "value"])

    @cached_property
    def verdicts(self) -> DataFrame:
        return evaluate.verdicts(self.items, self.outcomes, self.matches)

    @cached_property
    def board(self) -> DataFrame:
        return evaluate.scoreboard(self.items, self.verdicts)


# What linking must recover: the parameters each templated question was
# generated from, written independently in SQL over the same companies.
N2_SQL = with_views("""SELECT * FROM (
WITH c AS (SELECT company_id AS cid, sic_description FROM companies_v),
per_company AS (
  SELECT 'lookup_annual-' || cid AS item_id, 'lookup' AS intent, 'desc' AS direction, cid AS company_id,
         CAST(NULL AS BIGINT) AS company2_id,
         ['revenue','net_income','total_assets','total_liabilities','eps_diluted'][cid % 5 + 1] AS metric,
         CAST(NULL AS VARCHAR) AS num_metric, CAST(NULL AS VARCHAR) AS den_metric, CAST(NULL AS VARCHAR) AS sector,
         1996 + cid % 5 AS year_from, 1996 + cid % 5 AS fiscal_year, 'FY' AS fiscal_period,
         CAST(NULL AS VARCHAR) AS unread FROM c
  UNION ALL SELECT 'lookup_quarter-' || cid, 'lookup', 'desc', cid, NULL, 'revenue', NULL, NULL, NULL,
         1996 + cid % 5, 1996 + cid % 5, 'Q' || (cid % 4 + 1), NULL FROM c
  UNION ALL SELECT 'ratio-' || cid, 'ratio', 'desc', cid, NULL, NULL,
         ['net_income','total_liabilities','net_income'][cid % 3 + 1],
         ['revenue','total_assets','total_assets'][cid % 3 + 1], NULL, 1996 + cid % 5, 1996 + cid % 5, 'FY', NULL FROM c
  UNION ALL SELECT 'growth-' || cid, 'growth', 'desc', cid, NULL, 'revenue', NULL, NULL, NULL,
         1997 + cid % 4, 1997 + cid % 4, 'FY', NULL FROM c
  UNION ALL SELECT 'difference-' || cid, 'difference', 'desc', cid, NULL, 'net_income', NULL, NULL, NULL,
         1996 + cid % 3, 1998 + cid % 3, 'FY', NULL FROM c
  UNION ALL SELECT 'latest-' || cid, 'latest', 'desc', cid, NULL, 'revenue', NULL, NULL, NULL, NULL, NULL, 'FY', NULL FROM c
  UNION ALL SELECT 'no_metric-' || cid, 'lookup', 'desc', cid, NULL, NULL, NULL, NULL, NULL,
         1996 + cid % 5, 1996 + cid % 5, 'FY', 'gross, margin' FROM c
  UNION ALL SELECT 'no_words-' || cid, 'lookup', 'desc', cid, NULL, NULL, NULL, NULL, NULL,
         1996 + cid % 5, 1996 + cid % 5, 'FY', 'spend, on, research' FROM c
  UNION ALL SELECT 'no_year-' || cid, 'lookup', 'desc', cid, NULL, 'revenue', NULL, NULL, NULL, 1990, 1990, 'FY', NULL FROM c
  UNION ALL SELECT 'comparison-' || a.cid, 'comparison', 'desc', a.cid, b.cid, 'revenue', NULL, NULL, NULL,
         1996 + a.cid % 5, 1996 + a.cid % 5, 'FY', NULL FROM c a JOIN c b ON b.cid = a.cid + 1
  UNION ALL SELECT 'combined-' || a.cid, 'combined', 'desc', a.cid, b.cid, 'revenue', NULL, NULL, NULL,
         1996 + a.cid % 5, 1996 + a.cid % 5, 'FY', NULL FROM c a JOIN c b ON b.cid = a.cid + 1
  UNION ALL SELECT 'two_ratios-' || a.cid, 'ratio', 'desc', a.cid, b.cid, NULL, 'net_income', 'revenue', NULL,
         1996 + a.cid % 5, 1996 + a.cid % 5, 'FY', NULL FROM c a JOIN c b ON b.cid = a.cid + 1
  UNION ALL SELECT 'sector_total-' || min(cid), 'sector_total', 'desc', NULL, NULL, 'revenue', NULL, NULL,
         lower(sic_description), 1996 + min(cid) % 5, 1996 + min(cid) % 5, 'FY', NULL
         FROM c WHERE sic_description IS NOT NULL GROUP BY sic_description),
years(y) AS (SELECT * FROM range(1996, 2001)),
per_year AS (
  SELECT 'top_revenue-' || y AS item_id, 'superlative' AS intent, 'desc' AS direction, 'revenue' AS metric,
         CAST(NULL AS VARCHAR) AS num_metric, CAST(NULL AS VARCHAR) AS den_metric, y, 1 AS top_n FROM years
  UNION ALL SELECT 'top_three-' || y, 'superlative', 'desc', 'total_assets', NULL, NULL, y, 3 FROM years
  UNION ALL SELECT 'fastest-' || y, 'growth_rank', 'desc', 'revenue', NULL, NULL, y, 2 FROM years
  UNION ALL SELECT 'low_net_income-' || y, 'superlative', 'asc', 'net_income', NULL, NULL, y, 1 FROM years
  UNION ALL SELECT 'top_margin-' || y, 'superlative', 'desc', NULL, 'net_income', 'revenue', y, 1 FROM years)
SELECT item_id, intent, direction, company_id, company2_id, metric, num_metric, den_metric, sector,
       CAST(year_from AS INT) AS year_from, CAST(fiscal_year AS INT) AS fiscal_year, fiscal_period,
       CAST(NULL AS INT) AS top_n, unread
FROM per_company UNION ALL
SELECT item_id, intent, direction, NULL, NULL, metric, num_metric, den_metric, NULL,
       CAST(y AS INT), CAST(y AS INT), 'FY', CAST(top_n AS INT), NULL FROM per_year) q""")

# The same questions through to the score: answers from the reference, outcomes by what they hold.
_TRUTH = N2_SQL[N2_SQL.index("SELECT * FROM (\nWITH c AS"):]
RUN_SQL = with_views("{scores}", truth=f"""{_TRUTH}""",
    facts="""SELECT company_id, metric, fiscal_year, fiscal_period, CAST(value AS DOUBLE) AS v FROM financial_metrics_v""",
    labels="SELECT company_id, ticker, lower(sic_description) AS sector_key FROM companies_v",
    answers=REFERENCE_SQL.format(truth="truth", facts="facts", labels="labels"),
    outcomes="""
  SELECT t.item_id, CASE WHEN t.unread IS NOT NULL THEN 'unsupported'
           WHEN t.fiscal_year NOT BETWEEN lo AND hi OR t.year_from NOT BETWEEN lo AND hi THEN 'unanswerable'
           WHEN COALESCE(a.filled, 0) = 0 THEN 'empty_result' ELSE 'success' END AS outcome,
         t.unread, COALESCE(a.n, 0) AS n, t.unread IS NOT NULL OR t.item_id LIKE 'no!_%' ESCAPE '!' AS expect_failure
  FROM truth t LEFT JOIN (SELECT item_id, count(*) AS n, count(value) AS filled FROM answers GROUP BY item_id) a USING (item_id)
  CROSS JOIN (SELECT min(fiscal_year) AS lo, max(fiscal_year) AS hi FROM facts) y""",
    marks="""
  SELECT item_id, CASE WHEN substr(md5(item_id), 1, 1) < '8' THEN 'dev' ELSE 'holdout' END AS split, expect_failure,
         NOT expect_failure AND n = 0 AS reference_error,
         CASE WHEN expect_failure THEN outcome <> 'success' WHEN n > 0 THEN outcome = 'success' END AS passed
  FROM outcomes""")


def _run(select: str) -> str:
    return RUN_SQL.replace("{scores}", select)


@register("N2_link_entities", N2_SQL)
def q_n2(spark, sf_dir):
    return QA(spark, sf_dir).linked.drop("question", "company_ids")


@register("N3_answer_batch", _run("SELECT item_id, label, ROUND(value, 4) AS value FROM answers"))
def q_n3(spark, sf_dir):
    return QA(spark, sf_dir).answers.select("item_id", "label", F.round("value", 4).alias("value"))


@register("N4_classify_outcomes", _run("""
SELECT item_id, outcome, outcome = 'success' AS success, CASE WHEN outcome = 'success' THEN n ELSE 0 END AS n_rows,
  CASE outcome WHEN 'unsupported' THEN 'This question was not understood as a whole: ' || unread || '.'
    WHEN 'unanswerable' THEN 'This question cannot be answered from the data: it asks about a year outside the data.'
    WHEN 'empty_result' THEN 'The question was understood, but the data holds no value for it.'
    ELSE 'Answered with ' || n || ' row(s).' END AS answer
FROM outcomes"""))
def q_n4(spark, sf_dir):
    return QA(spark, sf_dir).outcomes


@register("V1_rowset_match", _run("""
SELECT item_id, CASE WHEN expect_failure THEN 0 ELSE n END AS expected_rows,
       CASE WHEN outcome = 'success' THEN n ELSE 0 END AS actual_rows, outcome = 'success' AS matched
FROM outcomes WHERE n > 0 AND NOT (expect_failure AND outcome <> 'success')"""))
def q_v1(spark, sf_dir):
    return QA(spark, sf_dir).matches


@register("V3_verdicts", _run("SELECT * FROM marks"))
def q_v3(spark, sf_dir):
    return QA(spark, sf_dir).verdicts


SCORES = """SELECT split, count(*) AS items, count(*) FILTER (WHERE COALESCE(passed, FALSE)) AS passed,
  ROUND(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM marks GROUP BY split"""


@register("V4_question_scoreboard", _run(SCORES))
def q_v4q(spark, sf_dir):
    return QA(spark, sf_dir).board


@register("V5_question_gate", _run(f"""
SELECT h.accuracy AS gated_accuracy, h.items AS gated_items, h.items - h.passed AS gated_misses,
       d.accuracy AS reported_accuracy, 0.85 AS floor, h.accuracy >= 0.85 AS gate_passed
FROM (SELECT * FROM ({SCORES}) a WHERE split = 'holdout') h, (SELECT * FROM ({SCORES}) b WHERE split = 'dev') d"""))
def q_v5q(spark, sf_dir):
    return evaluate.gate(QA(spark, sf_dir).board)


@register("V5_question_misses", _run("SELECT item_id, split FROM marks WHERE split = 'holdout' AND NOT COALESCE(passed, FALSE)"))
def q_v5m(spark, sf_dir):
    qa = QA(spark, sf_dir)
    return evaluate.misses(qa.items, qa.verdicts)
