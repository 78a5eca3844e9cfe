"""Domain vocabulary of the filing-fact model and the schemas built on it.

The constants below are fixed values: they must equal the source data's own
vocabulary (SEC us-gaap tag names, form codes, period labels, units) and the
documented selection windows, or results differ.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Metrics in load order; flows accumulate over a period, instants are snapshots.
METRICS = ["revenue", "net_income", "total_assets", "total_liabilities", "eps_diluted"]
FLOW_METRICS = ["revenue", "net_income", "eps_diluted"]
INSTANT_METRICS = ["total_assets", "total_liabilities"]
# Per-metric us-gaap tags, earlier tag wins per period.
METRIC_TAGS = {
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "SalesRevenueNet",
        "RevenuesNetOfInterestExpense",
    ],
    "net_income": [
        "NetIncomeLoss",
        "NetIncomeLossAvailableToCommonStockholdersBasic",
        "ProfitLoss",
    ],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "eps_diluted": ["EarningsPerShareDiluted"],
}
# Balance-sheet identity fallback for liabilities: total minus equity.
LIABILITIES_TOTAL_TAG = "LiabilitiesAndStockholdersEquity"
EQUITY_TAGS = [
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    "StockholdersEquity",
]
# Metric -> (units key in the source JSON, unit stored in the table).
METRIC_UNIT = {
    "revenue": ("USD", "USD"),
    "net_income": ("USD", "USD"),
    "total_assets": ("USD", "USD"),
    "total_liabilities": ("USD", "USD"),
    "eps_diluted": ("USD/shares", "USD/share"),
}
FORMS = ["10-K", "10-Q"]
PERIODS = ["FY", "Q1", "Q2", "Q3", "Q4"]
QUARTERS = ["Q1", "Q2", "Q3"]
UNITS = ["USD", "USD/share"]
ANNUAL_DURATION_DAYS = (330, 380)
QUARTERLY_DURATION_DAYS = (70, 100)
FISCAL_YEAR_MIN = 2020
# Tickers loaded when neither a list nor a number of companies is asked for.
DEFAULT_TICKERS = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "TSLA", "JPM", "BAC", "GS", "V", "MA",
    "WMT", "COST", "HD", "KO", "PEP", "MCD", "XOM", "CVX", "JNJ", "PFE", "UNH", "DIS", "NFLX",
]
# Attempt outcomes of a question, and the request-size bounds.
OUTCOMES = ["success", "guard_rejected", "execution_error", "empty_result", "unanswerable"]
QUESTION_MIN_CHARS = 3
QUESTION_MAX_CHARS = 1000
RESULT_ROW_CAP = 200
RETRIEVAL_TOP_K = 8
EVAL_RELATIVE_TOLERANCE = 0.01
EVAL_HOLDOUT_FLOOR = 0.85
EXPECTED_FAILURE_MIN_ANSWER_CHARS = 20
# --- end of fixed values ----------------------------------------------------

VALUE_TYPE = T.DecimalType(20, 4)

RAW_FACT_SCHEMA = T.StructType([
    T.StructField("company_id", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("fy", T.IntegerType()),
    T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("filed", T.DateType()),
    T.StructField("accn", T.StringType()),
    T.StructField("val", VALUE_TYPE),
])

METRIC_ROW_COLUMNS = [
    "company_id", "metric", "fiscal_year", "fiscal_period", "value", "unit",
    "start_date", "end_date", "accn",
]


def unit_rows() -> list[tuple[str, str]]:
    return [(m, METRIC_UNIT[m][1]) for m in METRICS]


def tag_priority_rows(metric_tags: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """(metric, tag, priority) with 0 the most preferred tag."""
    metric_tags = METRIC_TAGS if metric_tags is None else metric_tags
    return [(m, tag, i) for m, tags in metric_tags.items() for i, tag in enumerate(tags)]
