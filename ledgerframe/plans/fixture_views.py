"""Stand-in views over the driver's TPC-H-style tables (see FIXTURES.md §3).

``companies_v`` = supplier + nation, ``raw_facts`` = lineitem + orders + part,
``financial_metrics_v`` = raw_facts through the ETL. The values carry no
financial meaning; the shape (gaps, amendments, off-window durations, tag
overlaps) is what exercises the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.operators import derived, periods, quality
from ledgerframe.sources.store import materialized, observed
from ledgerframe.sources.tables import Tables, table_path

# --- fixed values -----------------------------------------------------------
# Fixture mapping: p_size % 5 -> metric; l_returnflag is the tag, priority R, A, N.
FIXTURE_METRIC_BY_SIZE = ["revenue", "net_income", "total_assets", "total_liabilities", "eps_diluted"]
FIXTURE_TAGS = ["R", "A", "N"]
FIXTURE_FY_MIN, FIXTURE_FY_MAX = 1996, 2000
FIXTURE_WIDE_FY_MIN, FIXTURE_WIDE_FY_MAX = 1995, 2001
# --- end of fixed values ----------------------------------------------------

FIXTURE_METRIC_TAGS = {m: list(FIXTURE_TAGS) for m in domain.METRICS}


def companies_v(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: a broadcast has a proven size bound.
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("company_id"),
        F.col("s_name").alias("ticker"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("sic_description"),
    )


def raw_facts(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_orderpriority")
    p = t.part.select("p_partkey", "p_size")
    li = li.withColumn("l_shipdate", F.to_date("l_shipdate"))  # days travel, not microseconds
    ship = F.col("l_shipdate")
    q = F.quarter("l_shipdate")
    is_q4 = q == 4
    metric = F.element_at(F.array(*[F.lit(m) for m in FIXTURE_METRIC_BY_SIZE]),
                          (F.col("p_size") % 5 + 1).cast("int"))
    base_form = F.when(is_q4, F.lit("10-K")).otherwise(F.lit("10-Q"))
    form = (F.when(F.col("o_orderpriority").startswith("5"), F.lit("8-K"))
            .otherwise(F.concat(base_form, F.when(F.col("o_orderpriority").startswith("1"), F.lit("/A"))
                                .otherwise(F.lit("")))))
    back = (F.when(is_q4, F.lit(320)).otherwise(F.lit(60)) + F.col("l_quantity")).cast("int")
    # The part first: with the metric known, filters on the duration go before the shuffle for the orders.
    joined = (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
              .join(o, F.col("l_orderkey") == F.col("o_orderkey")))
    return joined.select(
        F.col("l_suppkey").alias("company_id"),
        metric.alias("metric"),
        F.col("l_returnflag").alias("tag"),
        F.year("l_shipdate").cast("int").alias("fy"),
        F.when(is_q4, F.lit("FY")).otherwise(F.concat(F.lit("Q"), q.cast("string"))).alias("fp"),
        form.alias("form"),
        F.date_sub(ship, back).alias("start_date"),
        ship.alias("end_date"),
        F.date_add(ship, (F.lit(30) + F.col("l_linenumber")).cast("int")).alias("filed"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("accn"),
        F.when(F.col("p_size") % 5 == 4, F.col("l_quantity")).otherwise(F.col("l_extendedprice"))
        .cast(domain.VALUE_TYPE).alias("val"),
    )


def financial_metrics_v(t: Tables, fy_min: int = FIXTURE_FY_MIN, fy_max: int = FIXTURE_FY_MAX) -> DataFrame:
    return periods.build_metrics(raw_facts(t), fy_min, fy_max, metric_tags=FIXTURE_METRIC_TAGS)


def views(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables, companies_v, financial_metrics_v) for one data directory."""
    t = Tables(spark, sf_dir)
    return t, companies_v(t), financial_metrics_v(t)


# --- fixed values -----------------------------------------------------------
# Fixture mapping of event types to attempt outcomes (FIXTURES.md §3).
EVENT_OUTCOME = {
    "purchase": "success",
    "error": "execution_error",
    "view": "empty_result",
    "click": "guard_rejected",
    "signup": "unanswerable",
}
MAX_ATTEMPTS = 3
# --- end of fixed values ----------------------------------------------------


def attempt_log_v(t: Tables) -> DataFrame:
    """Attempt log over events: the events of a user and day by (ts, event_id) are
    attempts, and a new request opens after every third (request = user, day, block;
    attempt_number = place in the block), so every event is an attempt; outcome from
    event_type; duration_ms = value x 100; split by user_id % 2.

    Numbering needs the events of one user and day in order: the window sorts (and
    spills) them, it does not hold them; its size is one user's events of one day."""
    from pyspark.sql import Window

    from ledgerframe.functions.columns import lookup
    e = t.events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    place = F.row_number().over(w) - 1
    ranked = e.withColumn("place", place).withColumn(
        "block", F.floor(F.col("place") / MAX_ATTEMPTS)).withColumn(
        "attempt_number", (F.col("place") % MAX_ATTEMPTS + 1).cast("int"))
    outcome = lookup(EVENT_OUTCOME, F.col("event_type"))
    return ranked.select(
        F.format_string("%d-%s-%d", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd"),
                        F.col("block")).alias("request_id"),
        "user_id", "event_id", "ts", "attempt_number", outcome.alias("outcome"),
        F.when(outcome != "success", F.col("props")).alias("error_message"),
        F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
        F.when(F.col("user_id") % 2 == 0, F.lit("dev")).otherwise(F.lit("holdout")).alias("split"),
    )


def metrics_table(spark: SparkSession, sf_dir: str, fy_min: int = FIXTURE_FY_MIN,
                  fy_max: int = FIXTURE_FY_MAX) -> DataFrame:
    """The metrics table as the question operators read it: built once by the
    ETL, written partitioned by metric and sorted by year / period. The ETL's aggregate
    leaves the rows dealt by (company, metric, year), so they are written from where they are."""
    t = Tables(spark, sf_dir)
    return materialized(spark, f"financial_metrics_{fy_min}_{fy_max}",
                        lambda: financial_metrics_v(t, fy_min, fy_max), _etl_inputs(sf_dir),
                        partition_by=["metric"], sort_by=["fiscal_year", "fiscal_period", "company_id"],
                        spread=True, observe=quality.domain_rules())


def _etl_inputs(sf_dir: str) -> list[str]:
    return [table_path(sf_dir, n) for n in ("lineitem", "orders", "part")]


def metrics_observed(spark: SparkSession, sf_dir: str, fy_min: int = FIXTURE_FY_MIN,
                     fy_max: int = FIXTURE_FY_MAX) -> dict:
    """The domain rules (D3) as they were counted while the metrics table was written."""
    metrics_table(spark, sf_dir, fy_min, fy_max)
    return observed(spark, f"financial_metrics_{fy_min}_{fy_max}", _etl_inputs(sf_dir))


def merged_facts(t: Tables, fy_min: int = FIXTURE_FY_MIN, fy_max: int = FIXTURE_FY_MAX) -> DataFrame:
    usable = periods.usable_facts(raw_facts(t), fy_min, fy_max)
    return periods.select_and_merge(usable, FIXTURE_METRIC_TAGS)


def filings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings dimension (E13) as the question and quality operators read it, written once like the
    metrics table, with the number of kept facts of each accession (``n_facts``)."""
    t = Tables(spark, sf_dir)
    return materialized(spark, f"filings_{FIXTURE_FY_MIN}_{FIXTURE_FY_MAX}",
                        lambda: derived.extract_filings(merged_facts(t), counted=True), _etl_inputs(sf_dir))
