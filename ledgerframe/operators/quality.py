"""The schema's constraints as checks on tables (D1-D4). Each check is one
aggregate pass; a violation count of 0 means the rule holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.operators.periods import unit_of

METRIC_KEY = ["company_id", "metric", "fiscal_year", "fiscal_period"]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key values that occur more than once, with their count."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def uniqueness_report(checks: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """D1 for several tables: (rule, violations) = number of duplicated keys."""
    parts = [duplicate_keys(df, keys).agg(F.count("*").alias("violations"))
             .select(F.lit(rule).alias("rule"), "violations") for rule, (df, keys) in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-NULL ``key`` has no parent (NULL keys are allowed)."""
    parent_key = parent_key or key
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(p, key, "left_anti")


def referential_report(fm: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Metrics -> companies (required), metrics -> filings (nullable),
    filings -> companies."""
    parts = [
        ("metrics_company", orphans(fm, companies, "company_id")),
        ("metrics_filing", orphans(fm, filings, "accn")),
        ("filings_company", orphans(filings, companies, "company_id")),
    ]
    out = None
    for rule, df in parts:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def domain_report(fm: DataFrame) -> DataFrame:
    """D3: closed domains and not-null rules, one ``count_if`` per rule."""
    return fm.agg(*domain_rules())


def domain_rules() -> list[Column]:
    """The rules of D3 as aggregates, which a job can also observe while it writes the table."""
    m, p, u = F.col("metric"), F.col("fiscal_period"), F.col("unit")
    return [
        F.count_if(~m.isin(*domain.METRICS) | m.isNull()).alias("bad_metric"),
        F.count_if(~p.isin(*domain.PERIODS) | p.isNull()).alias("bad_period"),
        F.count_if(~u.isin(*domain.UNITS) | u.isNull()).alias("bad_unit"),
        F.count_if(u != unit_of(m)).alias("unit_mismatch"),
        F.count_if(m.isin(*domain.INSTANT_METRICS) & (p == "Q4")).alias("instant_q4"),
        F.count_if(m.isin(*domain.INSTANT_METRICS) & F.col("start_date").isNotNull()).alias("instant_with_start"),
        F.count_if(F.col("value").isNull() | F.col("fiscal_year").isNull() | F.col("end_date").isNull())
        .alias("missing_required"),
        F.count("*").alias("rows"),
    ]


def reconcile_quarters(fm: DataFrame, flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """FY against the sum of its four quarters, per company/metric/year with
    all five rows. With a derived Q4 the difference is 0; anything else
    means stale derived rows."""
    rows = fm.where(F.col("metric").isin(*flow_metrics))
    agg = rows.groupBy("company_id", "metric", "fiscal_year").agg(
        F.sum(F.when(F.col("fiscal_period") == "FY", F.col("value"))).alias("fy_value"),
        F.sum(F.when(F.col("fiscal_period") != "FY", F.col("value"))).alias("quarter_sum"),
        F.count_if(F.col("fiscal_period") != "FY").alias("quarters"),
        F.count_if(F.col("fiscal_period") == "FY").alias("fy_rows"))
    return (agg.where((F.col("quarters") == 4) & (F.col("fy_rows") == 1))
            .select("company_id", "metric", "fiscal_year", "fy_value", "quarter_sum",
                    (F.col("fy_value") - F.col("quarter_sum")).alias("difference")))
