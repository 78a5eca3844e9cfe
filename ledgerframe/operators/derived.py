"""ETL steps after period selection: derived liabilities, the filings
dimension, the load summary and the coverage-gap reports (E9, E13-E15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.functions.columns import lookup

SNAPSHOT_KEYS = ["company_id", "fiscal_year", "fiscal_period"]


def derive_liabilities(totals: DataFrame, equities: DataFrame, existing: DataFrame) -> DataFrame:
    """liabilities = (liabilities + equity) - equity, only for periods that
    have no liabilities row yet, and only where both snapshots share the same
    end date. The derived row keeps the total's accession and end date.

    All three inputs are metric rows (company_id, fiscal_year, fiscal_period,
    value, end_date, accn); ``equities`` is already one row per period (the
    equity tags merged by priority)."""
    t = totals.select(*SNAPSHOT_KEYS, "end_date", "accn", F.col("value").alias("total"))
    e = equities.select(*SNAPSHOT_KEYS, "end_date", F.col("value").alias("equity"))
    missing = t.join(existing.select(*SNAPSHOT_KEYS), SNAPSHOT_KEYS, "left_anti")
    return missing.join(e, [*SNAPSHOT_KEYS, "end_date"]).select(
        "company_id", F.lit("total_liabilities").alias("metric"), "fiscal_year", "fiscal_period",
        (F.col("total") - F.col("equity")).cast(domain.VALUE_TYPE).alias("value"),
        F.lit("USD").alias("unit"), F.lit(None).cast("date").alias("start_date"), "end_date", "accn")


def extract_filings(merged: DataFrame, metrics: Sequence[str] = tuple(domain.METRICS),
                    counted: bool = False) -> DataFrame:
    """One row per accession; the first kept fact wins, in metric-list then
    (fy, fp) order (company breaks the remaining ties). ``merged`` is the
    selected facts before Q4 derivation (company_id, metric, fy, fp, form,
    filed, accn). ``counted`` adds ``n_facts``, how many facts an accession has."""
    metric_ord = lookup({m: i for i, m in enumerate(metrics)}, F.col("metric"))
    first = F.min_by(F.struct("company_id", "form", "filed", "fy", "fp"),
                     F.struct(metric_ord, F.col("fy"), F.col("fp"), F.col("company_id")))
    return merged.groupBy("accn").agg(first.alias("f"), F.count("*").alias("n_facts")).select(
        "accn", F.col("f.company_id").alias("company_id"), F.col("f.form").alias("form"),
        F.col("f.filed").alias("filed"), F.col("f.fy").alias("fiscal_year"),
        F.col("f.fp").alias("fiscal_period"), *["n_facts"] * counted)


def load_summary(fm: DataFrame, metrics: Sequence[str] = tuple(domain.METRICS)) -> DataFrame:
    """Company x metric row counts plus a per-company total, and a grand
    total row (company_id NULL) from ROLLUP. The metric list is fixed, so the
    pivot is a set of conditional counts in one aggregate."""
    counts = [F.count_if(F.col("metric") == m).alias(m) for m in metrics]
    return fm.rollup("company_id").agg(*counts, F.count("*").alias("total"))


def no_usable_facts(companies: DataFrame, fm: DataFrame,
                    metrics: Sequence[str] = tuple(domain.METRICS)) -> DataFrame:
    """(company, metric) pairs with no row at all. Each company is fanned
    out to the fixed metric list (no join), then anti-joined with the facts."""
    pairs = companies.select("company_id", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    have = fm.select("company_id", "metric").distinct()
    return pairs.join(have, ["company_id", "metric"], "left_anti")
