"""Coverage statistics of the loaded data (A9-A12), derived from the tables
so that statements about coverage cannot drift from what is loaded.

Each figure is a one-pass aggregate; figures that depend on another figure
(the latest year, the peak) use an uncorrelated scalar subquery
(``DataFrame.scalar()``), which Spark evaluates once and inlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fy_rows(fm: DataFrame, metric: str | None) -> DataFrame:
    rows = fm.where(F.col("fiscal_period") == "FY")
    return rows if metric is None else rows.where(F.col("metric") == metric)


def coverage_stats(fm: DataFrame, companies: DataFrame) -> DataFrame:
    """Company count, distinct industries, first/last year, row count."""
    c = companies.agg(F.count("*").alias("n_companies"),
                      F.count_distinct("sic_description").alias("n_industries"))
    f = fm.agg(F.min("fiscal_year").alias("year_min"), F.max("fiscal_year").alias("year_max"),
               F.count("*").alias("n_rows"))
    return c.select("n_companies", "n_industries",
                    f.select("year_min").scalar().alias("year_min"),
                    f.select("year_max").scalar().alias("year_max"),
                    f.select("n_rows").scalar().alias("n_rows"))


def companies_with_latest_fy(fm: DataFrame, metric: str | None = None) -> DataFrame:
    """A10: distinct companies with an FY row in the latest loaded year."""
    latest = fm.agg(F.max("fiscal_year")).scalar()
    rows = _fy_rows(fm, metric).where(F.col("fiscal_year") == latest)
    return rows.agg(F.count_distinct("company_id").alias("n_with_fy_latest"))


def fy_companies_per_year(fm: DataFrame, metric: str | None = None) -> DataFrame:
    return _fy_rows(fm, metric).groupBy("fiscal_year").agg(F.count_distinct("company_id").alias("n"))


def broad_coverage(fm: DataFrame, threshold: float = 0.5, metric: str | None = None) -> DataFrame:
    """Peak annual FY company count, and the last broad year = the latest
    year whose FY company count is >= threshold x peak (falls back to the
    latest loaded year when no year has FY rows)."""
    per_year = fy_companies_per_year(fm, metric)
    peak = per_year.agg(F.max("n")).scalar()
    broad = per_year.where(F.col("n") >= peak * F.lit(threshold)).agg(F.max("fiscal_year")).scalar()
    latest = fm.agg(F.max("fiscal_year")).scalar()
    return per_year.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak_fy_companies")).select(
        "peak_fy_companies", F.coalesce(broad, latest).alias("last_broad_year"))


def coverage_document(fm: DataFrame, companies: DataFrame, threshold: float = 0.5,
                      metric: str | None = None) -> DataFrame:
    """The figures of A9-A11 rendered into the coverage text. The metrics table is read once: one
    row per loaded year, from which the peak and the last broad year follow."""
    full = F.col("fiscal_period") == "FY" if metric is None else (
        (F.col("fiscal_period") == "FY") & (F.col("metric") == metric))
    years = fm.groupBy("fiscal_year").agg(
        F.count("*").alias("rows"), F.count_distinct(F.when(full, F.col("company_id"))).alias("full"))
    # A handful of years: gathered into one array.
    loaded = years.agg(F.array_sort(F.collect_list(F.struct("fiscal_year", "rows", "full"))).alias("years"))
    first, last = F.get("years", F.lit(0)), F.element_at("years", -1)
    peak = F.array_max(F.transform("years", lambda y: y["full"]))
    figures = loaded.where(F.size("years") > 0).select(
        first["fiscal_year"].alias("year_min"), last["fiscal_year"].alias("year_max"), last["full"].alias("n_latest"),
        F.aggregate("years", F.lit(0).cast("long"), lambda acc, y: acc + y["rows"]).alias("n_rows"),
        F.transform(F.filter("years", lambda y: (y["full"] > 0) & (y["full"] >= peak * F.lit(threshold))),
                    lambda y: y["fiscal_year"]).alias("broad"))
    c = companies.agg(F.count("*").alias("n_companies"), F.count_distinct("sic_description").alias("n_industries"))
    row = figures.select("*", c.select("n_companies").scalar().alias("n_companies"),
                         c.select("n_industries").scalar().alias("n_industries"),
                         F.coalesce(F.array_max("broad"), "year_max").alias("last_broad"))
    text = F.format_string(
        "What is loaded, counted in the tables:\n"
        "* %d companies in %d industries, %d metric rows\n"
        "* fiscal years %d to %d; nothing outside them can be answered\n"
        "* annual rows for %d: %d of %d companies so far\n"
        "* latest year that most companies have closed: %d",
        "n_companies", "n_industries", "n_rows", "year_min", "year_max", "year_max", "n_latest", "n_companies",
        "last_broad")
    return row.select(F.lit("glossary").alias("doc_type"), F.lit("what is loaded: companies and fiscal years").alias("title"),
                      text.alias("content"))
