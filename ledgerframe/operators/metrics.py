"""Metric questions as DataFrame operators over the long-format metrics table.

``fm`` is the metrics table (company_id, metric, fiscal_year, fiscal_period,
value, unit, start_date, end_date, accn) and ``co`` the companies dimension
(company_id, ticker, name, sic_description).

Rules every operator keeps (they are where naive SQL goes wrong):
* metric, fiscal_year and fiscal_period are always pinned; FY and quarter rows
  are never mixed in one sum;
* both sides of a ratio share company, year and period; ratios are computed in
  double with ``try_divide`` (Spark decimal division truncates the scale);
* rankings by a computed value keep the guard "every input present and the
  denominator > 0", state NULL placement explicitly and break ties by ticker;
* windows are always partitioned (an unpartitioned window moves every row to
  one task).

Joins to ``co`` are left to the planner: the dimension is filtered first, and
Spark broadcasts it only when its estimated (and, under AQE, measured) size is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions.columns import growth_pct, safe_ratio


def _pin(fm: DataFrame, metric: str | Sequence[str] | None = None, fiscal_year: int | None = None,
         fiscal_period: str | Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(True)
    if metric is not None:
        cond &= F.col("metric").isin(*([metric] if isinstance(metric, str) else metric))
    if fiscal_year is not None:
        cond &= F.col("fiscal_year") == fiscal_year
    if fiscal_period is not None:
        cond &= F.col("fiscal_period").isin(*([fiscal_period] if isinstance(fiscal_period, str) else fiscal_period))
    return fm.where(cond)


def _with_company(df: DataFrame, co: DataFrame, cols: Sequence[str] = ("ticker", "name")) -> DataFrame:
    return df.join(co.select("company_id", *cols), "company_id")


def _by_ticker(co: DataFrame, tickers: str | Sequence[str]) -> DataFrame:
    tickers = [tickers] if isinstance(tickers, str) else list(tickers)
    return co.where(F.col("ticker").isin(*tickers))


# ------------------------------------------------------------------ Q1 - Q9
def lookup_value(fm: DataFrame, co: DataFrame, ticker: str, metric: str, fiscal_year: int,
                 fiscal_period: str = "FY") -> DataFrame:
    """Q1: one company, metric, year and period -> value."""
    rows = _pin(fm, metric, fiscal_year, fiscal_period)
    return (rows.join(_by_ticker(co, ticker).select("company_id", "ticker"), "company_id")
            .select("ticker", "metric", "fiscal_year", "fiscal_period", "value"))


def companies_like(co: DataFrame, pattern: str) -> DataFrame:
    """Q2: companies whose name matches ``pattern`` case-insensitively (ILIKE)."""
    return co.where(F.col("name").ilike(pattern)).select("company_id", "ticker", "name", "sic_description")


def threshold_filter(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, fiscal_period: str,
                     op: str, threshold: float) -> DataFrame:
    """Q3: rows of one metric/year/period whose value passes ``op threshold``
    (``value < 0`` is a net loss)."""
    v = F.col("value")
    cond = {"<": v < threshold, "<=": v <= threshold, ">": v > threshold, ">=": v >= threshold}[op]
    rows = _pin(fm, metric, fiscal_year, fiscal_period).where(cond)
    return _with_company(rows, co, ["ticker"]).select("ticker", "fiscal_year", "fiscal_period", "value")


def end_date_window(fm: DataFrame, co: DataFrame, metric: str, start: str, end: str,
                    fiscal_period: str | Sequence[str] | None = None) -> DataFrame:
    """Q4: rows whose calendar end_date falls in [start, end]."""
    rows = _pin(fm, metric, None, fiscal_period).where(
        F.col("end_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return _with_company(rows, co, ["ticker"]).select(
        "ticker", "fiscal_year", "fiscal_period", "end_date", "value")


def scaled(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, fiscal_period: str,
           scale: float = 1e9, digits: int = 6) -> DataFrame:
    """Q5: value / scale as a readable double (filters stay on raw values)."""
    rows = _pin(fm, metric, fiscal_year, fiscal_period)
    return _with_company(rows, co, ["ticker"]).select(
        "ticker", F.round(F.col("value").cast("double") / F.lit(scale), digits).alias("value_scaled"))


def quarterly_series(fm: DataFrame, co: DataFrame, ticker: str, metric: str, fiscal_year: int) -> DataFrame:
    """Q6: the Q1-Q4 rows of one company and year, in period order."""
    rows = _pin(fm, metric, fiscal_year, ["Q1", "Q2", "Q3", "Q4"])
    return (rows.join(_by_ticker(co, ticker).select("company_id"), "company_id")
            .select("fiscal_period", "value", "end_date").orderBy("fiscal_period"))


def with_provenance(fm: DataFrame, filings: DataFrame, how: str = "left") -> DataFrame:
    """Q7: value with the form, filed date and accession it came from. ``how``
    is 'left' so a row with no filing does not drop, or 'inner'."""
    f = filings.select(F.col("accn"), F.col("form"), F.col("filed").alias("filed_date"))
    return fm.join(f, "accn", how).select(
        "company_id", "metric", "fiscal_year", "fiscal_period", "value", "form", "filed_date", "accn")


def compare_companies(fm: DataFrame, co: DataFrame, tickers: Sequence[str], metric: str,
                      fiscal_year: int, fiscal_period: str = "FY") -> DataFrame:
    """Q8: one labelled row per company, largest first (ticker breaks ties)."""
    rows = _pin(fm, metric, fiscal_year, fiscal_period)
    return (rows.join(_by_ticker(co, tickers).select("company_id", "ticker", "name"), "company_id")
            .select("ticker", "name", F.col("value").alias(metric))
            .orderBy(F.col(metric).desc_nulls_last(), "ticker"))


def members_with(co: DataFrame, fm: DataFrame, metric: str, fiscal_year: int, fiscal_period: str,
                 min_value: float) -> DataFrame:
    """Q9: ``id IN (SELECT ...)``: companies with a qualifying row (semi join)."""
    hits = _pin(fm, metric, fiscal_year, fiscal_period).where(F.col("value") > min_value)
    return co.join(hits.select("company_id"), "company_id", "left_semi").select("company_id", "ticker")


# ------------------------------------------------------------------ J1 - J5
def ratio_by_join(fm: DataFrame, co: DataFrame, num_metric: str, den_metric: str, fiscal_year: int,
                  fiscal_period: str = "FY", name: str = "ratio") -> DataFrame:
    """Two-metric self-join on company/year/period. Same rows as the
    single-pass :func:`ratio` restricted to companies with both inputs."""
    keys = ["company_id", "fiscal_year", "fiscal_period"]
    num = _pin(fm, num_metric, fiscal_year, fiscal_period).select(*keys, F.col("value").alias("num"))
    den = _pin(fm, den_metric, fiscal_year, fiscal_period).select(*keys, F.col("value").alias("den"))
    return _with_company(num.join(den, keys), co, ["ticker"]).select(
        "ticker", "fiscal_year", "fiscal_period",
        F.round(safe_ratio(F.col("num"), F.col("den")), 6).alias(name))


def _prior(fm: DataFrame, metric: str, fiscal_year: int, years_back: int, fiscal_period: str) -> DataFrame:
    keys = ["company_id", "metric", "fiscal_period"]
    cur = _pin(fm, metric, fiscal_year, fiscal_period).select(*keys, F.col("value").alias("cur"))
    prev = _pin(fm, metric, fiscal_year - years_back, fiscal_period).select(*keys, F.col("value").alias("prev"))
    # Equi-join on the shifted year (not LAG): a gap year gives no row.
    return cur.join(prev, keys)


def yoy_growth(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, fiscal_period: str = "FY") -> DataFrame:
    """(cur - prev) / NULLIF(prev, 0) * 100 against fiscal_year - 1."""
    j = _prior(fm, metric, fiscal_year, 1, fiscal_period)
    return _with_company(j, co, ["ticker"]).select(
        "ticker", F.col("cur").alias("current_value"), F.col("prev").alias("prior_value"),
        F.round(growth_pct(F.col("cur"), F.col("prev")), 6).alias("yoy_growth_pct"))


def year_difference(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, years_back: int,
                    fiscal_period: str = "FY") -> DataFrame:
    """Dollar change between two years ``years_back`` apart."""
    j = _prior(fm, metric, fiscal_year, years_back, fiscal_period)
    return _with_company(j, co, ["ticker"]).select(
        "ticker", (F.col("cur") - F.col("prev")).alias("difference"))


def _sector(co: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Industry filter by loose patterns, OR-ed, case-insensitive."""
    cond = F.lit(False)
    for p in patterns:
        cond |= F.col("sic_description").ilike(p)
    return co.where(cond)


def sector_growth(fm: DataFrame, co: DataFrame, patterns: Sequence[str], metric: str, fiscal_year: int,
                  fiscal_period: str = "FY") -> DataFrame:
    """Per company of the sector, growth against the prior year, 1 place."""
    j = _prior(fm, metric, fiscal_year, 1, fiscal_period)
    return (j.join(_sector(co, patterns).select("company_id", "ticker", "name"), "company_id")
            .select("ticker", "name", F.round(growth_pct(F.col("cur"), F.col("prev")), 1).alias("growth_pct")))


def sector_members(co: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """J5 on its own: the companies a sector pattern list selects."""
    return _sector(co, patterns).select("company_id", "ticker", "sic_description")


# ------------------------------------------------------------------ A1 - A8
def _filtered_sum(metric: str) -> Column:
    return F.sum(F.when(F.col("metric") == metric, F.col("value")))


def ratio(fm: DataFrame, co: DataFrame, num_metric: str, den_metric: str, fiscal_year: int,
          fiscal_period: str = "FY", name: str = "ratio", guard: bool = True, rounded: bool = True) -> DataFrame:
    """A1 / A2 / A3: SUM(v) FILTER(num) / NULLIF(SUM(v) FILTER(den), 0) per
    company in one aggregate (one scan, one shuffle). With ``guard`` (A7) a
    company is kept only if the numerator exists and the denominator is > 0."""
    rows = _pin(fm, [num_metric, den_metric], fiscal_year, fiscal_period)
    agg = rows.groupBy("company_id").agg(_filtered_sum(num_metric).alias("num"),
                                         _filtered_sum(den_metric).alias("den"))
    if guard:
        agg = agg.where(F.col("num").isNotNull() & (F.col("den") > 0))
    exact = _with_company(agg, co, ["ticker"]).select("ticker", safe_ratio(F.col("num"), F.col("den")).alias(name))
    return exact if not rounded else _rounded_ratio(exact, name)


def _rounded_ratio(exact: DataFrame, name: str) -> DataFrame:
    return exact.select("ticker", F.round(name, 6).alias(name), F.round(F.col(name) * 100.0, 4).alias(f"{name}_pct"))


def equity(fm: DataFrame, co: DataFrame, fiscal_year: int, fiscal_period: str = "FY") -> DataFrame:
    """A4: shareholders' equity = assets - liabilities (two FILTER sums)."""
    rows = _pin(fm, ["total_assets", "total_liabilities"], fiscal_year, fiscal_period)
    agg = rows.groupBy("company_id").agg(
        (_filtered_sum("total_assets") - _filtered_sum("total_liabilities")).alias("shareholders_equity"))
    return _with_company(agg, co, ["ticker"]).select("ticker", "shareholders_equity")


def side_by_side(fm: DataFrame, co: DataFrame, metrics: Sequence[str], fiscal_year: int,
                 fiscal_period: str = "FY", tickers: Sequence[str] | None = None) -> DataFrame:
    """A5: one row per company, one column per metric (pivot on a fixed list,
    so Spark does not need a distinct pass to find the pivot values)."""
    rows = _pin(fm, list(metrics), fiscal_year, fiscal_period)
    if tickers is not None:
        rows = rows.join(_by_ticker(co, tickers).select("company_id"), "company_id", "left_semi")
    wide = rows.groupBy("company_id").pivot("metric", list(metrics)).agg(F.sum("value"))
    return _with_company(wide, co, ["ticker"]).select("ticker", *metrics)


def sector_total(fm: DataFrame, co: DataFrame, patterns: Sequence[str], metric: str, fiscal_year: int,
                 fiscal_period: str = "FY") -> DataFrame:
    """SUM over the companies of a sector, plus how many contributed."""
    rows = _pin(fm, metric, fiscal_year, fiscal_period)
    j = rows.join(_sector(co, patterns).select("company_id"), "company_id", "left_semi")
    return j.agg(F.sum("value").alias("sector_total"), F.count("*").alias("companies"))


def ranked(df: DataFrame, key: str, n: int = 1, highest: bool = True, tie: str = "ticker") -> DataFrame:
    """W2 / W3 core: top-n by ``key``, NULLs last either way, ``tie`` ascending."""
    order = F.col(key).desc_nulls_last() if highest else F.col(key).asc_nulls_last()
    return df.orderBy(order, F.col(tie).asc()).limit(n)


def top_ratio(fm: DataFrame, co: DataFrame, num_metric: str, den_metric: str, fiscal_year: int,
              fiscal_period: str = "FY", n: int = 1, highest: bool = True, name: str = "ratio") -> DataFrame:
    """A7 + W3: the guarded ratio ranking (incomplete companies cannot win), ranked on the
    exact ratio and rounded afterwards."""
    exact = ratio(fm, co, num_metric, den_metric, fiscal_year, fiscal_period, name, guard=True, rounded=False)
    return _rounded_ratio(ranked(exact, name, n, highest), name)


def ttm(fm: DataFrame, co: DataFrame, metric: str) -> DataFrame:
    """Sum of the four quarterly rows with the latest end_date per company;
    ``quarters`` says how many were found (the sum is complete only at 4)."""
    q = _pin(fm, metric, None, ["Q1", "Q2", "Q3", "Q4"])
    w = Window.partitionBy("company_id").orderBy(F.col("end_date").desc(), F.col("fiscal_year").desc(),
                                                 F.col("fiscal_period").desc())
    last4 = q.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 4)
    agg = last4.groupBy("company_id").agg(F.sum("value").alias("ttm_value"), F.count("*").alias("quarters"),
                                          F.max("end_date").alias("through"))
    return _with_company(agg, co, ["ticker"]).select("ticker", "ttm_value", "quarters", "through")


# ------------------------------------------------------------------ W1 - W6
def qoq_growth(fm: DataFrame, co: DataFrame, metric: str, fiscal_years: Sequence[int] | None = None,
               tickers: Sequence[str] | None = None) -> DataFrame:
    """Quarter-over-quarter growth, LAG ordered by end_date (not by the
    period label), partitioned by company and metric."""
    q = _pin(fm, metric, None, ["Q1", "Q2", "Q3", "Q4"])
    if fiscal_years is not None:
        q = q.where(F.col("fiscal_year").isin(*fiscal_years))
    c = co if tickers is None else _by_ticker(co, tickers)
    q = q.join(c.select("company_id", "ticker"), "company_id")
    w = Window.partitionBy("company_id", "metric").orderBy("end_date", "fiscal_year", "fiscal_period")
    prev = F.lag("value").over(w)
    return q.select("ticker", "fiscal_year", "fiscal_period", "end_date", "value",
                    F.round(growth_pct(F.col("value"), prev), 6).alias("qoq_growth_pct"))


def top_values(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, fiscal_period: str = "FY",
               n: int = 1, highest: bool = True) -> DataFrame:
    """Superlative on a stored value (top-1 / top-N, highest or lowest)."""
    rows = _with_company(_pin(fm, metric, fiscal_year, fiscal_period), co, ["ticker", "name"])
    return ranked(rows.select("name", "ticker", F.col("value").alias(metric)), metric, n, highest)


def fastest_growing(fm: DataFrame, co: DataFrame, metric: str, fiscal_year: int, fiscal_period: str = "FY",
                    n: int = 1) -> DataFrame:
    """W3 on growth: guarded (positive prior) YoY growth, top-n."""
    g = yoy_growth(fm, co, metric, fiscal_year, fiscal_period)
    g = g.where((F.col("prior_value") > 0) & F.col("current_value").isNotNull())
    exact = growth_pct(F.col("current_value"), F.col("prior_value"))
    return ranked(g.withColumn("_exact", exact), "_exact", n, True).drop("_exact")


def latest_fy_rows(fm: DataFrame, co: DataFrame, metric: str) -> DataFrame:
    """Per company, its latest year that has an FY row for ``metric``."""
    rows = _pin(fm, metric, None, "FY")
    latest = rows.groupBy("company_id").agg(
        F.max_by(F.struct("fiscal_year", "value"), F.col("fiscal_year")).alias("r"))
    return _with_company(latest, co, ["ticker"]).select(
        "ticker", F.col("r.fiscal_year").alias("fiscal_year"), F.col("r.value").alias("value"))


def latest_year(fm: DataFrame) -> DataFrame:
    """The scalar MAX(fiscal_year), as a one-row frame."""
    return fm.agg(F.max("fiscal_year").alias("latest_year"))


def rows_in_latest_year(fm: DataFrame, co: DataFrame, metric: str, fiscal_period: str = "FY") -> DataFrame:
    """W5 used as a filter: rows of the latest loaded year (one-row frame
    joined in; Spark broadcasts the single row)."""
    latest = latest_year(fm)
    rows = _pin(fm, metric, None, fiscal_period).join(
        latest, F.col("fiscal_year") == F.col("latest_year"))
    return _with_company(rows, co, ["ticker"]).select("ticker", "fiscal_year", "value")


def set_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """UNION (distinct), UNION ALL, INTERSECT, EXCEPT of two selects."""
    if op == "union":
        return a.union(b).distinct()
    if op == "union_all":
        return a.unionByName(b)
    if op == "intersect":
        return a.intersect(b)
    if op == "except":
        return a.subtract(b)
    raise ValueError(op)
