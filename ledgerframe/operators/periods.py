"""Filing-fact ETL: from raw tagged facts to one clean long-format metrics table.

Input columns (``raw facts``): company_id, metric, tag, fy, fp, form, start_date,
end_date, filed, accn, val, plus optional tie-break columns (``ord`` for JSON
sources). Output of :func:`build_metrics` is the metrics table: company_id,
metric, fiscal_year, fiscal_period, value, unit, start_date, end_date, accn.

Scale notes. Period selection is a top-1-per-group problem. It is written as a
``min_by`` aggregate, so Spark runs a partial aggregate in every map task and
shuffles at most one row per group and task: a company holding a third of all
facts is reduced before the exchange instead of landing in one task.
:func:`build_metrics` fuses tag fallback (E8) and the Q4 derivation (E10) into
the same aggregate keyed on (company, metric, fiscal year): one shuffle for the
whole ETL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.functions.columns import lookup

PAYLOAD = ["tag", "form", "start_date", "end_date", "filed", "accn", "val"]


# ---------------------------------------------------------------- E1, E2, E6
# Filters are written so that every input expression occurs once: Catalyst
# inlines the columns of the view below into each reference, and a condition
# that repeats them produces generated code too large for the JIT.
def base_form(form: Column) -> Column:
    """Text before the first '/', trimmed ('10-K/A' -> '10-K')."""
    return F.trim(F.substring_index(form, "/", 1))


def normalize_forms(raw: DataFrame) -> DataFrame:
    """Fold amendments into 10-K / 10-Q and drop every other form."""
    return raw.withColumn("form", base_form(F.col("form"))).where(F.col("form").isin(*domain.FORMS))


def drop_incomplete(raw: DataFrame) -> DataFrame:
    """An entry needs form, fy, fp, end, filed and val; start may be NULL."""
    return raw.dropna(subset=["form", "fy", "fp", "end_date", "filed", "val"])


def fiscal_year_window(raw: DataFrame, fy_min: int, fy_max: int) -> DataFrame:
    """Keep fiscal-year labels in [fy_min, fy_max]; the bound is explicit."""
    return raw.where(F.col("fy").between(fy_min, fy_max))


def _within(x: Column, bounds: tuple[int, int]) -> Column:
    lo, hi = bounds
    return F.abs(x * 2 - (lo + hi)) <= (hi - lo)


def is_current_period(flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> Column:
    """E7 eligibility: FY facts from a 10-K and Q1-Q3 facts from a 10-Q; flows
    also need a start and a duration inside the annual / quarterly window
    (this drops year-to-date figures and any Q4 flow)."""
    fp, form = F.col("fp"), F.col("form")
    expected_form = F.when(fp == "FY", F.lit("10-K")).when(fp.isin(*domain.QUARTERS), F.lit("10-Q"))
    days = F.datediff(F.col("end_date"), F.col("start_date"))
    in_window = F.when(fp == "FY", _within(days, domain.ANNUAL_DURATION_DAYS)) \
        .otherwise(_within(days, domain.QUARTERLY_DURATION_DAYS))
    duration_ok = ~F.col("metric").isin(*flow_metrics) | F.coalesce(in_window, F.lit(False))
    return (form == expected_form) & duration_ok


def usable_facts(raw: DataFrame, fy_min: int, fy_max: int,
                 flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """E1 + E2 + E6 + the per-row part of E7, as one filter."""
    facts = fiscal_year_window(drop_incomplete(normalize_forms(raw)), fy_min, fy_max)
    return facts.where(is_current_period(flow_metrics))


# ------------------------------------------------------------------- E7, E8
def recency_key(tiebreak: Sequence[str]) -> Column:
    """Ascending key whose minimum is the winning fact: latest end, then latest
    filed (amendments beat originals), then the tie-break columns."""
    return F.struct(
        (-F.unix_date(F.col("end_date"))).alias("neg_end"),
        (-F.unix_date(F.col("filed"))).alias("neg_filed"),
        *[F.col(c) for c in tiebreak],
    )


def _payload() -> Column:
    return F.struct(*[F.col(c) for c in PAYLOAD])


def select_periods(eligible: DataFrame, tiebreak: Sequence[str] = ("accn", "val")) -> DataFrame:
    """Exactly one fact per (company, metric, tag, fy, fp)."""
    keys = ["company_id", "metric", "tag", "fy", "fp"]
    picked = eligible.groupBy(*keys).agg(F.min_by(_payload(), recency_key(tiebreak)).alias("w"))
    return picked.select(*keys[:2], *keys[3:], *[F.col("w")[c].alias(c) for c in PAYLOAD])


def tag_priority(metric_tags: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Priority of ``tag`` for ``metric`` (0 = most preferred, NULL = unknown tag)."""
    rows = domain.tag_priority_rows(metric_tags)
    return lookup({f"{m}\u0001{t}": p for m, t, p in rows},
                  F.concat_ws("\u0001", F.col("metric"), F.col("tag")))


def merge_tags(selected: DataFrame, metric_tags: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per-period fallback; the earliest listed tag with a fact wins, later
    tags only fill periods the earlier ones lack."""
    keys = ["company_id", "metric", "fy", "fp"]
    ranked = selected.withColumn("prio", tag_priority(metric_tags)).where(F.col("prio").isNotNull())
    picked = ranked.groupBy(*keys).agg(F.min_by(_payload(), F.col("prio")).alias("w"))
    return picked.select(*keys, *[F.col("w")[c].alias(c) for c in PAYLOAD])


def select_and_merge(eligible: DataFrame, metric_tags: Mapping[str, Sequence[str]] | None = None,
                     tiebreak: Sequence[str] = ("accn", "val")) -> DataFrame:
    """E7 and E8 as one aggregate: the same rows as ``merge_tags(select_periods(...))``, shuffled once."""
    keys = ["company_id", "metric", "fy", "fp"]
    ranked = eligible.withColumn("prio", tag_priority(metric_tags)).where(F.col("prio").isNotNull())
    picked = ranked.groupBy(*keys).agg(F.min(winner(tiebreak, PAYLOAD)).alias("w"))
    return picked.select(*keys, *[_won(F.col("w"), c).alias(c) for c in PAYLOAD])


# ------------------------------------------------------------------ E12, E10, E11
def unit_of(metric: Column) -> Column:
    return lookup(dict(domain.unit_rows()), metric)


def metric_rows(merged: DataFrame, flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """Stored unit from the metric, NULL start for instants, final names."""
    return merged.select(
        "company_id", "metric",
        F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"),
        F.col("val").cast(domain.VALUE_TYPE).alias("value"),
        unit_of(F.col("metric")).alias("unit"),
        F.when(F.col("metric").isin(*flow_metrics), F.col("start_date")).alias("start_date"),
        "end_date", "accn",
    )


def _by_period(df: DataFrame, value_cols: Sequence[str]) -> list[Column]:
    """One conditional aggregate per period: the period's row as a struct."""
    out = []
    for p in ["FY", *domain.QUARTERS]:
        payload = F.struct(*[F.col(c) for c in value_cols])
        out.append(F.min_by(F.when(F.col("fp") == p, payload), F.when(F.col("fp") == p, F.lit(0))).alias(f"p_{p}"))
    return out


def winner(tiebreak: Sequence[str], cols: Sequence[str]) -> Column:
    """The row that wins by (tag priority, :func:`recency_key`) as one struct to take the least of: the
    key first, then those of ``cols`` that are not in it. Nothing is held twice, as a key beside its row would."""
    key = [F.col("prio"), (-F.unix_date(F.col("end_date"))).alias("neg_end"), (-F.unix_date(F.col("filed"))).alias("neg_filed")]
    rest = [c for c in cols if c not in (*tiebreak, "end_date", "filed", "prio")]
    return F.struct(*key, *[F.col(c) for c in tiebreak], *[F.col(c) for c in rest])


def _won(w: Column, c: str) -> Column:
    """Column ``c`` of the row that a :func:`winner` stands for."""
    if c in ("end_date", "filed"):
        return F.date_from_unix_date(-w["neg_end" if c == "end_date" else "neg_filed"])
    return w[c]


def _q4_from(fy: Column, q1: Column, q2: Column, q3: Column, extra: Sequence[str] = ("form", "filed")) -> Column:
    """Q4 = FY - (Q1 + Q2 + Q3), from Q3's end + 1 day to FY's end, on FY's filing."""
    complete = fy.isNotNull() & q1.isNotNull() & q2.isNotNull() & q3.isNotNull()
    value = (fy["val"] - (q1["val"] + q2["val"] + q3["val"])).cast(domain.VALUE_TYPE)
    return F.when(complete, F.struct(
        F.lit("Q4").alias("fp"), value.alias("val"),
        F.date_add(q3["end_date"], 1).alias("start_date"),
        fy["end_date"].alias("end_date"), fy["accn"].alias("accn"),
        *[fy[c].alias(c) for c in extra]))


def derive_q4(merged: DataFrame, flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """Derived Q4 rows (flows only) where FY and Q1-Q3 all exist."""
    cols = ["val", "start_date", "end_date", "accn", "form", "filed"]
    per_year = (merged.where(F.col("metric").isin(*flow_metrics))
                .groupBy("company_id", "metric", "fy").agg(*_by_period(merged, cols)))
    q4 = _q4_from(F.col("p_FY"), F.col("p_Q1"), F.col("p_Q2"), F.col("p_Q3"))
    return (per_year.select("company_id", "metric", "fy", q4.alias("q4"))
            .where(F.col("q4").isNotNull())
            .select("company_id", "metric", "fy", "q4.*"))


def missing_quarters(merged: DataFrame, flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """(company, metric, fy, missing) for FY flow rows whose Q4 cannot be
    derived; ``missing`` lists the absent quarters, comma-separated."""
    has = [F.max(F.col("fp") == p).alias(f"p_{p}") for p in ["FY", *domain.QUARTERS]]
    per_year = (merged.where(F.col("metric").isin(*flow_metrics))
                .groupBy("company_id", "metric", "fy").agg(*has))
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f"p_{q}"), F.lit(False)), F.lit(q))
                                        for q in domain.QUARTERS]))
    return (per_year.where(F.col("p_FY"))
            .select("company_id", "metric", F.col("fy").alias("fiscal_year"),
                    F.concat_ws(",", missing).alias("missing"))
            .where(F.col("missing") != ""))


# ---------------------------------------------------------------- fused build
def build_metrics(raw: DataFrame, fy_min: int, fy_max: int,
                  metric_tags: Mapping[str, Sequence[str]] | None = None,
                  tiebreak: Sequence[str] = ("accn", "val"),
                  flow_metrics: Sequence[str] = domain.FLOW_METRICS) -> DataFrame:
    """E1, E2, E6, E7, E8, E10 and E12 in one aggregate.

    Ordering by (tag priority, recency key) and taking the minimum per
    (company, metric, fy, fp) is the same as selecting per tag and then taking
    the most preferred tag, so both steps are one ``min``. Grouping on
    (company, metric, fy) with one conditional ``min`` per period gives the
    FY and Q1-Q3 winners side by side, so Q4 falls out of the same row.
    """
    facts = usable_facts(raw, fy_min, fy_max, flow_metrics)
    facts = facts.withColumn("prio", tag_priority(metric_tags)).where(F.col("prio").isNotNull())
    # Only what the metrics table keeps travels through the aggregation buffers, once.
    cols = ["val", "start_date", "end_date", "accn"]
    wins = [F.min(F.when(F.col("fp") == p, winner(tiebreak, cols))).alias(f"w_{p}") for p in ["FY", *domain.QUARTERS]]
    per_year = facts.groupBy("company_id", "metric", "fy").agg(*wins).select("company_id", "metric", "fy", *[
        F.when(F.col(f"w_{p}").isNotNull(), F.struct(*[_won(F.col(f"w_{p}"), c).alias(c) for c in cols])).alias(f"p_{p}")
        for p in ["FY", *domain.QUARTERS]])
    q4 = F.when(F.col("metric").isin(*flow_metrics),
                _q4_from(F.col("p_FY"), F.col("p_Q1"), F.col("p_Q2"), F.col("p_Q3"), extra=()))
    periods = [F.when(F.col(f"p_{p}").isNotNull(),
                      F.struct(F.lit(p).alias("fp"), *[F.col(f"p_{p}")[c].alias(c) for c in cols]))
               for p in ["FY", *domain.QUARTERS]]
    rows = (per_year
            .select("company_id", "metric", "fy", F.explode(F.array_compact(F.array(*periods, q4))).alias("r"))
            .select("company_id", "metric", "fy", "r.*"))
    return metric_rows(rows, flow_metrics)
