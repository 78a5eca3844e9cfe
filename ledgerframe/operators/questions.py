"""Question batches: validation (N1), routing to the metric operators (N3) and outcome
classification (N4). Entity linking (N2) is in :mod:`ledgerframe.operators.question_grammar`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe import domain
from ledgerframe.functions.columns import growth_pct, safe_ratio
from ledgerframe.operators.question_grammar import link_entities  # noqa: F401
from ledgerframe.session import checkpoint_dir


def validate_questions(df: DataFrame, text: str = "text", min_chars: int = domain.QUESTION_MIN_CHARS,
                       max_chars: int = domain.QUESTION_MAX_CHARS) -> DataFrame:
    """``n_chars`` and ``reject_reason`` (NULL when the question is kept):
    'missing', 'too_short' (< min_chars) or 'too_long' (> max_chars)."""
    n = F.char_length(F.col(text))
    reason = (F.when(F.col(text).isNull(), F.lit("missing"))
              .when(n < min_chars, F.lit("too_short"))
              .when(n > max_chars, F.lit("too_long")))
    return df.withColumn("n_chars", n).withColumn("reject_reason", reason)


def split_valid(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """N1 as two outputs: (kept, rejects with reason)."""
    checked = validate_questions(df, text)
    return checked.where(F.col("reject_reason").isNull()), checked.where(F.col("reject_reason").isNotNull())


# ====================================================================== batch of templated questions
# --- fixed values -----------------------------------------------------------
METRIC_PHRASE = {"revenue": "revenue", "net_income": "net income", "total_assets": "total assets",
                 "total_liabilities": "total liabilities", "eps_diluted": "diluted EPS"}
RATIO_PHRASE = [("net margin", "net_income", "revenue"), ("debt ratio", "total_liabilities", "total_assets"),
                ("return on assets", "net_income", "total_assets")]
ORDINALS = ["first", "second", "third", "fourth"]
# --- end of fixed values ----------------------------------------------------

TRUTH_COLS = ["intent", "direction", "company_id", "company2_id", "metric", "num_metric", "den_metric",
              "sector", "year_from", "fiscal_year", "fiscal_period", "top_n"]


def _pick(options: list, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx % len(options) + 1).cast("int"))


def question_batch(companies: DataFrame, years: list[int], out_of_range_year: int) -> DataFrame:
    """Templated questions derived from the companies table: per company a
    lookup (annual, quarterly), a ratio, a growth, a difference, a comparison
    and a combined value with the next company, a latest-value question and three questions
    that are not to be answered; per year five rankings; per industry a sector total.
    Each row carries the parameters it was generated from (``TRUTH_COLS``),
    a ``split`` (dev / holdout by hash) and ``expect_failure``."""
    c = companies.select("company_id", "name", "sic_description")
    cid = F.col("company_id")
    y = _pick(years, cid)
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    none_l = F.lit(None).cast("long")

    def row(tmpl, question, intent, metric=none_s, num=none_s, den=none_s, year_from=none_i, year=none_i,
            period=F.lit("FY"), company=cid, company2=none_l, sector=none_s, direction=F.lit("desc"), fail=False, n=none_i):
        return F.struct(F.lit(tmpl).alias("tmpl"), question.alias("question"), F.lit(intent).alias("intent"),
                        direction.alias("direction"), company.cast("long").alias("company_id"),
                        company2.cast("long").alias("company2_id"), metric.alias("metric"),
                        num.alias("num_metric"), den.alias("den_metric"), sector.alias("sector"),
                        year_from.cast("int").alias("year_from"), year.cast("int").alias("fiscal_year"),
                        period.alias("fiscal_period"), F.lit(fail).alias("expect_failure"), n.alias("top_n"))

    metric = _pick(list(METRIC_PHRASE), cid)
    phrase = _pick(list(METRIC_PHRASE.values()), cid)
    ordinal = _pick(ORDINALS, cid)
    ratio_i = (cid % len(RATIO_PHRASE) + 1).cast("int")
    r_phrase = F.element_at(F.array(*[F.lit(p) for p, _, _ in RATIO_PHRASE]), ratio_i)
    r_num = F.element_at(F.array(*[F.lit(n) for _, n, _ in RATIO_PHRASE]), ratio_i)
    r_den = F.element_at(F.array(*[F.lit(d) for _, _, d in RATIO_PHRASE]), ratio_i)
    g_year = _pick(years[1:], cid)
    d_year = _pick(years[2:], cid)
    name = F.col("name")
    per_company = [
        row("lookup_annual", F.format_string("What was %s's %s in fiscal %d?", name, phrase, y), "lookup",
            metric=metric, year_from=y, year=y),
        row("lookup_quarter", F.format_string("What was %s's revenue in the %s quarter of fiscal %d?", name, ordinal, y),
            "lookup", metric=F.lit("revenue"), year_from=y, year=y,
            period=F.concat(F.lit("Q"), (cid % 4 + 1).cast("string"))),
        row("ratio", F.format_string("What was %s's %s in fiscal %d?", name, r_phrase, y), "ratio",
            num=r_num, den=r_den, year_from=y, year=y),
        row("growth", F.format_string("How much did %s's revenue grow in fiscal %d?", name, g_year), "growth",
            metric=F.lit("revenue"), year_from=g_year, year=g_year),
        row("difference", F.format_string("How much did %s's net income change between fiscal %d and fiscal %d?",
                                          name, d_year - 2, d_year), "difference",
            metric=F.lit("net_income"), year_from=d_year - 2, year=d_year),
        row("latest", F.format_string("What was %s's latest annual revenue?", name), "latest", metric=F.lit("revenue")),
        row("no_metric", F.format_string("What was %s's gross margin in fiscal %d?", name, y), "lookup",
            year_from=y, year=y, fail=True),
        row("no_words", F.format_string("How much did %s spend on research in fiscal %d?", name, y), "lookup",
            year_from=y, year=y, fail=True),
        row("no_year", F.format_string("What was %s's revenue in fiscal %d?", name, F.lit(out_of_range_year)), "lookup",
            metric=F.lit("revenue"), year_from=F.lit(out_of_range_year), year=F.lit(out_of_range_year), fail=True),
    ]
    items = c.select(F.explode(F.array(*per_company)).alias("r"), "company_id").select("r.*", F.col("company_id").alias("k"))
    # comparison with the next company (an equi-join on company_id + 1)
    nxt = c.select((F.col("company_id") - 1).alias("company_id"), F.col("company_id").alias("c2"), F.col("name").alias("n2"))
    cmp = c.join(nxt, "company_id").select(
        row("comparison", F.format_string("Compare %s and %s revenue in fiscal %d", name, F.col("n2"), y),
            "comparison", metric=F.lit("revenue"), year_from=y, year=y, company2=F.col("c2")).alias("r"),
        "company_id").select("r.*", F.col("company_id").alias("k"))
    both = c.join(nxt, "company_id").select(F.explode(F.array(
        row("combined", F.format_string("What was the combined revenue of %s and %s in fiscal %d?", name, F.col("n2"), y),
            "combined", metric=F.lit("revenue"), year_from=y, year=y, company2=F.col("c2")),
        row("two_ratios", F.format_string("What were the net margin of %s and %s for fiscal year %d?", name, F.col("n2"), y),
            "ratio", num=F.lit("net_income"), den=F.lit("revenue"), year_from=y, year=y, company2=F.col("c2")))).alias("r"),
        "company_id").select("r.*", F.col("company_id").alias("k"))
    # per industry: sector total
    sec = c.where(F.col("sic_description").isNotNull()).groupBy("sic_description").agg(
        F.min("company_id").alias("company_id")).select(
        row("sector_total", F.format_string("What was the total revenue of %s companies in fiscal %d?",
                                            F.col("sic_description"), y),
            "sector_total", metric=F.lit("revenue"), year_from=y, year=y, company=none_l,
            sector=F.lower("sic_description")).alias("r"), "company_id").select("r.*", F.col("company_id").alias("k"))
    # per year: superlatives (the year list is the fiscal window, a parameter)
    yrs = companies.sparkSession.createDataFrame([(v,) for v in years], "y INT")
    yv = F.col("y")
    sup = yrs.select(F.explode(F.array(
        row("top_revenue", F.format_string("Which company had the highest revenue in fiscal %d?", yv), "superlative",
            metric=F.lit("revenue"), year_from=yv, year=yv, company=none_l, n=F.lit(1)),
        row("top_three", F.format_string("What were the top three companies by total assets in fiscal %d?", yv),
            "superlative", metric=F.lit("total_assets"), year_from=yv, year=yv, company=none_l, n=F.lit(3)),
        row("fastest", F.format_string("Which 2 companies had the fastest growing revenue in fiscal %d?", yv),
            "growth_rank", metric=F.lit("revenue"), year_from=yv, year=yv, company=none_l, n=F.lit(2)),
        row("low_net_income", F.format_string("Which company had the lowest net income in fiscal %d?", yv),
            "superlative", metric=F.lit("net_income"), year_from=yv, year=yv, company=none_l, direction=F.lit("asc"), n=F.lit(1)),
        row("top_margin", F.format_string("Which company had the highest net margin in fiscal %d?", yv),
            "superlative", num=F.lit("net_income"), den=F.lit("revenue"), year_from=yv, year=yv, company=none_l, n=F.lit(1)),
    )).alias("r"), yv.cast("long").alias("k")).select("r.*", "k")
    allq = items.unionByName(cmp).unionByName(both).unionByName(sec).unionByName(sup)
    item_id = F.format_string("%s-%d", F.col("tmpl"), F.col("k"))
    return allq.select(
        item_id.alias("item_id"),
        F.when(F.substring(F.md5(item_id.cast("binary")), 1, 1) < "8", F.lit("dev")).otherwise(F.lit("holdout")).alias("split"),
        "question", F.lit("relative").alias("check"), "expect_failure", *TRUTH_COLS)


# ====================================================================== N3
ANSWER_SCHEMA = "item_id string, label string, value double"


#: Intents that give one row for each company they name.
PER_COMPANY = ["lookup", "comparison", "ratio", "growth", "difference", "latest", "combined"]


RANK_PARTS = "array<struct<part:string,metric:string,fiscal_year:int>>"


def read_by(fm: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``fm`` with a metric and period that a row of ``asked`` names (any year; the full year's
    also where a quarter is named). The pairs are as many as the vocabulary has, whatever the batch."""
    named = asked.select(F.explode(F.array(*[
        F.struct(F.col(m).alias("metric"), period.alias("fiscal_period"))
        for m in ("metric", "num_metric", "den_metric") for period in (F.col("fiscal_period"), F.lit("FY"))])).alias("p"))
    pairs = named.select("p.*").where("metric is not null and fiscal_period is not null").distinct()
    return fm.join(F.broadcast(pairs), ["metric", "fiscal_period"], "left_semi")


def answer_batch(linked: DataFrame, fm: DataFrame, companies: DataFrame) -> DataFrame:
    """Route each linked question by intent to the metric operators and return long-form
    answer rows (item_id, label, value): one per company named (lookup, comparison, ratio, growth,
    difference, latest), one per rank (superlative, growth_rank: the first ``top_n``), one for a sector
    total and for a combined value. It reads the templated question classes, not free-form English;
    questions with ``unread`` parts have no rows."""
    if "unread" in linked.columns:
        linked = linked.where("unread is null")
    named = (F.col("company_ids") if "company_ids" in linked.columns
             else F.array_compact(F.array("company_id", "company2_id")))
    co = companies.select("company_id", "ticker", F.lower("sic_description").alias("sector_key"))
    at = ["company_id", "metric", "fiscal_year", "fiscal_period"]
    facts = read_by(fm, linked).select(*at, F.col("value").cast("double").alias("v"))
    ratio, growth = safe_ratio(F.col("num"), F.col("den")), growth_pct(F.col("now"), F.col("was"))
    # Growth that names one year compares with the year before it; a gap year gives no row.
    before = F.when((F.col("intent") == "difference") | (F.col("year_from") < F.col("fiscal_year")),
                    F.col("year_from")).otherwise(F.col("fiscal_year") - 1)

    def part(name: str, metric: str, year: Column) -> Column:
        return F.struct(F.lit(name).alias("part"), F.col(metric).alias("metric"), year.alias("fiscal_year"))

    year, moved = F.col("fiscal_year"), F.array(part("now", "metric", F.col("fiscal_year")), part("was", "metric", before))
    sides = F.array(part("num", "num_metric", year), part("den", "den_metric", year))
    one = F.array(part("value", "metric", year))

    def total(name: str) -> Column:
        return F.sum(F.when(F.col("part") == name, F.col("v"))).alias(name)

    def both(rows: DataFrame, *keys: str) -> DataFrame:
        """Each value of the year asked for with each of the year before, by the row that asks."""
        held = [F.collect_list(F.when(F.col("part") == name, F.struct("v"))).alias(name) for name in ("now", "was")]
        lists = rows.groupBy(*keys).agg(*held)
        return lists.withColumn("now", F.explode("now")).withColumn("was", F.explode("was")).withColumn(
            "now", F.col("now.v")).withColumn("was", F.col("was.v"))

    def labelled(rows: DataFrame, value: Column) -> DataFrame:
        return rows.join(co, "company_id").select("item_id", F.col("ticker").alias("label"), value.alias("value"))

    # The facts that questions name by company, metric, year and period meet them in one join.
    asked = linked.where(F.col("intent").isin(*PER_COMPANY)).withColumn("company_id", F.explode(named))
    wants = F.when(F.col("intent") == "ratio", sides).when(F.col("intent").isin("growth", "difference"), moved).when(
        F.col("intent") != "latest", one)
    known = asked.groupBy("item_id", "intent", "company_id", "metric", "num_metric", "den_metric", "year_from", "fiscal_year",
                          "fiscal_period").agg(F.count("*").alias("times"))
    st = linked.where("intent = 'sector_total' and sector is not null").select(
        "item_id", "intent", F.col("sector").alias("sector_key"), "metric", "fiscal_year", "fiscal_period")
    members = st.join(co, "sector_key").withColumn("times", F.lit(1).cast("long"))
    requests = known.withColumn("asked_year", year).select(
        "item_id", "intent", "company_id", "times", F.lit(None).cast("string").alias("sector_key"), "asked_year", "year_from",
        F.col("metric").alias("of"), "fiscal_period", F.explode(wants).alias("p")).select("*", "p.*").drop("p").unionByName(
        members.select("item_id", "intent", "company_id", "times", "sector_key", F.lit("value").alias("part"), "metric",
                       "fiscal_year", "fiscal_period"), allowMissingColumns=True)
    # Read by each class below: written once.
    checkpoint_dir(linked.sparkSession)
    values = requests.join(facts, at).checkpoint()

    def of(*intents: str) -> DataFrame:
        return values.where(F.col("intent").isin(*intents))

    def each_time(rows: DataFrame) -> DataFrame:
        return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))

    out = [labelled(each_time(of("lookup", "comparison")), F.col("v"))]
    out.append(of("combined").groupBy("item_id").agg(F.sum(F.col("v") * F.col("times")).alias("value")).select(
        "item_id", F.lit("combined").alias("label"), "value"))
    out.append(labelled(of("ratio").groupBy("item_id", "company_id").agg(
        F.sum(F.when(F.col("part") == "num", F.col("v") * F.col("times"))).alias("num"),
        F.sum(F.when(F.col("part") == "den", F.col("v") * F.col("times"))).alias("den")), ratio))
    changes = both(of("growth", "difference"), "item_id", "intent", "company_id", "times", "of", "year_from", "asked_year", "fiscal_period")
    out.append(labelled(each_time(changes),
                        F.when(F.col("intent") == "growth", growth).otherwise(F.col("now") - F.col("was"))))
    latest = asked.where("intent = 'latest'").select("item_id", "company_id", "metric").join(
        facts.where("fiscal_period = 'FY'"), ["company_id", "metric"])
    out.append(labelled(latest.groupBy("item_id", "company_id").agg(F.max_by("v", "fiscal_year").alias("v")), F.col("v")))

    # Rankings: of a value, of a ratio or growth with the ranking guard; in a sector if one is named.
    ranks = linked.where(F.col("intent").isin("superlative", "growth_rank")).withColumn(
        "top_n", F.coalesce("top_n", F.lit(1)) if "top_n" in linked.columns else F.lit(1))
    each = ["item_id", "direction", "top_n", "sector"]
    # A question by value and by ratio ranks both.
    places = ranks.groupBy(*each, "intent", "metric", "num_metric", "den_metric", "year_from", "fiscal_year", "fiscal_period").agg(
        F.count("*").alias("times"))
    kinds = F.when(F.col("intent") == "growth_rank", moved).otherwise(F.concat(
        F.when(F.col("metric").isNotNull(), one).otherwise(F.array().cast(RANK_PARTS)),
        F.when(F.col("num_metric").isNotNull(), sides).otherwise(F.array().cast(RANK_PARTS))))
    keys = places.withColumn("asked_year", year).select(
        *each, "intent", "times", "asked_year", "year_from", F.col("metric").alias("of"), "fiscal_period",
        F.explode(kinds).alias("p")).select("*", "p.*").drop("p")
    # The metrics, years and periods that are ranked: a handful, whatever the number of companies.
    ranked = F.broadcast(keys.select(*at[1:]).distinct())
    rows = keys.join(facts.join(ranked, at[1:], "left_semi"), at[1:])
    by_value = each_time(rows.where("part = 'value'")).select(*each, "company_id", F.col("v").alias("key"))
    by_ratio = rows.where("part in ('num', 'den')").groupBy(*each, "company_id").agg(total("num"), total("den")).where(
        "num is not null and den > 0").select(*each, "company_id", ratio.alias("key"))
    by_growth = each_time(both(rows.where("part in ('now', 'was')"), *each, "company_id", "times", "of", "year_from",
                               "asked_year", "fiscal_period")).where("was > 0").select(*each, "company_id", growth.alias("key"))
    cand = by_value.unionByName(by_ratio).unionByName(by_growth).join(co, "company_id").where(
        "key is not null and (sector is null or sector = sector_key)")
    key = F.when(F.col("direction") == "asc", F.col("key")).otherwise(-F.col("key"))
    w = Window.partitionBy("item_id").orderBy(key.asc_nulls_last(), F.col("ticker").asc())
    out.append(cand.withColumn("rk", F.row_number().over(w)).where("rk <= top_n").select(
        "item_id", F.col("ticker").alias("label"), F.col("key").alias("value")))
    out.append(of("sector_total").groupBy("item_id", "sector_key").agg(F.sum("v").alias("value"))
               .select("item_id", F.col("sector_key").alias("label"), "value"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


# ====================================================================== N4
def classify_outcomes(linked: DataFrame, answers: DataFrame, year_min, year_max) -> DataFrame:
    """Per question - ``unsupported`` when parts of it were not read, ``unanswerable`` when a company,
    metric, sector or year it needs is missing or outside the data (years against the loaded range),
    ``empty_result`` when it returned no rows or only NULL cells, else ``success``; with the
    row count and a plain-text answer."""
    agg = answers.groupBy("item_id").agg(F.count("*").alias("n_rows"),
                                         F.count("value").alias("n_values"))
    j = linked.join(agg, "item_id", "left")
    unread = F.col("unread") if "unread" in linked.columns else F.lit(None).cast("string")
    in_range = lambda c: c.isNull() | c.between(year_min, year_max)
    reason = (F.when(F.col("intent").isin(*PER_COMPANY) & F.col("company_id").isNull(), F.lit("no known company"))
              .when(F.col("metric").isNull() & F.col("num_metric").isNull(), F.lit("no stored metric"))
              .when((F.col("intent") == "sector_total") & F.col("sector").isNull(), F.lit("no known industry"))
              .when(~in_range(F.col("fiscal_year")) | ~in_range(F.col("year_from")), F.lit("a year outside the data")))
    n_rows = F.coalesce(F.col("n_rows"), F.lit(0))
    outcome = (F.when(unread.isNotNull(), F.lit("unsupported"))
               .when(reason.isNotNull(), F.lit("unanswerable"))
               .when(F.coalesce(F.col("n_values"), F.lit(0)) == 0, F.lit("empty_result"))
               .otherwise(F.lit("success")))
    answer = (F.when(outcome == "unsupported",
                     F.format_string("This question was not understood as a whole: %s.", unread))
              .when(outcome == "unanswerable",
                    F.format_string("This question cannot be answered from the data: it asks about %s.", reason))
              .when(outcome == "empty_result",
                    F.lit("The question was understood, but the data holds no value for it."))
              .otherwise(F.format_string("Answered with %d row(s).", n_rows)))
    return j.select("item_id", outcome.alias("outcome"), (outcome == "success").alias("success"),
                    F.when(outcome == "success", n_rows).otherwise(F.lit(0)).alias("n_rows"), answer.alias("answer"))
