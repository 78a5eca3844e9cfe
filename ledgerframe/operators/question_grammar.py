"""Entity linking of question batches (N2): one vocabulary, leftmost-longest spans, slots.

Company names and tickers, industries and the fixed phrases below are one table of aliases.
The words of a question are joined with it by the whole phrase (an equi-join of the question's
n-grams, of the lengths that aliases have), and the hits of a question are folded from left to
right: the longest alias at a place wins and its words are used up, so "Alpha Beta" is not also
"Alpha". The kept spans fill slots, and the slots decide the intent. Words that no span
uses, and slots that do not go together, are ``unread``: such a question is not answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions.columns import lookup

# --- fixed values -----------------------------------------------------------
# Metric vocabulary (phrase -> stored metric) and ratio vocabulary
# (phrase -> numerator, denominator), from the schema's documented synonyms.
METRIC_SYNONYMS = {
    "revenue": "revenue", "sales": "revenue", "net sales": "revenue", "turnover": "revenue",
    "top line": "revenue",
    "net income": "net_income", "profit": "net_income", "net profit": "net_income", "earnings": "net_income",
    "income": "net_income", "bottom line": "net_income", "profitable": "net_income",
    "assets": "total_assets", "total assets": "total_assets",
    "liabilities": "total_liabilities", "total liabilities": "total_liabilities", "debt": "total_liabilities",
    "eps": "eps_diluted", "diluted eps": "eps_diluted", "earnings per share": "eps_diluted",
    "diluted earnings per share": "eps_diluted",
}
RATIO_SYNONYMS = {
    "net margin": ("net_income", "revenue"), "profit margin": ("net_income", "revenue"),
    "net profit margin": ("net_income", "revenue"),
    "debt ratio": ("total_liabilities", "total_assets"), "leverage": ("total_liabilities", "total_assets"),
    "return on assets": ("net_income", "total_assets"), "roa": ("net_income", "total_assets"),
}
QUARTER_WORDS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
# Words that ask for something, by what they ask for.
SIGNS = {
    "desc": "highest largest biggest most top fastest best greatest",
    "asc": "lowest smallest least slowest worst",
    "growth": "grow grew growing grown growth",
    "change": "change changed difference",
    "combined": "combined total together sum",
    "compare": "compare",
    "latest": "latest|most recent",
    "proportion": "ratio proportion",
}
# Words that the answer does not depend on.
FILLERS = ("what which who how much many was were is are did do does has have had the a an of in for by at to from "
           "and between with as over its their all company companies covered report reported make made fiscal year "
           "years annual annually end during percent percentage dollars per cent amount value")
# --- end of fixed values ----------------------------------------------------

#: A span's kind decides between aliases of equal length at one place.
KINDS = ["ticker", "name", "metric", "ratio", "sector", "sign", "quarter", "count", "year", "filler", "any_case_ticker"]


def _words(text: Column) -> Column:
    """Words without possessive and outer punctuation, in their own case. A comma is a word of its
    own, so that no alias reaches over one that it does not have itself."""
    plain = F.regexp_replace(F.regexp_replace(text, r"['’]s\b", ""), "[,;]", " , ")
    words = F.transform(F.split(plain, r"\s+"), lambda t: F.regexp_replace(t, r"^[\"“(]+|[.:!?\"”)]+$", ""))
    return F.filter(words, lambda t: t != "")


def _phrases(spark) -> DataFrame:
    """The fixed aliases: (kind, value, alias)."""
    rows = [("metric", m, p) for p, m in METRIC_SYNONYMS.items()]
    rows += [("ratio", f"{n}/{d}", p) for p, (n, d) in RATIO_SYNONYMS.items()]
    rows += [("quarter", q, f"{w} quarter") for w, q in QUARTER_WORDS.items()]
    rows += [("quarter", f"Q{k}", f"q{k}") for k in range(1, 5)]
    rows += [("count", str(n), w) for w, n in NUMBER_WORDS.items()]
    rows += [("sign", sign, p) for sign, words in SIGNS.items()
             for p in (words.split("|") if "|" in words else words.split())]
    rows += [("filler", w, w) for w in [*FILLERS.split(), ","]]
    return spark.createDataFrame(rows, "kind string, value string, alias string")


def aliases(companies: DataFrame) -> DataFrame:
    """(kind, value, alias, words): every phrase that can be linked. An alias of several
    companies stands for the one with the smallest id."""
    def named(kind: str, alias: Column) -> DataFrame:
        return companies.select(F.lit(kind).alias("kind"), F.col("company_id").cast("long").alias("id"),
                                F.array_join(_words(alias), " ").alias("alias"))

    own = (named("ticker", F.upper("ticker")).union(named("any_case_ticker", F.lower("ticker")))
           .union(named("name", F.lower("name"))))
    # A name with commas is also said without them.
    own = own.union(own.where("kind = 'name'").withColumn("alias", F.array_join(
        F.filter(F.split("alias", " "), lambda w: w != ","), " ")))
    own = own.groupBy("kind", "alias").agg(F.min("id").cast("string").alias("value")).select("kind", "value", "alias")
    sectors = companies.select(F.lit("sector").alias("kind"), F.lower("sic_description").alias("value"),
                               F.array_join(_words(F.lower("sic_description")), " ").alias("alias")).distinct()
    every = own.union(sectors).union(_phrases(companies.sparkSession)).where("alias <> ''")
    return every.withColumn("words", F.size(F.split("alias", " ")))


def spans(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(item_id, words, kept): the question's words and its spans ``(pos, n, kind, value)`` from
    left to right, no two of which share a word."""
    known = aliases(companies)
    asked = questions.select("item_id", _words(F.col("question")).alias("words"))
    # The lengths that aliases have: a handful of numbers, as one row.
    lengths = F.broadcast(known.agg(F.collect_set("words").alias("lengths")))
    size = F.size("words")

    def of_length(n: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: i <= size - n)
        return F.transform(places, lambda i: F.struct(
            i.alias("pos"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("said")))

    grams = asked.crossJoin(lengths).select(
        "item_id", F.explode(F.flatten(F.transform("lengths", of_length))).alias("g")).select("item_id", "g.*")
    # A ticker is written in capitals; all other aliases match in any case.
    tickers = known.where("kind = 'ticker'").select("kind", "value", F.col("alias").alias("said"))
    others = known.where("kind <> 'ticker'").select("kind", "value", F.col("alias").alias("said"))
    hits = grams.join(tickers, "said").select("item_id", "pos", "n", "kind", "value").union(
        grams.withColumn("said", F.lower("said")).join(others, "said").select("item_id", "pos", "n", "kind", "value"))
    found = hits.groupBy("item_id").agg(F.collect_list(F.struct("pos", "n", "kind", "value")).alias("hits"))

    def number(word: Column, pos: Column) -> Column:
        kind = F.when(word.rlike(r"^(19|20)\d\d$"), F.lit("year")).when(word.rlike(r"^[1-9]\d?$"), F.lit("count"))
        return F.struct(pos.alias("pos"), F.lit(1).alias("n"), kind.alias("kind"), word.alias("value"))

    numbers = F.filter(F.transform("words", number), lambda h: h["kind"].isNotNull())
    order = F.array_sort(F.transform(F.concat(F.coalesce("hits", F.array().cast("array<struct<pos:int,n:int,kind:string,value:string>>")),
                                              numbers),
                                     lambda h: F.struct(h["pos"].alias("pos"), (-h["n"]).alias("shorter"),
                                                        lookup({k: i for i, k in enumerate(KINDS)}, h["kind"]).alias("rank"),
                                                        h["kind"].alias("kind"), h["value"].alias("value"))))
    # Left to right: a span that begins behind the last kept one is kept.
    kind = "struct<upto:int,kept:array<struct<pos:int,n:int,kind:string,value:string>>>"
    start = F.from_json(F.lit('{"upto": 0, "kept": []}'), kind)
    folded = F.aggregate(order, start, lambda state, h: F.when(
        h["pos"] >= state["upto"],
        F.struct((h["pos"] - h["shorter"]).alias("upto"), F.array_append(state["kept"], F.struct(
            h["pos"].alias("pos"), (-h["shorter"]).alias("n"), h["kind"].alias("kind"), h["value"].alias("value"))).alias("kept"))
    ).otherwise(state))
    return asked.join(found, "item_id", "left").select("item_id", "words", folded["kept"].alias("kept"))


def link_entities(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Per question its companies in order (``company_ids``, the first two also by themselves), the
    metric or ratio, the years (``year_from`` and ``fiscal_year``, equal if one is named), the
    period (default FY), a sector, how many rows a ranking asks for (``top_n``), the ranking's
    direction, the intent, and ``unread``: the words and slots that do not fit, NULL if all do."""
    linked = spans(questions, companies)

    def values(*kinds: str) -> Column:
        return F.array_distinct(F.transform(F.filter("kept", lambda s: s["kind"].isin(*kinds)), lambda s: s["value"]))

    used = F.flatten(F.transform("kept", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))
    slots = linked.select(
        "item_id", F.transform(values("ticker", "name", "any_case_ticker"), lambda v: v.cast("long")).alias("company_ids"),
        values("metric").alias("metrics"), values("ratio").alias("ratios"), values("sector").alias("sectors"),
        F.array_sort(F.transform(values("year"), lambda v: v.cast("int"))).alias("years"),
        values("quarter").alias("quarters"), F.transform(values("count"), lambda v: v.cast("int")).alias("counts"),
        values("sign").alias("signs"),
        F.array_except(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(
            F.array().cast("array<int>")), F.coalesce(used, F.array().cast("array<int>"))).alias("left"),
        "words")

    def sign(name: str) -> Column:
        return F.array_contains("signs", name)

    n, years = F.size("company_ids"), F.size("years")
    ratio_of = F.split(F.get("ratios", F.lit(0)), "/")
    # "the ratio of liabilities to assets": two metrics and the word for it.
    by_metrics = sign("proportion") & (F.size("ratios") == 0) & (F.size("metrics") == 2)
    num = F.when(by_metrics, F.get("metrics", F.lit(0))).otherwise(F.get(ratio_of, F.lit(0)))
    den = F.when(by_metrics, F.get("metrics", F.lit(1))).otherwise(F.get(ratio_of, F.lit(1)))
    is_ratio = by_metrics | (F.size("ratios") > 0)
    # A ratio may name its two sides as well.
    loose = F.when(is_ratio, F.array_except("metrics", F.array(num, den))).otherwise(
        F.slice("metrics", 2, F.greatest(F.size("metrics") - 1, F.lit(0))))
    ranking = sign("desc") | sign("asc")
    intent = (F.when(ranking & sign("growth") & (n == 0), "growth_rank")
              .when(ranking & (n == 0), "superlative")
              .when((F.size("sectors") > 0) & (n == 0), "sector_total")
              .when(sign("combined") & (n > 1), "combined")
              .when(sign("growth"), "growth").when(sign("change"), "difference").when(sign("latest"), "latest")
              .when(is_ratio, "ratio").when(n > 1, "comparison").otherwise("lookup"))
    s = slots.select("*", intent.alias("intent"), num.alias("num"), den.alias("den"), is_ratio.alias("is_ratio"),
                     loose.alias("loose"), ranking.alias("ranking"))
    kind = F.col("intent")

    def clash(when: Column, what: str) -> Column:
        return F.when(when, F.lit(what))

    clashes = F.array(
        clash(F.size("loose") > 0, "more than one metric"), clash(F.size("ratios") > 1, "more than one ratio"),
        clash(F.size("sectors") > 1, "more than one industry"), clash(F.size("quarters") > 1, "more than one quarter"),
        clash(F.size("counts") > 1, "more than one number"), clash(sign("desc") & sign("asc"), "two directions"),
        clash((F.size("counts") > 0) & ~F.col("ranking"), "a number of rows without a ranking"),
        clash(F.col("ranking") & (n > 0), "a ranking of named companies"),
        clash((F.size("sectors") > 0) & (n > 0), "an industry and named companies"),
        clash((kind == "sector_total") & ~sign("combined"), "an industry without a total"),
        clash(sign("change") & (kind != "difference"), "a change of something else"),
        clash(sign("growth") & ~kind.isin("growth", "growth_rank"), "growth of something else"),
        clash(sign("latest") & ((kind != "latest") | (years > 0)), "the latest of something else"),
        clash(sign("combined") & F.col("ranking"), "a total and a ranking"),
        clash((kind == "difference") & (years != 2), "a change without two years"),
        clash((years > 1) & ~kind.isin("growth", "difference"), "more years than one"), clash(years > 2, "more than two years"),
        clash(F.col("is_ratio") & ~kind.isin("ratio", "superlative"), "a ratio of something else"),
        clash(sign("compare") & (n < 2), "nothing to compare with"),
        clash(sign("proportion") & ~F.col("is_ratio"), "a proportion of one metric"))
    said = F.transform("left", lambda i: F.get("words", i))
    problems = F.concat(said, F.array_compact(clashes))
    row = F.struct(
        "question", kind.alias("intent"), F.when(sign("asc"), "asc").otherwise("desc").alias("direction"),
        F.get("company_ids", F.lit(0)).alias("company_id"), F.get("company_ids", F.lit(1)).alias("company2_id"),
        F.when(n > 0, F.col("company_ids")).alias("company_ids"),
        F.when(~F.col("is_ratio"), F.get("metrics", F.lit(0))).alias("metric"),
        F.when(F.col("is_ratio"), F.col("num")).alias("num_metric"), F.when(F.col("is_ratio"), F.col("den")).alias("den_metric"),
        F.get("sectors", F.lit(0)).alias("sector"), F.array_min("years").alias("year_from"),
        F.array_max("years").alias("fiscal_year"), F.coalesce(F.get("quarters", F.lit(0)), F.lit("FY")).alias("fiscal_period"),
        F.when(F.col("ranking"), F.coalesce(F.get("counts", F.lit(0)), F.lit(1))).alias("top_n"),
        F.when(F.size(problems) > 0, F.array_join(problems, ", ")).alias("unread"))
    # One row per item. The aggregate also keeps later filters (by intent, a dozen branches in N3)
    # from being pushed into these expressions, which would repeat them in every branch.
    one = s.join(questions.select("item_id", "question"), "item_id").groupBy("item_id").agg(F.first(row).alias("r"))
    return one.select("item_id", "r.*")
