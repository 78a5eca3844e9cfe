"""Period selection, tag fallback and derivations on hand-written facts,
from the cases the loader's own comments describe."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerframe.operators import derived, periods

RAW = ("company_id long, metric string, tag string, fy int, fp string, form string, start_date date, "
       "end_date date, filed date, accn string, val decimal(20,4)")
TAGS = {"revenue": ["T1", "T2"], "total_assets": ["A"], "total_liabilities": ["L"]}


def d(s):
    return dt.date.fromisoformat(s)


def fact(metric="revenue", tag="T1", fy=2022, fp="FY", form="10-K", start="2022-01-01", end="2022-12-31",
         filed="2023-02-01", accn="a1", val=100, company=1):
    return (company, metric, tag, fy, fp, form, d(start) if start else None, d(end), d(filed), accn,
            Decimal(val))


def build(spark, rows):
    return periods.build_metrics(spark.createDataFrame(rows, RAW), 2020, 2024, metric_tags=TAGS,
                                 tiebreak=("accn",))


def values(df):
    return {(r["metric"], r["fiscal_year"], r["fiscal_period"]): float(r["value"]) for r in df.collect()}


def test_ytd_and_comparatives_and_amendments(spark):
    rows = [
        # Q3 10-Q: the 9-month YTD figure is dropped, the 3-month one kept
        fact(fp="Q3", form="10-Q", start="2022-01-01", end="2022-09-30", val=900),
        fact(fp="Q3", form="10-Q", start="2022-07-01", end="2022-09-30", val=300, accn="a2"),
        # FY: a comparative (earlier end) loses to the current period
        fact(fp="FY", start="2021-01-01", end="2021-12-31", val=50, accn="a3"),
        fact(fp="FY", val=1000, accn="a4"),
        # ... and an amendment (same end, later filed) beats the original
        fact(fp="FY", form="10-K/A", val=1100, filed="2023-05-01", accn="a5"),
        # 8-K and out-of-window years never count
        fact(fp="FY", form="8-K", val=7, filed="2023-09-01", accn="a6"),
        fact(fy=2019, fp="FY", start="2019-01-01", end="2019-12-31", val=5, accn="a7"),
    ]
    got = values(build(spark, rows))
    assert got == {("revenue", 2022, "Q3"): 300.0, ("revenue", 2022, "FY"): 1100.0}


def test_tag_switch_fills_only_the_gap(spark):
    rows = [
        fact(tag="T1", fy=2021, start="2021-01-01", end="2021-12-31", val=10, accn="x1"),
        fact(tag="T2", fy=2021, start="2021-01-01", end="2021-12-31", val=99, accn="x2"),
        fact(tag="T2", fy=2022, val=20, accn="x3"),
    ]
    got = values(build(spark, rows))
    assert got == {("revenue", 2021, "FY"): 10.0, ("revenue", 2022, "FY"): 20.0}


def test_q4_derived_and_missing_quarter_reported(spark):
    rows = [fact(fp="FY", val=1000, accn="k")]
    for q, (s, e, v) in {"Q1": ("2022-01-01", "2022-03-31", 200), "Q2": ("2022-04-01", "2022-06-30", 250),
                         "Q3": ("2022-07-01", "2022-09-30", 300)}.items():
        rows.append(fact(fp=q, form="10-Q", start=s, end=e, val=v, accn=f"q{q}"))
    rows.append(fact(fy=2021, fp="FY", start="2021-01-01", end="2021-12-31", val=800, accn="k0"))
    rows.append(fact(fy=2021, fp="Q1", form="10-Q", start="2021-01-01", end="2021-03-31", val=100, accn="k1"))
    fm = build(spark, rows)
    q4 = fm.where("fiscal_period = 'Q4'").collect()
    assert len(q4) == 1 and float(q4[0]["value"]) == 250.0
    assert q4[0]["start_date"] == d("2022-10-01") and q4[0]["end_date"] == d("2022-12-31")
    assert q4[0]["accn"] == "k"
    raw = spark.createDataFrame(rows, RAW)
    merged = periods.merge_tags(periods.select_periods(periods.usable_facts(raw, 2020, 2024), ("accn",)), TAGS)
    miss = periods.missing_quarters(merged).collect()
    assert [(r["fiscal_year"], r["missing"]) for r in miss] == [(2021, "Q2,Q3")]


def test_instants_have_no_start_and_no_q4(spark):
    rows = [fact(metric="total_assets", tag="A", fp=p, form="10-Q" if p != "FY" else "10-K", start=None,
                 end=e, accn=f"i{p}", val=5) for p, e in
            [("Q1", "2022-03-31"), ("Q2", "2022-06-30"), ("Q3", "2022-09-30"), ("FY", "2022-12-31")]]
    fm = build(spark, rows)
    assert fm.where("fiscal_period = 'Q4'").count() == 0
    assert fm.where("start_date IS NOT NULL").count() == 0
    assert {r["unit"] for r in fm.collect()} == {"USD"}


def test_derived_liabilities_need_equal_end_dates(spark):
    cols = "company_id long, fiscal_year int, fiscal_period string, value decimal(20,4), end_date date, accn string"
    totals = spark.createDataFrame([(1, 2022, "FY", Decimal(100), d("2022-12-31"), "t1"),
                                    (1, 2022, "Q1", Decimal(90), d("2022-03-31"), "t2"),
                                    (1, 2021, "FY", Decimal(80), d("2021-12-31"), "t3")], cols)
    equities = spark.createDataFrame([(1, 2022, "FY", Decimal(40), d("2022-12-31"), "e1"),
                                      (1, 2022, "Q1", Decimal(30), d("2022-03-30"), "e2"),
                                      (1, 2021, "FY", Decimal(10), d("2021-12-31"), "e3")], cols)
    existing = spark.createDataFrame([(1, 2021, "FY", Decimal(1), d("2021-12-31"), "l1")], cols)
    out = derived.derive_liabilities(totals, equities, existing).collect()
    assert [(r["fiscal_year"], r["fiscal_period"], float(r["value"]), r["accn"]) for r in out] == \
        [(2022, "FY", 60.0, "t1")]


def test_filings_first_fact_wins_in_metric_order(spark):
    cols = "company_id long, metric string, fy int, fp string, form string, filed date, accn string"
    merged = spark.createDataFrame([
        (1, "net_income", 2022, "FY", "10-K", d("2023-02-01"), "a"),
        (1, "revenue", 2022, "Q1", "10-Q", d("2023-02-02"), "a"),
        (1, "revenue", 2022, "FY", "10-K", d("2023-02-03"), "a"),
    ], cols)
    r = derived.extract_filings(merged).collect()
    assert len(r) == 1 and r[0]["fiscal_period"] == "FY" and r[0]["filed"] == d("2023-02-03")


def test_no_usable_facts_pairs(spark):
    co = spark.createDataFrame([(1,), (2,)], "company_id long")
    fm = spark.createDataFrame([(1, "revenue")], "company_id long, metric string")
    got = {(r["company_id"], r["metric"]) for r in derived.no_usable_facts(co, fm, ["revenue", "net_income"]).collect()}
    assert got == {(1, "net_income"), (2, "revenue"), (2, "net_income")}
