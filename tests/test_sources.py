"""Landed JSON documents: company facts, ticker map, submissions, quarantine,
and the full load from them (FIXTURES.md §4)."""

import json


from ledgerframe.operators import universe
from ledgerframe.sources import company_facts as cf


def entry(start, end, val, accn, fy, fp, form, filed):
    e = {"end": end, "val": val, "accn": accn, "fy": fy, "fp": fp, "form": form, "filed": filed}
    if start:
        e["start"] = start
    return e


def doc(tags):
    return {"facts": {"us-gaap": {t: {"units": u} for t, u in tags.items()}}}


def write_facts(tmp_path):
    d = tmp_path / "facts"
    d.mkdir()
    # company 1 switches revenue tags in 2022
    c1 = doc({
        "RevenueFromContractWithCustomerExcludingAssessedTax": {"USD": [
            entry("2021-01-01", "2021-12-31", 100, "a-21", 2021, "FY", "10-K", "2022-02-01")]},
        "Revenues": {"USD": [
            entry("2021-01-01", "2021-12-31", 999, "b-21", 2021, "FY", "10-K", "2022-02-01"),
            entry("2022-01-01", "2022-12-31", 200, "b-22", 2022, "FY", "10-K", "2023-02-01")]},
    })
    # company 2: amendment wins; YTD dropped; EPS under USD/shares
    c2 = doc({
        "NetIncomeLoss": {"USD": [
            entry("2022-01-01", "2022-12-31", 50, "n-1", 2022, "FY", "10-K", "2023-02-01"),
            entry("2022-01-01", "2022-12-31", 55, "n-2", 2022, "FY", "10-K/A", "2023-06-01"),
            entry("2022-01-01", "2022-09-30", 40, "n-3", 2022, "Q3", "10-Q", "2022-11-01"),
            entry("2022-07-01", "2022-09-30", 12, "n-4", 2022, "Q3", "10-Q", "2022-11-01")]},
        "EarningsPerShareDiluted": {"USD/shares": [
            entry("2022-01-01", "2022-12-31", 1.5, "n-1", 2022, "FY", "10-K", "2023-02-01")]},
    })
    # company 3: no Liabilities tag; total and equity, one period with unequal ends
    c3 = doc({
        "LiabilitiesAndStockholdersEquity": {"USD": [
            entry(None, "2022-12-31", 1000, "l-1", 2022, "FY", "10-K", "2023-02-01"),
            entry(None, "2022-03-31", 900, "l-2", 2022, "Q1", "10-Q", "2022-05-01")]},
        "StockholdersEquity": {"USD": [
            entry(None, "2022-12-31", 400, "l-1", 2022, "FY", "10-K", "2023-02-01"),
            entry(None, "2022-03-30", 350, "l-2", 2022, "Q1", "10-Q", "2022-05-01")]},
        "Assets": {"USD": [entry(None, "2022-12-31", 1000, "l-1", 2022, "FY", "10-K", "2023-02-01")]},
    })
    for cik, body in [(1, c1), (2, c2), (3, c3)]:
        (d / f"CIK{cik:010d}.json").write_text(json.dumps(body))
    (d / "CIK0000000004.json").write_text('{"facts": {"us-gaap": ')  # corrupt
    return str(d)


def test_company_facts_load(spark, tmp_path):
    facts, quarantine = cf.read_company_facts(spark, write_facts(tmp_path))
    assert [r["cik"] for r in quarantine.collect()] == ["0000000004"]
    fm = cf.load_metrics(facts, 2020, 2024)
    got = {(r["company_id"], r["metric"], r["fiscal_year"], r["fiscal_period"]): float(r["value"])
           for r in fm.collect()}
    assert got[("0000000001", "revenue", 2021, "FY")] == 100.0      # earlier tag wins its period
    assert got[("0000000001", "revenue", 2022, "FY")] == 200.0      # later tag fills the gap
    assert got[("0000000002", "net_income", 2022, "FY")] == 55.0    # amendment
    assert got[("0000000002", "net_income", 2022, "Q3")] == 12.0    # YTD dropped
    assert got[("0000000002", "eps_diluted", 2022, "FY")] == 1.5
    assert got[("0000000003", "total_liabilities", 2022, "FY")] == 600.0
    assert ("0000000003", "total_liabilities", 2022, "Q1") not in got   # unequal end dates
    units = {r["metric"]: r["unit"] for r in fm.collect()}
    assert units["eps_diluted"] == "USD/share"


def test_tag_filter_on_map_keys(spark, tmp_path):
    facts, _ = cf.read_company_facts(spark, write_facts(tmp_path), tags=["Revenues"])
    assert {r["tag"] for r in facts.collect()} == {"Revenues"}


def test_ticker_map_top_n_and_overrides(spark, tmp_path):
    p = tmp_path / "tickers.json"
    p.write_text(json.dumps({
        "0": {"cik_str": 1045810, "ticker": "nvda", "title": "NVIDIA"},
        "1": {"cik_str": 1652044, "ticker": "GOOGL", "title": "Alphabet"},
        "2": {"cik_str": 1652044, "ticker": "GOOG", "title": "Alphabet"},
        "3": {"cik_str": 2000001, "ticker": "XOM", "title": "New Holding"},
        "4": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"},
    }))
    tm = cf.read_ticker_map(spark, str(p))
    top = [(r["rank"], r["ticker"]) for r in universe.top_n_universe(tm, 3).collect()]
    assert top == [(0, "NVDA"), (1, "GOOGL"), (3, "XOM")]
    ov = spark.createDataFrame([("XOM", "0000034088", "Exxon Mobil Corp")], "ticker string, cik string, title string")
    fixed = {r["ticker"]: r["cik"] for r in universe.apply_overrides(tm, ov).collect()}
    assert fixed["XOM"] == "0000034088" and fixed["NVDA"] == "0001045810"
    req = universe.requested_tickers(spark, [" aapl ", "GOOG", "ZZZZ", "  "])
    res = {r["ticker"]: r["found"] for r in universe.resolve_universe(req, tm).collect()}
    assert res == {"AAPL": True, "GOOG": True, "ZZZZ": False}


def test_submissions_empty_is_null(spark, tmp_path):
    d = tmp_path / "subs"
    d.mkdir()
    (d / "CIK0000000001.json").write_text(json.dumps({"sicDescription": "Electronic Computers"}))
    (d / "CIK0000000002.json").write_text(json.dumps({"sicDescription": ""}))
    got = {r["cik"]: r["sic_description"] for r in cf.read_submissions(spark, str(d)).collect()}
    assert got == {"0000000001": "Electronic Computers", "0000000002": None}


def test_bad_entries_are_listed_and_leave_the_rest(spark, tmp_path):
    good = entry("2022-01-01", "2022-12-31", 200, "b-22", 2022, "FY", "10-K", "2023-02-01")
    bad = [{**good, "val": "lots"}, {k: v for k, v in good.items() if k != "accn"}, {**good, "filed": "soon"},
           {**good, "fy": None}, 7, {**good, "start": "never"}]
    body = doc({"Revenues": {"USD": [bad[0], good, *bad[1:]], "EUR": "none"}, "Assets": {"USD": []}})
    body["facts"]["us-gaap"]["Odd"] = {"label": "no units"}
    (tmp_path / "CIK0000000001.json").write_text(json.dumps(body))
    (tmp_path / "CIK0000000002.json").write_text(json.dumps({"facts": {}}))
    (tmp_path / "CIK0000000003.json").write_text("[1, 2]")
    (tmp_path / "nameless.json").write_text(json.dumps(body))
    facts, quarantine = cf.read_company_facts(spark, str(tmp_path))
    assert [(r["cik"], r["tag"], r["ord"], float(r["val"])) for r in facts.collect()] == [("0000000001", "Revenues", 1, 200.0)]
    got = sorted((r["cik"], r["tag"], r["unit"], r["ord"], r["reason"]) for r in quarantine.where("cik is not null").collect()
                 if r["ord"] is not None)
    assert got == [("0000000001", "Revenues", "USD", k, why) for k, why in (
        (0, "bad val"), (2, "missing accn"), (3, "bad filed"), (4, "missing fy"), (5, "missing end"), (6, "bad start"))]
    rest = {(r["cik"], r["tag"], r["reason"]) for r in quarantine.where("ord is null").collect()}
    assert rest == {("0000000001", "Revenues", "unit without entries"), ("0000000001", "Odd", "tag without units"),
                    ("0000000003", None, "malformed company facts"), (None, None, "no CIK in file name")}
    raw = {r["ord"]: json.loads(r["raw"]) for r in quarantine.where("cik = '0000000001' and ord is not null").collect()}
    assert raw[0] == bad[0] and raw[5] == 7


def test_load_reads_the_documents_once(spark, tmp_path):
    facts, _ = cf.read_company_facts(spark, write_facts(tmp_path))
    plan = cf.load_metrics(facts, 2020, 2024)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_universe_order(spark):
    tm = spark.createDataFrame([(0, "1", "NVDA", "N"), (1, "2", "GOOGL", "A"), (2, "2", "GOOG", "A"), (3, "3", "AAPL", "P")],
                               "rank int, cik string, ticker string, title string")
    def rows(**asked):
        return sorted((r["ticker"], r["found"]) for r in universe.choose_universe(spark, tm, **asked).collect())
    assert rows(tickers=["aapl", "none"], top_n=1) == [("AAPL", True), ("NONE", False)]
    assert rows(tickers=[], top_n=2) == [("GOOGL", True), ("NVDA", True)]
    assert rows(default=["GOOG", "X"]) == [("GOOG", True), ("X", False)]
    found = rows()
    assert len(found) == 25 and [t for t, f in found if f] == ["AAPL", "GOOGL", "NVDA"]
    asked = universe.requested_tickers(spark, ["goog", "zz"])
    have, lack = universe.found_and_missing(asked, tm)
    assert [r[0] for r in have.collect()] == ["GOOG"] and [r[0] for r in lack.collect()] == ["ZZ"]
