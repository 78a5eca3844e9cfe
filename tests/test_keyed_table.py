"""Keyed tables: what an upsert writes, merge rules, replays, meeting writers, compaction."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerframe.sources import company_facts as cf
from ledgerframe.sources import files
from ledgerframe.sources.keyed_table import KeyedTable
from ledgerframe.streaming import ingest

SCHEMA = "k string, first string, v int"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["v"], buckets=16)


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_rules_and_replay(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(spark.createDataFrame([("a", "x", 1), (None, "n", 5), ("b", None, 2)], SCHEMA), ("run", 0))
    table.upsert(spark.createDataFrame([("a", "y", None), ("c", "z", 3), (None, "m", 6)], SCHEMA), ("run", 1))
    want = sorted([("a", "x", None), ("b", None, 2), ("c", "z", 3), (None, "n", 6)], key=repr)
    assert rows_of(table) == want
    before = table.manifest()
    assert table.upsert(spark.createDataFrame([("a", "q", 9)], SCHEMA), ("run", 1)) == before  # a replay
    table.upsert(spark.createDataFrame([], SCHEMA), ("run", 2))  # an empty batch
    assert rows_of(table) == want and table.manifest()["applied"] == {"run": 2}


def test_an_upsert_writes_what_it_changes(spark, table, tmp_path):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256)
                                     .alias("first"), F.col("id").cast("int").alias("v"))
    table.upsert(rows)
    def size():
        return {f: os.path.getsize(f) for f in glob.glob(f"{tmp_path}/t/data/*/*/*.parquet")}
    before = size()
    table.upsert(rows.where("v % 100 = 0").withColumn("v", -F.col("v")))
    after = size()
    assert all(after[f] == n for f, n in before.items())  # nothing is rewritten
    written = sum(n for f, n in after.items() if f not in before)
    assert written < 0.04 * sum(before.values())
    assert table.read().count() == 20000 and table.read().where("v < 0").count() == 199


def test_two_writers_meet(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([("a", "x", 1)], SCHEMA))
    put, met = files.put_once, []

    def other_first(session, path, text):
        if not met:
            met.append(1)
            table.upsert(spark.createDataFrame([("a", "late", 7), ("b", "other", 8)], SCHEMA))
        return put(session, path, text)

    monkeypatch.setattr(files, "put_once", other_first)
    table.upsert(spark.createDataFrame([("a", "mine", 2)], SCHEMA))
    assert table.manifest()["version"] == 3
    assert rows_of(table) == [("a", "x", 2), ("b", "other", 8)]


def test_compaction_and_vacuum(spark, table, monkeypatch, tmp_path):
    for v in range(5):
        table.upsert(spark.createDataFrame([("a", f"f{v}", v), (f"k{v}", "own", v)], SCHEMA))
    want = rows_of(table)
    put, met = files.put_once, []

    def upsert_first(session, path, text):
        if not met:
            met.append(1)
            table.upsert(spark.createDataFrame([("a", "later", 99)], SCHEMA))
        return put(session, path, text)

    monkeypatch.setattr(files, "put_once", upsert_first)
    state = table.compact(max_folders=2)
    monkeypatch.undo()
    want = [("a", "f0", 99) if r[0] == "a" else r for r in want]
    assert rows_of(table) == want and max(map(len, state["buckets"].values())) == 2
    assert table.compact(max_folders=2) == state  # nothing to do
    (tmp_path / "t" / "data" / "0" / "bucket=1").mkdir(parents=True)
    gone = table.vacuum(keep_versions=1, hours=0)
    assert "0" in gone and rows_of(table) == want
    assert len(files.names(spark, f"{table.path}/_versions")) == 1


def entry(val, accn, filed):
    return {"start": "2022-01-01", "end": "2022-12-31", "val": val, "accn": accn, "fy": 2022, "fp": "FY",
            "form": "10-K", "filed": filed}


def test_companies_filings_and_metrics(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()

    def land(cik, name, *entries):
        body = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": list(entries)}}}}}
        (landing / f"CIK{cik:010d}{name}.json").write_text(json.dumps(body))

    def run():
        ingest.start_ingest(spark, str(landing), store, str(tmp_path / "ck"), 2020, 2024).awaitTermination(300)

    for cik in range(1, 41):
        land(cik, "", entry(cik, f"a-{cik}", "2023-02-01"))
    run()
    sizes = {f: os.path.getsize(f) for f in glob.glob(f"{store}/metrics/data/**/*.parquet", recursive=True)}
    land(7, "-again", entry(70, "a-7", "2023-03-01"), entry(71, "b-7", "2023-04-01"))
    run()
    new = [f for f in glob.glob(f"{store}/metrics/data/**/*.parquet", recursive=True) if f not in sizes]
    assert len(new) == 1 and all(os.path.getsize(f) == n for f, n in sizes.items())
    metrics = {r["company_id"]: float(r["value"]) for r in ingest.current_metrics(spark, store).collect()}
    assert metrics == {f"{c:010d}": 71.0 if c == 7 else float(c) for c in range(1, 41)}
    filings = {r["accn"]: str(r["filed"]) for r in ingest.filings_table(spark, store).read().collect()}
    assert filings["a-7"] == "2023-02-01" and filings["b-7"] == "2023-04-01" and len(filings) == 41

    def companies(name, sic, batch):
        tickers = spark.createDataFrame([(0, "1", "AA", name), (1, "1", "AB", "second"), (2, "2", "B", "Two")],
                                        "rank int, cik string, ticker string, title string")
        ingest.upsert_companies(spark, store, tickers, spark.createDataFrame([("1", sic)], "cik string, sic_description string"),
                                ("load", batch))
        return sorted(map(tuple, ingest.companies_table(spark, store).read().collect()))

    assert companies("One", "Oil", 0) == [("1", "AA", "One", "Oil"), ("2", "B", "Two", None)]
    assert companies("One Inc", None, 1) == [("1", "AA", "One Inc", None), ("2", "B", "Two", None)]


def test_filing_date_alone_is_updated(spark, tmp_path):
    table = ingest.filings_table(spark, str(tmp_path))
    schema = "accn string, company_id string, form string, filed date, fiscal_year int, fiscal_period string"
    for form, day in (("10-K", "2023-02-01"), ("10-Q", "2023-05-01")):
        table.upsert(spark.sql(f"select 'a' accn, '1' company_id, '{form}' form, date'{day}' filed, 2022 fiscal_year, 'FY' "
                               "fiscal_period").to(spark.createDataFrame([], schema).schema))
    [row] = table.read().collect()
    assert (row["form"], str(row["filed"])) == ("10-K", "2023-05-01")


def test_read_documents_of_one_name(spark, tmp_path):
    (tmp_path / "CIK0000000009.json").write_text("{}")
    assert cf.read_documents(spark, str(tmp_path)).first()["cik"] == "0000000009"
