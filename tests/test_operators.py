"""Metric, evaluation, attempt and response operators on small frames."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerframe.operators import attempts, evaluate, metrics, questions, responses, retrieval
from ledgerframe.sources import sinks, store

FM = "company_id long, metric string, fiscal_year int, fiscal_period string, value decimal(20,4), end_date date"
CO = "company_id long, ticker string, name string, sic_description string"


def companies(spark):
    return spark.createDataFrame([(1, "AAA", "Alpha Inc", "Banks"), (2, "BBB", "Beta Corp", "Software"),
                                  (3, "CCC", "Gamma LLC", "Banks")], CO)


def test_ranking_guard_incomplete_company_cannot_win(spark):
    fm = spark.createDataFrame([
        (1, "net_income", 2023, "FY", Decimal(10), None), (1, "revenue", 2023, "FY", Decimal(100), None),
        (2, "net_income", 2023, "FY", Decimal(90), None),                       # no revenue
        (3, "net_income", 2023, "FY", Decimal(5), None), (3, "revenue", 2023, "FY", Decimal(0), None),
    ], FM)
    top = metrics.top_ratio(fm, companies(spark), "net_income", "revenue", 2023, n=3, name="net_margin").collect()
    assert [r["ticker"] for r in top] == ["AAA"]
    unguarded = metrics.ratio(fm, companies(spark), "net_income", "revenue", 2023, guard=False, name="m").collect()
    assert {r["ticker"]: r["m"] for r in unguarded} == {"AAA": 0.1, "BBB": None, "CCC": None}


def test_yoy_gap_year_gives_no_row_and_qoq_orders_by_end_date(spark):
    d = dt.date.fromisoformat
    fm = spark.createDataFrame([
        (1, "revenue", 2021, "FY", Decimal(100), None), (1, "revenue", 2023, "FY", Decimal(150), None),
        (2, "revenue", 2022, "FY", Decimal(100), None), (2, "revenue", 2023, "FY", Decimal(110), None),
        (2, "revenue", 2023, "Q1", Decimal(10), d("2022-12-31")), (2, "revenue", 2022, "Q4", Decimal(20), d("2022-09-30")),
    ], FM)
    g = metrics.yoy_growth(fm, companies(spark), "revenue", 2023).collect()
    assert [(r["ticker"], r["yoy_growth_pct"]) for r in g] == [("BBB", 10.0)]
    q = metrics.qoq_growth(fm, companies(spark), "revenue").collect()
    assert [(r["fiscal_period"], r["qoq_growth_pct"]) for r in q] == [("Q4", None), ("Q1", -50.0)]


def test_capped_flags_exactly(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    assert all(not r["truncated"] for r in sinks.capped(df, ["k"], n=5).collect())
    rows = sinks.capped(df, ["k"], n=4).collect()
    assert len(rows) == 4 and all(r["truncated"] for r in rows)


def test_upsert_keeps_null_updates_and_is_idempotent(spark):
    schema = "k long, v string, w string"
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema)
    updates = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], schema)
    once = sinks.upsert(target, updates, ["k"], ["v"])
    twice = sinks.upsert(once, updates, ["k"], ["v"])
    expect = {(1, "a", "x"), (2, None, "y"), (3, "c", "q")}
    assert {tuple(r) for r in once.collect()} == expect
    assert {tuple(r) for r in twice.collect()} == expect


def test_upsert_snapshot_never_overwrites_its_input(spark, tmp_path):
    schema = "k long, v string"
    table = str(tmp_path / "t")
    first = sinks.upsert_snapshot(spark, table, spark.createDataFrame([(1, "a")], schema), ["k"], ["v"])
    second = sinks.upsert_snapshot(spark, table, spark.createDataFrame([(1, "b"), (2, "c")], schema), ["k"], ["v"])
    assert first != second and sinks.current_snapshot(spark, table) == second
    assert {tuple(r) for r in spark.read.parquet(second).collect()} == {(1, "b"), (2, "c")}
    assert {tuple(r) for r in spark.read.parquet(first).collect()} == {(1, "a")}
    # a job that failed half-way left a folder without its end mark: it is passed over
    (tmp_path / "t" / "snapshot-000000000003").mkdir()
    assert sinks.current_snapshot(spark, f"file:{table}") == f"file:{second}"
    fourth = sinks.upsert_snapshot(spark, f"file:{table}", spark.createDataFrame([(3, "d")], schema), ["k"], ["v"])
    assert fourth.endswith("snapshot-000000000004")
    assert {tuple(r) for r in spark.read.parquet(fourth).collect()} == {(1, "b"), (2, "c"), (3, "d")}


def test_materialized_tables_are_reused_until_an_input_changes(spark, tmp_path):
    source = f"file:{tmp_path}/in"
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source)

    def read():
        key = f"reuse_{tmp_path.name}"
        return sorted(r["id"] for r in store.materialized(spark, key, build, [source], spread_by=["id"]).collect())

    spark.range(3).write.parquet(source)
    assert read() == read() == [0, 1, 2] and len(built) == 1
    spark.range(3, 5).write.mode("append").parquet(source)
    assert read() == [0, 1, 2, 3, 4] and len(built) == 2


def test_rebuild_replaces_the_whole_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.rebuild(spark.range(5), path)
    sinks.rebuild(spark.range(2), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1]


def test_rowsets_match_rules():
    # superset of columns passes; rows in any order
    assert evaluate.rowsets_match([("AAPL",)], [("AAPL", "Apple", 1.0)], "exact")
    assert evaluate.rowsets_match([(1.0,), (2.0,)], [(2.0,), (1.0,)], "exact")
    # relative tolerance: 0.9 % off passes, 1.1 % does not
    assert evaluate.rowsets_match([(100.0,)], [(100.9,)], "relative")
    assert not evaluate.rowsets_match([(100.0,)], [(101.1,)], "relative")
    # a duplicate expected cell cannot reuse one actual cell
    assert not evaluate.rowsets_match([(5.0, 5.0)], [(5.0, 6.0)], "exact")
    # count mismatch; numeric strings; NULL matches NULL; booleans stay symbolic
    assert not evaluate.rowsets_match([(1.0,)], [(1.0,), (1.0,)], "exact")
    assert evaluate.rowsets_match([("391035000000",)], [(391035000000.0,)], "exact")
    assert evaluate.rowsets_match([(None,)], [(None,)], "exact")
    assert not evaluate.rowsets_match([(True,)], [(1.0,)], "exact")


def test_rowset_match_cogroup(spark):
    exp = spark.createDataFrame([("q1", "AAA", 1.0), ("q2", "BBB", 2.0), ("q3", "C", 1.0)],
                                "item_id string, label string, value double")
    act = spark.createDataFrame([("q1", "AAA", 1.005), ("q2", "BBB", 3.0), ("q4", "D", 1.0)],
                                "item_id string, label string, value double")
    got = {r["item_id"]: r["matched"] for r in evaluate.rowset_match(exp, act).collect()}
    assert got == {"q1": True, "q2": False, "q3": False, "q4": False}


def test_table_diff(spark):
    e = spark.createDataFrame([(1, 100.0, "a"), (2, 50.0, "b"), (3, 1.0, "c")], "k long, x double, s string")
    a = spark.createDataFrame([(1, 100.5, "a"), (2, 60.0, "b"), (4, 1.0, "d")], "k long, x double, s string")
    got = {r["k"]: (r["status"], r["columns"]) for r in evaluate.table_diff(e, a, ["k"], ["x", "s"]).collect()}
    assert got == {2: ("different", "x"), 3: ("missing", ""), 4: ("extra", "")}


def test_attempt_rollup_and_narrative(spark):
    log = spark.createDataFrame([
        ("r1", 2, "success", None, 200), ("r1", 1, "execution_error", "column x does not exist", 100),
        ("r2", 1, "guard_rejected", "not a SELECT", 10), ("r2", 2, "execution_error", "boom", 20),
        ("r2", 3, "empty_result", None, 30),
    ], "request_id string, attempt_number int, outcome string, error_message string, duration_ms long")
    roll = {r["request_id"]: r for r in attempts.attempt_rollup(log).collect()}
    assert roll["r1"]["outcomes"] == "execution_error,success" and roll["r1"]["final_outcome"] == "success"
    assert roll["r2"]["attempts_used"] == 3 and roll["r2"]["total_duration_ms"] == 60
    text = {r["request_id"]: r["answer"] for r in attempts.failure_narrative(log).collect()}
    assert list(text) == ["r2"]
    assert text["r2"].startswith("I could not answer this question after 3 attempt(s). Attempt 1 was rejected "
                                 "by the SQL safety guard (not a SELECT). Attempt 2 failed during execution (boom)."
                                 " Attempt 3 ran successfully but returned no rows.")


def test_extract_blocks_six_responses(spark):
    nl = "\n"
    rows = [
        (1, "Here:" + nl + "```sql" + nl + "SELECT 1" + nl + "```"),
        (2, "```" + nl + "SELECT 2" + nl + "```"),
        (3, "```postgresql" + nl + "SELECT 3" + nl + "```"),
        (4, "Sure. select 4 from t"),
        (5, "CANNOT_ANSWER: no share prices are stored" + nl + "```sql" + nl + "SELECT 5" + nl + "```"),
        (6, "I am not sure about that."),
    ]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["kind"], r["extracted"]) for r in responses.extract_blocks(df).collect()}
    assert got == {1: ("sql_fence", "SELECT 1"), 2: ("any_fence", "SELECT 2"), 3: ("any_fence", "SELECT 3"),
                   4: ("bare", "select 4 from t"), 5: ("refusal", "no share prices are stored"),
                   6: ("no_match", None)}


def test_classify_all_null_is_empty_one_null_column_is_not(spark):
    linked = spark.createDataFrame([
        ("a", "lookup", 1, "revenue", None, 2023, 2023), ("b", "lookup", 1, "revenue", None, 2023, 2023),
        ("c", "lookup", 1, None, None, 2023, 2023), ("d", "lookup", 1, "revenue", None, 2019, 2019),
    ], "item_id string, intent string, company_id long, metric string, num_metric string, "
       "fiscal_year int, year_from int").selectExpr("*", "CAST(NULL AS string) AS sector")
    answers = spark.createDataFrame([("a", "AAA", None), ("b", None, 5.0), ("b", "X", None)],
                                    "item_id string, label string, value double")
    got = {r["item_id"]: r["outcome"] for r in questions.classify_outcomes(linked, answers, 2020, 2024).collect()}
    assert got == {"a": "empty_result", "b": "success", "c": "unanswerable", "d": "unanswerable"}


def test_rowsets_need_no_lucky_order():
    # A greedy pairing could spend the second actual row on the first expected one.
    assert evaluate.rowsets_match([(100.0,), (101.0,)], [(101.0, "x"), (100.0, "y")], "relative")
    assert evaluate.rowsets_match([(1.0,), (1.0,)], [(1.0, 2.0), (3.0, 1.0)], "exact")
    assert not evaluate.rowsets_match([(float("nan"),)], [(float("nan"),)], "exact")
    assert evaluate.rowsets_match([], [])


def test_rowset_match_counts_and_empty_sides(spark):
    exp = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "item_id string, v string")
    act = spark.createDataFrame([("b", "2"), ("b", "1.001"), ("c", "5")], "item_id string, v string")
    got = {r["item_id"]: (r["expected_rows"], r["actual_rows"], r["matched"])
           for r in evaluate.rowset_match(exp, act).collect()}
    assert got == {"a": (1, 0, False), "b": (2, 2, True), "c": (0, 1, False)}


def test_gate_without_held_out_items_fails(spark):
    board = spark.createDataFrame([("dev", 3, 3, 1.0)], "split string, items long, passed long, accuracy double")
    row = evaluate.gate(board).first()
    assert row["gate_passed"] is False and row["gated_items"] == 0


def test_rank_is_exact_not_rounded(spark):
    co = spark.createDataFrame([(1, "AAA", "A"), (2, "BBB", "B")], "company_id long, ticker string, name string")
    fm = spark.createDataFrame([(1, "net_income", 12345601.0), (1, "revenue", 1e8), (2, "net_income", 12345639.0),
                                (2, "revenue", 1e8)], "company_id long, metric string, value double").selectExpr(
        "*", "2020 AS fiscal_year", "'FY' AS fiscal_period")
    assert metrics.top_ratio(fm, co, "net_income", "revenue", 2020).first()["ticker"] == "BBB"


def test_long_names_and_three_companies(spark):
    co = spark.createDataFrame([
        (1, "AAA", "The Very Long Company Name Incorporated", "x"), (2, "BBB", "Beta", "x"), (3, "CCC", "Gamma", "x")],
        "company_id long, ticker string, name string, sic_description string")
    qs = spark.createDataFrame([
        ("a", "What was the revenue of The Very Long Company Name Incorporated in fiscal 2020?"),
        ("b", "Compare the revenue of Beta, Gamma and AAA in fiscal 2020"),
        ("c", "How much did revenue of Beta grow from fiscal 2018 to fiscal 2020?")], "item_id string, question string")
    linked = questions.link_entities(qs, co)
    ids = {r["item_id"]: r["company_ids"] for r in linked.collect()}
    assert ids == {"a": [1], "b": [2, 3, 1], "c": [2]}
    fm = spark.createDataFrame([(c, "revenue", y, "FY", 10.0 * c * (y - 2016)) for c in (1, 2, 3) for y in range(2018, 2021)],
                               "company_id long, metric string, fiscal_year int, fiscal_period string, value double")
    got = {}
    for r in questions.answer_batch(linked, fm, co).collect():
        got.setdefault(r["item_id"], {})[r["label"]] = r["value"]
    assert got["a"] == {"AAA": 40.0} and got["b"] == {"BBB": 80.0, "CCC": 120.0, "AAA": 40.0}
    assert got["c"] == {"BBB": 100.0}


def test_topk_edges(spark):
    schema = "{} long, embedding array<double>"
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, None]),
                                  (6, [1.0, 0.1]), (0, [2.0, 0.0])], schema.format("doc_id"))
    none = spark.createDataFrame([], schema.format("query_id"))
    assert retrieval.topk_cosine(none, docs, 2).count() == 0
    some = spark.createDataFrame([(9, [3.0, 0.0]), (8, None)], schema.format("query_id"))
    rows = retrieval.topk_cosine(some, docs, 2, doc_rows=2).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in rows) == [(9, 1, 0), (9, 2, 1)]


def test_refusal_after_unicode_blank(spark):
    df = spark.createDataFrame([(1, "\u00a0CANNOT_ANSWER:\u2003no data\u00a0")], "id long, text string")
    row = responses.extract_blocks(df).first()
    assert (row["kind"], row["extracted"]) == ("refusal", "no data")


def test_validate_questions(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "abc"), (3, "x" * 1001), (4, None)], "id long, text string")
    got = {r["id"]: r["reject_reason"] for r in questions.validate_questions(df).collect()}
    assert got == {1: "too_short", 2: None, 3: "too_long", 4: "missing"}


def test_broad_coverage_threshold_and_fallback(spark):
    from ledgerframe.operators import coverage
    rows = [(c, "revenue", y, "FY") for y, n in [(2021, 10), (2022, 9), (2023, 4)] for c in range(n)]
    rows += [(0, "revenue", 2024, "Q1")]
    fm = spark.createDataFrame(rows, "company_id long, metric string, fiscal_year int, fiscal_period string")
    r = coverage.broad_coverage(fm, threshold=0.5).first()
    assert (r["peak_fy_companies"], r["last_broad_year"]) == (10, 2022)
    only_q = fm.where("fiscal_period <> 'FY'")
    r = coverage.broad_coverage(only_q, threshold=0.5).first()
    assert (r["peak_fy_companies"], r["last_broad_year"]) == (0, 2024)
    assert coverage.companies_with_latest_fy(fm).first()["n_with_fy_latest"] == 0


def test_split_valid_and_json_lines(spark):
    import json
    kept, rejects = questions.split_valid(spark.createDataFrame([(1, "What?"), (2, None), (3, "no")], "id int, text string"))
    assert [r["id"] for r in kept.collect()] == [1]
    assert {r["id"]: r["reject_reason"] for r in rejects.collect()} == {2: "missing", 3: "too_short"}
    rows = spark.sql("select cast(1.5 as decimal(9, 2)) d, date'2020-01-02' t, 'x' s")
    assert [json.loads(r["json"]) for r in sinks.to_json_lines(rows).collect()] == [{"d": 1.5, "t": "2020-01-02", "s": "x"}]


def test_corpus_with_an_injected_encoder_through_to_context(spark):
    import numpy as np
    corpus = spark.createDataFrame([(k, "note", f"title {k}", text) for k, text in enumerate(
        ["apples and pears", "ships at sea", "pears", None, "a sea of apples"])], "doc_id long, doc_type string, title string, content string")

    def encoder(texts):
        return np.array([[t.count(w) + 1e-3 for w in ("apples", "pears", "sea")] for t in texts])

    docs = retrieval.embed_documents(corpus, "content", encoder=encoder, batch_size=2).select("doc_id", "embedding")
    asked = spark.createDataFrame([(10, "pears"), (11, "sea")], "query_id long, question string")
    queries = retrieval.embed_documents(asked, "question", encoder=encoder).select("query_id", "embedding")
    top = retrieval.topk_cosine(queries, docs, 2)
    first = {r["query_id"]: r["doc_id"] for r in top.where("rank = 1").collect()}
    assert first == {10: 2, 11: 1}
    packed = {r["query_id"]: r["context"] for r in retrieval.context_pack(top, corpus).collect()}
    assert packed[10].startswith("[note] title 2\npears\n\n[note] title 0\n")
    with pytest.raises(Exception, match="encoder returned 1 vectors for 2 texts"):
        retrieval.embed_documents(corpus.coalesce(1), "content", encoder=lambda t: np.zeros((1, 3)), batch_size=2).collect()


def test_parts_of_equal_symbols_match_as_whole_items_do(spark):
    import random
    pick = random.Random(7)
    cells = ["a", "b", None, "true", "1", "1.005", "1.011", "-3", "-3.02", "0", "inf", "nan", " 2e1 ", "20.1", "x y"]
    exp, act, want = [], [], {}
    for item in range(400):
        width, n = pick.randint(1, 3), pick.randint(1, 5)
        pool = pick.sample(cells, pick.randint(1, 6))
        left = [[pick.choice(pool) for _ in range(3)][:width] + ["z"] * (3 - width) for _ in range(n)]
        right = [pick.sample(r, 3) for r in left]
        if pick.random() < 0.6:
            for r in right:
                at = pick.randrange(3)
                near = {"1": "1.005", "1.005": "1.011", "-3": "-3.02", "20.1": "20", "1.011": "1"}
                r[at] = near.get(r[at], r[at])
        if pick.random() < 0.2:
            right[0][0] = pick.choice(cells)
        pick.shuffle(right)
        check = pick.choice(["relative", "exact"])
        exp += [(str(item), check, *r) for r in left]
        act += [(str(item), *r) for r in right]
        want[str(item)] = evaluate.rowsets_match(left, right, check)
    e = spark.createDataFrame(exp, "item_id string, check string, p string, q string, r string")
    a = spark.createDataFrame(act, "item_id string, p string, q string, r string")
    got = {r["item_id"]: r["matched"] for r in evaluate.rowset_match(e, a, check="check", expected_cols=list("pqr")).collect()}
    assert got == want and 50 < sum(want.values()) < 390


def test_an_item_of_many_rows(spark):
    from pyspark.sql import functions as F
    rows = spark.range(100_000).select(F.lit("big").alias("item_id"), F.concat(F.lit("t"), F.col("id") % 20_000).alias("t"),
                                       (F.col("id") * 1.5 + 1).alias("v"))
    same = rows.withColumn("v", F.col("v") * 1.004)
    off = rows.withColumn("v", F.when(F.col("v") == 1.0, 2.0).otherwise(F.col("v")))
    plain = rows.select("item_id", "v", (F.col("v") * 2).alias("w"))
    assert evaluate.rowset_match(rows, same).first()["matched"]
    assert not evaluate.rowset_match(rows, off).first()["matched"]
    assert evaluate.rowset_match(plain, plain.select("item_id", F.col("w").alias("a"), (F.col("v") * 0.997).alias("b"))).first()["matched"]
