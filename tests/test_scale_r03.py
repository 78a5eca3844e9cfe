"""Work that must grow with the rows and not with the number of small groups."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerframe.streaming import admission


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_admission_streams_light_keys_and_cuts_heavy_ones(spark):
    pick = random.Random(5)
    rows = [(e, 7 if e % 3 else 100 + e % 40, pick.randrange(20_000)) for e in range(1500)]
    rows += [(2000, None, 4), (2001, 7, None), (None, 7, 9), (2002, 7, 9), (2002, 7, 9)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, s long").select(
        "event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    whole = admission.admission_batch(frame, window_seconds=60)
    cut = admission.admission_batch(frame, window_seconds=60, chunk_windows=2, together=3, heavy_hits=100)
    assert "FlatMapCoGroupsInPandas" not in _plan(whole)  # no Python call for each key and chunk
    assert "FlatMapCoGroupsInPandas" in _plan(cut)

    def said(df):
        return sorted(((r.event_id, r.key, r.ts, r.admitted) for r in df.collect()), key=str)

    assert said(whole) == said(cut) and len(said(whole)) == len(rows)
    own = sorted(((s, e is None, e or 0) for e, k, s in rows if k == 7 and s is not None))
    ok, _ = admission.admit_sequence(np.array([s for s, *_ in own]) * 1_000_000, 3, 60_000_000)
    assert sum(r[3] for r in said(whole) if r[1] == 7) == ok.sum()


def test_row_sets_are_paired_without_a_python_call_for_each_item(spark):
    from ledgerframe.operators import evaluate

    def frame(rows, cols):
        return spark.createDataFrame(rows, "item_id string, " + ", ".join(f"{c} string" for c in cols))

    sides = {  # item: expected rows, actual rows, matched
        "near": ([("a", "100"), ("a", "2e2")], [("200.5", "a"), ("a", " 100.9 ")], True),
        "far": ([("a", "100")], [("a", "101.5")], False),
        "names": ([("a", "100")], [("b", "100")], False),
        "more": ([("a", "1")], [("a", "1"), ("a", "1")], False),
        "nan": ([("a", "nan")], [("a", "NaN")], False),
        "infinite": ([("a", "inf")], [("a", "Infinity")], True),
        "opposite": ([("a", "inf")], [("a", "-inf")], False),
        "null": ([("a", None)], [("a", None)], True),
        "crossed": ([("100", "5"), ("100.5", "1")], [("100", "1"), ("100.5", "5")], True),
        "crossed too far": ([("100", "5"), ("100.5", "1")], [("100", "1"), ("100.5", "9")], False),
        "only expected": ([("a", "1")], [], False), "only actual": ([], [("a", "1")], False),
        None: ([("a", "1")], [("a", "1")], None)}
    exp = frame([(i, *r) for i, (e, _, _) in sides.items() for r in e], "xy")
    act = frame([(i, *r) for i, (_, a, _) in sides.items() for r in a], "xy")
    got = evaluate.rowset_match(exp, act)
    found = {r.item_id: (r.expected_rows, r.actual_rows, r.matched) for r in got.collect() if r.item_id}
    assert found == {i: (len(e), len(a), ok) for i, (e, a, ok) in sides.items() if i}
    assert sorted(tuple(r)[1:] for r in got.collect() if r.item_id is None) == [(0, 1, False), (1, 0, False)]
    exact = {r.item_id: r.matched for r in evaluate.rowset_match(exp, act, check="exact").collect()}
    assert {i for i, ok in exact.items() if ok} == {"null", "infinite"}
    single = frame([("near", "a", "100")], "xy")
    assert "Pandas" not in _plan(evaluate.rowset_match(single, frame([("near", "a", "100.4")], "xy")))


def test_the_gate_computes_its_board_once(spark):
    from ledgerframe.operators import evaluate

    board = spark.createDataFrame([("dev", 4, 3, 0.75), ("holdout", 10, 9, 0.9), (None, 2, 2, 1.0)],
                                  "split string, items long, passed long, accuracy double")
    out = evaluate.gate(board)
    assert "ubquery" not in _plan(out)
    assert tuple(out.first()) == (0.9, 10, 1, 0.75, 0.85, True)
    assert tuple(evaluate.gate(board.where("split = 'dev'")).first()) == (None, 0, 0, 0.75, 0.85, False)


def test_facts_meet_the_questions_in_few_joins(spark):
    from ledgerframe.operators import questions

    co = spark.createDataFrame([(1, "AAA", "Alpha", "Steel"), (2, "BBB", "Beta", "steel"), (3, "CCC", "Gamma", None)],
                               "company_id long, ticker string, name string, sic_description string")
    asked = {"lookup": "What was Alpha's revenue in fiscal 1999?", "null": "What was Gamma's revenue in fiscal 1999?",
             "quarter": "What was Beta's revenue in the second quarter of fiscal 2000?",
             "ratio": "What were the net margin of Alpha and Beta for fiscal year 2000?",
             "growth": "How much did Beta's revenue grow in fiscal 2000?",
             "change": "How much did Alpha's net income change between fiscal 1998 and fiscal 2000?",
             "latest": "What was Gamma's latest annual revenue?", "sum": "What was the combined revenue of Alpha and Beta in fiscal 1998?",
             "sector": "What was the total revenue of steel companies in fiscal 2000?",
             "top": "What were the top two companies by total assets in fiscal 2000?",
             "fast": "Which company had the fastest growing revenue in fiscal 2000?",
             "margin": "Which company had the highest net margin in fiscal 2000?"}
    linked = questions.link_entities(spark.createDataFrame(list(asked.items()), "item_id string, question string"), co).checkpoint()
    # Value: 1000 * company + 10 * (year - 1990), net income a tenth, quarters a hundredth; Gamma's 1999 is null.
    fm = spark.range(225).selectExpr(
        "1 + id % 3 AS company_id", "element_at(array('revenue', 'net_income', 'total_assets', 'total_liabilities', 'eps_diluted'), "
        "cast(1 + id div 3 % 5 AS int)) AS metric", "cast(1998 + id div 15 % 3 AS int) AS fiscal_year",
        "element_at(array('FY', 'Q1', 'Q2', 'Q3', 'Q4'), cast(1 + id div 45 AS int)) AS fiscal_period").selectExpr(
        "*", "CASE WHEN company_id = 3 AND fiscal_year = 1999 THEN NULL ELSE (1000.0D * company_id + 10 * (fiscal_year - 1990)) "
        "/ IF(metric = 'net_income', 10, 1) / IF(fiscal_period = 'FY', 1, 100) END AS value")
    answers = questions.answer_batch(linked, fm, co)
    got = {}
    for r in answers.collect():
        got.setdefault(r["item_id"], []).append((r["label"], r["value"] if r["value"] is None else round(r["value"], 6)))
    assert {k: sorted(v) for k, v in got.items()} == {
        "lookup": [("AAA", 1090.0)], "null": [("CCC", None)], "quarter": [("BBB", 21.0)], "ratio": [("AAA", 0.1), ("BBB", 0.1)],
        "growth": [("BBB", round(10 / 2090 * 100, 6))], "change": [("AAA", 2.0)], "latest": [("CCC", 3100.0)],
        "sum": [("combined", 3160.0)], "sector": [("steel", 3200.0)], "top": [("BBB", 2100.0), ("CCC", 3100.0)],
        "fast": [("AAA", round(10 / 1090 * 100, 6))], "margin": [("AAA", 0.1)]}
    # One read for the latest values and three for the kinds of rankings; the rest has met the facts in one join.
    assert answers._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 4
    # Only metrics and periods that are asked for travel.
    some = questions.read_by(fm, linked.where("item_id = 'quarter'"))
    assert sorted(tuple(r) for r in some.select("metric", "fiscal_period").distinct().collect()) == [("revenue", "FY"), ("revenue", "Q2")]
