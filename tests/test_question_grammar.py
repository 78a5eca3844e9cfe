"""Leftmost-longest linking against brute force, and what is not read is not answered."""

import random

import pytest

from ledgerframe.operators import question_grammar, questions

CO = "company_id long, ticker string, name string, sic_description string"
COMPANIES = [(1, "ALP", "Alpha", "oil refining"), (2, "ALB", "Alpha Beta", "oil refining"), (3, "BET", "Beta", "retail"),
             (4, "BG", "Beta Gamma Delta", "retail"), (5, "GAM", "Gamma", "oil"), (6, "A", "On Holding", "retail"), (7, "INC", "Delta.com, Inc.", "retail")]


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame(COMPANIES, CO)


def linked(spark, companies, *asked):
    frame = spark.createDataFrame([(f"{k:03d}", q) for k, q in enumerate(asked)], "item_id string, question string")
    return questions.link_entities(frame, companies)


def answers(spark, companies, *asked):
    rows = [(c, m, y, "FY", float(100 * c + 10 * (y - 2018) + (m == "revenue") * 7 * c * (y - 2017)))
            for c in range(1, 6) for m in ("revenue", "net_income", "total_assets", "total_liabilities") for y in range(2018, 2022)]
    fm = spark.createDataFrame(rows, "company_id long, metric string, fiscal_year int, fiscal_period string, value double")
    link = linked(spark, companies, *asked)
    link = spark.createDataFrame(link.collect(), link.schema)  # read by many branches
    got = {k: [] for k in range(len(asked))}
    for r in questions.answer_batch(link, fm, companies).collect():
        got[int(r["item_id"])].append((r["label"], r["value"]))
    out = {int(r["item_id"]): r["outcome"] for r in questions.classify_outcomes(
        link, questions.answer_batch(link, fm, companies), 2018, 2021).collect()}
    value = {(c, m, y): v for c, m, y, _, v in rows}
    return got, out, value


def brute_spans(words, aliases):
    at, out = 0, []
    while at < len(words):
        for n in range(len(words) - at, 0, -1):
            if " ".join(words[at:at + n]) in aliases:
                out.append((at, n))
                at += n
                break
        else:
            at += 1
    return out


def test_leftmost_longest_is_brute_force(spark, companies):
    pick = random.Random(1)
    said = ["alpha", "beta", "gamma", "delta", "oil", "refining", "most", "recent", "net", "income", "odd"]
    asked = [" ".join(pick.choice(said) for _ in range(pick.randint(1, 12))) for _ in range(150)]
    known = {r["alias"] for r in question_grammar.aliases(companies).where("kind <> 'ticker'").collect()}
    frame = spark.createDataFrame([(f"{k:03d}", q) for k, q in enumerate(asked)], "item_id string, question string")
    for r in question_grammar.spans(frame, companies).collect():
        words = asked[int(r["item_id"])].split()
        assert [(s["pos"], s["n"]) for s in r["kept"]] == brute_spans(words, known), words


def test_nested_names_and_tickers(spark, companies):
    got = {r["question"]: (r["company_ids"], r["intent"], r["unread"]) for r in linked(
        spark, companies, "What was Alpha Beta's revenue in fiscal 2020?", "Compare Alpha, Beta and ALB revenue in fiscal 2020",
        "What was Delta.com Inc's revenue in fiscal 2020?", "What was the revenue of Delta.com, Inc. in fiscal 2020?",
        "What was A's revenue in fiscal 2020?", "What was a revenue of beta gamma delta in fiscal 2020?").collect()}
    assert list(got.values()) and got["What was Alpha Beta's revenue in fiscal 2020?"] == ([2], "lookup", None)
    assert got["Compare Alpha, Beta and ALB revenue in fiscal 2020"] == ([1, 3, 2], "comparison", None)
    for q in ("What was Delta.com Inc's revenue in fiscal 2020?", "What was the revenue of Delta.com, Inc. in fiscal 2020?"):
        assert got[q] == ([7], "lookup", None)
    assert got["What was A's revenue in fiscal 2020?"] == ([6], "lookup", None)
    assert got["What was a revenue of beta gamma delta in fiscal 2020?"] == ([4], "lookup", None)


def test_question_classes(spark, companies):
    asked = [
        "Which three companies had the highest revenue in fiscal 2020?",
        "What were the top 2 companies by net income in fiscal 2019?",
        "Which company had the fastest growing revenue in fiscal 2020?",
        "What was the combined revenue of Alpha, Gamma and Beta in fiscal 2020?",
        "What were the net profit margin of Alpha and Beta in fiscal 2021?",
        "What was Gamma's ratio of total liabilities to total assets at the end of fiscal 2020?",
        "By how many dollars did Beta's net income change between fiscal 2018 and fiscal 2021?",
        "What was the combined revenue of all oil refining companies in fiscal 2020?",
        "Which of the covered companies had the smallest total assets in fiscal 2019?",
        "What is Gamma's latest annual revenue?", "How profitable was Beta in fiscal 2020?",
        "How much did the revenue of Alpha and Gamma grow from fiscal 2018 to fiscal 2020, in percent?",
        "Which retail company had the lowest net income in fiscal 2020?"]
    got, out, v = answers(spark, companies, *asked)
    assert set(out.values()) == {"success"}, out
    r20 = {c: v[c, "revenue", 2020] for c in range(1, 6)}
    assert got[0] == [("GAM", r20[5]), ("BG", r20[4]), ("BET", r20[3])]
    assert [label for label, _ in got[1]] == ["GAM", "BG"]
    growth = {c: (r20[c] / v[c, "revenue", 2019] - 1) * 100 for c in range(1, 6)}
    best = max(growth, key=lambda c: (growth[c], -c))
    assert got[2][0][1] == pytest.approx(growth[best])
    assert got[3] == [("combined", r20[1] + r20[3] + r20[5])]
    assert sorted(got[4]) == [("ALP", v[1, "net_income", 2021] / v[1, "revenue", 2021]),
                              ("BET", v[3, "net_income", 2021] / v[3, "revenue", 2021])]
    assert got[5] == [("GAM", 1.0)]
    assert got[6] == [("BET", v[3, "net_income", 2021] - v[3, "net_income", 2018])]
    assert got[7] == [("oil refining", r20[1] + r20[2])]
    assert got[8] == [("ALP", v[1, "total_assets", 2019])]
    assert got[9] == [("GAM", v[5, "revenue", 2021])] and got[10] == [("BET", v[3, "net_income", 2020])]
    assert sorted(label for label, _ in got[11]) == ["ALP", "GAM"]
    assert got[12] == [("BET", v[3, "net_income", 2020])]


def test_what_is_not_read_is_not_answered(spark, companies):
    asked = ["How much did Alpha spend on research and development in fiscal 2020?",
             "What was Alpha's gross margin in fiscal 2020?", "What was Alpha's highest revenue in fiscal 2020?",
             "What was Alpha's revenue and net income in fiscal 2020?", "What was 3 Alpha's revenue in fiscal 2020?",
             "What was Alpha's revenue in fiscal 2018, 2019 and 2020?", "What was the average revenue of Alpha and Beta in 2020?",
             "Compare Alpha revenue in fiscal 2020", "", "What was the average rainfall in Mordor during the Third Age?"]
    got, out, _ = answers(spark, companies, *asked)
    assert set(out.values()) <= {"unsupported", "unanswerable"} and not any(got.values())
    assert [k for k, o in out.items() if o != "unsupported"] == [8]  # nothing to read, and no company
    more = answers(spark, companies, "What was Mordor's revenue in fiscal 2020?", "What was Alpha's revenue in fiscal 2050?")[1]
    assert more == {0: "unsupported", 1: "unanswerable"}
