from pyspark.sql import functions as F

from ledgerframe.llm import pii

PHONE = pii.KINDS.index("phone")


def test_rare_kinds_are_calibrated_beside_many_digit_runs(spark, docs):
    runs = [(k, " x ".join(f"{10 ** 13 + 7919 * (20 * k + j)}" for j in range(20))) for k in range(100)]
    rows = runs + [(200 + k, f"call +49 170 {1000000 + k * 37}") for k in range(8)]
    found = docs(rows + [(300, "call 030 123-4567")]).select(
        "doc_id", pii.candidates(F.col("text")).alias("candidates"))
    selector = pii.fit_selector(found, sample=80)
    assert selector is not None and f"WHEN {PHONE} THEN double('infinity')" not in selector
    spans = found.where("doc_id = 300").select(pii.spans(selector).alias("s")).first()["s"]
    assert [(s["start"], s["kind"], s["stop"]) for s in spans] == [(5, PHONE, 17)]


def test_dropped_spans_do_not_block_later_ones(spark):
    none = tuple(0.0 for _ in pii.FEATURES)
    rows = [(start, 0, stop, True, False, none) for start, stop in [(0, 10), (5, 15), (12, 20), (12, 18), (20, 25)]]
    frame = spark.createDataFrame([(rows,)], f"candidates array<{pii.CANDIDATE}>")
    spans = frame.select(pii.spans("true").alias("s")).first()["s"]
    assert [(s["start"], s["stop"]) for s in spans] == [(0, 10), (12, 20), (20, 25)]
