"""Operators 3, 7, 8, 9 and the pipeline: brute force and held-out labels."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import chat, pii, quality_lm, toxicity
from ledgerframe.llm.common import table

SF = "/root/testdata/sf0.01"
# The stated base patterns.
STATED = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
LABELS = "doc_id long, quality int, toxic int"


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9) for k, v in enumerate(values)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate(STATED):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == 3 and 10 <= len(digits) <= 15)
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_stated_ones(spark, docs):
    pick = random.Random(6)
    parts = ["a@b.c", "a@b.c_d@e.f", "@", ".", "-", " ", "x.y%z@q-r.com", "1.2.3.4", "1.2.3.4.5.6.7.8",
             "256.1.1.1", "007.0.0.255", "4041894974608795", "4041 8949-7460 8795", "4111111111111112",
             "+1 (988) 555-2485", "+12", "++1.2.3.4.5.6.7.8.9.10", "(988) 555-2485", "é", "日", "1", "12 ", "\n",
             "+4041894974608795", "é@a.b", "_", "5500005555555559 1"]
    rows = [(0, None), (1, ""), (2, "a" * 100000), (3, "1" * 50000), (4, "+" + "1 " * 20000), (4, "a@b.c"),
            (5, "1.2." * 20000), (None, "a@b.c")]
    rows += [(10 + k, "".join(pick.choice(parts) for _ in range(pick.randint(1, 12)))) for k in range(1500)]
    found = pii.find(docs(rows)).collect()
    assert len(found) == len(rows)
    got = sorted((r["doc_id"] or -1, tuple((s["start"], s["kind"], s["stop"]) for s in r["base_spans"]))
                 for r in found)
    assert got == sorted((i or -1, tuple(base_spans(t or ""))) for i, t in rows)
    for r in found:
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["spans"]}
    assert pii.digests(pii.find(docs([]))).count() == 0


def test_digest_and_redaction(spark, docs):
    given_docs = docs([(1, "mail a.b@c.de or +1 (988) 555-2485, é 1.2.3.4"), (2, None), (3, "clean")])
    row = pii.digests(pii.find(given_docs)).where("doc_id = 1").first()
    want = "email:5:13,phone:17:34,ip:38:45"
    assert row["spans"] == want and row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(given_docs).collect()}
    assert texts == {1: "mail [EMAIL] or [PHONE], é [IP]", 2: None, 3: "clean"}
    plan = pii.redacted(given_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(chat.CONTROL + ["\\", "<", "[", "s>", "TURN]", "/", "é", "x", "\n"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
    line = chat.render_turn(text, text) + chat.render_turn("assistant", text)
    assert [(r, t) for r, t, _, _ in chat.parse(line)] == [(text, text), ("assistant", text)]


def test_events_fold(spark):
    rows = [(1, 0, 1, 0, "open", "user", ""), (1, 0, 1, 1, "delta", None, "Hel"), (1, 0, 1, 2, "delta", None, "lo"),
            (1, 1, 1, 3, "open", "assistant", ""), (1, 1, 1, 4, "delta", None, "bad"),
            (1, 1, 1, 5, "regenerate", None, None), (1, 1, 1, 7, "delta", None, "!"), (1, 1, 1, 6, "delta", None, "ok"),
            (1, 2, 1, 8, "open", "user", "x"), (1, 2, 1, 9, "delete", None, None), (1, 2, 1, 10, "delta", None, "late"),
            (1, 3, 1, 11, "open", "user", ""), (1, 3, 1, 12, "edit", None, "new"), (1, 3, 1, 13, "delta", None, "er"),
            (1, 4, 1, 14, "delta", None, "no role"), (2, None, 1, 0, "open", None, "t"), (2, None, 1, 0, None, "u", "t")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, copy long, seq long, kind string, role string, text string")
    got = sorted(((r["conv_id"], r["turn"] if r["turn"] is not None else -1, r["role"], r["text"])
                  for r in chat.reconstruct(log).collect()))
    assert got == [(1, 0, "user", "Hello"), (1, 1, "assistant", "ok!"), (1, 3, "user", "newer"),
                   (1, 4, "", "no role"), (2, -1, "", "t")]


def test_formatted_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 200)  # long conversations become several chunks
    rows = [(c, t, "assistant" if t % 2 else "user", f"[INST] {'w' * (t * 40)} \\ </s>")
            for c in range(12) for t in range(30)]
    rows += [(50, 0, None, None), (50, 0, None, None), (None, None, "user", "n"), (51, 1, "assistant", "é" * 5000)]
    out = chat.digests(chat.format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] or -1, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render_turn(a, b)) for a, b in turns)


def test_interactions_beat_additive_weights():
    # Toxic only if both of two terms occur: no additive model separates this.
    pick = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(800):
        a, b = pick.integers(0, 2, 2)
        noise = pick.choice(np.arange(10, 40), 4, replace=False)
        rows.append(np.array(sorted([*noise, *([1] if a else [3]), *([2] if b else [4])]), np.int64))
        y.append(float(a != b))
    machine = toxicity.FactorizationMachine(size=64)
    machine.fit(rows[:600], np.array(y[:600]), epochs=60, thrift=1e-5)
    assert np.mean((machine.margins(rows[600:]) > 0) == np.array(y[600:], bool)) > 0.95


def test_toxicity_held_out(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    rated = toxicity.toxicity(table(spark, "/root/testdata/sf0.1", "documents"), labels)
    joined = rated.join(labels, "doc_id").where("held_out").toPandas()
    toxic = joined[joined["toxic"] == 1]
    assert toxic["predicted"].mean() > 0.7
    assert joined[joined["toxic"] == 0]["predicted"].mean() < 0.01
    assert rated.count() == 10000


def test_toxicity_edges(spark, docs):
    rows = [(k, ("you idiot " if k % 2 else "kind ") + "word " * (k % 7)) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "idiot"), (102, "word " * 50000 + "idiot"), (0, "kind again")]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(3, 1, 0), (None, 1, 1), (4, None, None)], LABELS)
    out = toxicity.toxicity(docs(rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert toxicity.toxicity(docs([]), labels).count() == 0
    none = toxicity.toxicity(docs(rows), spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.0}


def test_quality_on_labels(spark):
    labels = table(spark, SF, "labels")
    rated = quality_lm.quality(table(spark, SF, "documents"), labels)
    joined = rated.join(labels, "doc_id").toPandas()
    assert joined[joined["quality"] == 1]["keep"].mean() > 0.99
    assert joined[joined["quality"] == 0]["keep"].mean() < 0.4


def test_quality_edges(spark, docs):
    rows = [(k, "some plain words in a row, " * 8) for k in range(30)]
    rows += [(100, None), (101, ""), (None, "words"), (102, "@@@@ #### " * 9000), (0, "repeated id")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, 1, 0), (5, None, 0)], LABELS)
    frame = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    out = {r["doc_id"]: r["keep"] for r in quality_lm.quality(frame, labels).collect()}
    assert out[1] and out[100] and out[101] and not out[102]
    assert quality_lm.quality(docs([]), labels).count() == 0
    assert all(r["keep"] for r in quality_lm.quality(frame, spark.createDataFrame([], LABELS)).collect())


def test_clashing_columns_are_kept(spark, docs):
    frame = docs([(1, "a b c"), (2, "d e f")])
    for name in ("score", "predicted", "kept", "fp", "component_id", "candidates", "nats", "__row"):
        frame = frame.withColumn(name, F.lit(7))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS)
    for stage in (lambda d: toxicity.kept(d, labels), lambda d: quality_lm.kept(d, labels), pii.redacted):
        out = stage(frame)
        assert out.columns == frame.columns and all(r["score"] == 7 for r in out.collect())


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        left = {r[0] for r in out.select("doc_id").distinct().collect()}
        assert left <= ids and left
        if name == "quality_classifier":
            gone = [labels[i]["quality"] for i in ids - left if i in labels]
            assert sum(gone) <= 2
        if name == "pii":
            assert pii.find(out).where("size(base_spans) > 0").count() == 0 and left == ids
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs, ids = out, left
    assert left == ids
