"""T1 in many tasks: chunk maps, their composition, and the batch twin against the plain rule."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.streaming import admission
from ledgerframe.streaming import admission_chunks as chunks


def replay(times, state, limit, window):
    ok, held = admission.admit_sequence(np.array(times), limit, window, deque(state))
    return ok, list(held)


def hits(pick, begin, end, dense):
    return sorted(pick.randrange(begin, end) for _ in range(pick.randint(1, dense)))


def test_maps_equal_the_rule():
    pick = random.Random(3)
    for _ in range(600):
        limit, window = pick.randint(1, 5), pick.randint(1, 30)
        span = window * pick.randint(1, 6)
        parts = [(c * span, hits(pick, c * span, (c + 1) * span, pick.choice([3, 20, 120])))
                 for c in range(1, 5) if pick.random() < 0.85]
        if not parts:
            continue
        before = hits(pick, span - window, span, 2 * limit)
        _, state = replay(before, [], limit, window)
        row = np.full((1, limit), chunks.NONE)
        row[0, :len(state)] = state[::-1]
        tables = [chunks.chunk_table(np.array(t), b, limit, window) for b, t in parts]
        whole = tables[0]
        for t in tables[1:]:
            whole = chunks.compose(whole, t, window)
        admitted, after = chunks.step_states(row, whole, window)
        times = [t for _, p in parts for t in p]
        ok, held = replay(times, state, limit, window)
        assert admitted[0] == ok.sum()
        end = times[-1]
        live = [t for t in after[0].tolist() if end - t <= window]
        assert live == [t for t in held[::-1] if end - t <= window]


@pytest.mark.parametrize("limit, windows, together", [(1, 2, 6), (3, 3, 8)])
def test_a_hot_key_without_a_gap(spark, limit, windows, together):
    pick = random.Random(limit)
    rows, us = [], 0
    for event in range(2400):
        us += pick.choice([0, 1, 2, 5, 11])  # never a gap of a window (60 s)
        rows.append((event, 7, us))
    rows += [(10_000 + k, 100 + k % 9, pick.randrange(40_000)) for k in range(800)]
    rows += [(20_000, None, 5), (20_001, 7, None)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, s long").select(
        "event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    out = admission.admission_batch(frame, limit=limit, window_seconds=60, chunk_windows=windows, together=together)
    got = {r["event_id"]: r["admitted"] for r in out.collect()}
    want = {20_000: False, 20_001: False}
    for key in {r[1] for r in rows if r[1] is not None}:
        own = sorted((s, e) for e, k, s in rows if k == key and s is not None)
        ok, _ = admission.admit_sequence(np.array([s for s, _ in own]) * 1_000_000, limit, 60_000_000)
        want.update({e: bool(x) for (_, e), x in zip(own, ok)})
    assert got == want
    chunks_of_7 = {s // (60 * windows) for _, k, s in rows if k == 7 and s is not None}
    assert len(chunks_of_7) > 50  # each is a task's group of its own


def test_empty_table(spark):
    empty = spark.createDataFrame([], "event_id long, user_id long, ts timestamp_ntz")
    assert admission.admission_batch(empty).count() == 0
    with pytest.raises(ValueError):
        admission.admission_batch(empty, limit=0)
