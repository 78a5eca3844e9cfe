"""Streams against their batch twins (availableNow triggers, file sources)."""

import json
import os
import shutil

import numpy as np
from pyspark.sql import functions as F

from ledgerframe.operators import attempts as attempt_ops
from ledgerframe.streaming import admission, attempt_windows, ingest

SMOKE = "/root/testdata/sf0.001"


def brute_force_admission(rows, limit, window_us):
    out, hist = {}, {}
    for event_id, key, us in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        h = [t for t in hist.get(key, []) if not us - t > window_us]
        if len(h) < limit:
            h.append(us)
            out[event_id] = True
        else:
            out[event_id] = False
        hist[key] = h
    return out


def test_admission_batch_matches_brute_force(spark):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet").select("event_id", "user_id", "ts")
    got = {r["event_id"]: r["admitted"]
           for r in admission.admission_batch(ev, limit=3, window_seconds=86400).collect()}
    rows = [(r["event_id"], r["user_id"], r["us"]) for r in
            ev.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()]
    assert got == brute_force_admission(rows, 3, 86400 * 1_000_000)
    assert 0 < sum(got.values()) < len(got)


def test_admission_exactly_window_old_still_counts():
    t = np.array([0, 60_000_000, 60_000_001], dtype=np.int64)
    ok, _ = admission.admit_sequence(t, limit=1, window_us=60_000_000)
    assert ok.tolist() == [True, False, True]


def _event_dir(tmp_path):
    """Streaming file sources read directories: stage the events file into one."""
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{SMOKE}/events.parquet", src / "part-0.parquet")
    return str(src)


def test_admission_stream_agrees_with_batch(spark, tmp_path):
    ev_dir = _event_dir(tmp_path)
    schema = spark.read.parquet(ev_dir).schema
    stream = spark.readStream.schema(schema).parquet(ev_dir)
    out = admission.admission_stream(stream.select("event_id", "user_id", "ts"), limit=3, window_seconds=86400,
                                     idle_timeout=None)
    q = (out.writeStream.outputMode("append").format("memory").queryName("admitted_t")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert q.awaitTermination(300)
    streamed = {r["event_id"]: r["admitted"] for r in spark.sql("SELECT * FROM admitted_t").collect()}
    batch = {r["event_id"]: r["admitted"] for r in admission.admission_batch(
        spark.read.parquet(ev_dir).select("event_id", "user_id", "ts"), limit=3, window_seconds=86400).collect()}
    assert streamed == batch


def test_window_stream_agrees_with_batch(spark, tmp_path):
    ev_dir = _event_dir(tmp_path)
    q = attempt_windows.start_window_stream(spark, ev_dir, str(tmp_path / "ck"), "attempt_windows_t",
                                            duration="1 hour", watermark="0 seconds")
    q.awaitTermination(300)
    streamed = {(r["window_start"], r["attempts"], r["successes"], r["total_duration_ms"])
                for r in spark.sql("SELECT * FROM attempt_windows_t").collect()}
    batch_df = attempt_windows.window_rollup(
        attempt_windows.events_as_attempts(spark.read.parquet(ev_dir)), "1 hour", watermark=None)
    batch = {(r["window_start"], r["attempts"], r["successes"], r["total_duration_ms"]) for r in batch_df.collect()}
    # append mode emits a window once the watermark passes its end: all but the last one
    assert streamed <= batch and len(batch - streamed) == 1
    assert attempt_ops.windowed_rollup(attempt_windows.events_as_attempts(spark.read.parquet(ev_dir))).count() == len(batch)


def _facts_doc(rows):
    return {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [
        {"start": s, "end": e, "val": v, "accn": a, "fy": fy, "fp": fp, "form": form, "filed": f}
        for s, e, v, a, fy, fp, form, f in rows]}}}}}


def test_incremental_ingest_upserts_touched_companies(spark, tmp_path):
    landing, store, ck = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "ck")
    landing.mkdir()
    (landing / "CIK0000000001.json").write_text(json.dumps(_facts_doc([
        ("2022-01-01", "2022-12-31", 100, "a1", 2022, "FY", "10-K", "2023-02-01")])))
    (landing / "CIK0000000002.json").write_text(json.dumps(_facts_doc([
        ("2022-01-01", "2022-12-31", 70, "b1", 2022, "FY", "10-K", "2023-02-01")])))
    ingest.start_ingest(spark, str(landing), store, ck, 2020, 2024).awaitTermination(300)
    first = {r["company_id"]: float(r["value"]) for r in ingest.current_metrics(spark, store).collect()}
    assert first == {"0000000001": 100.0, "0000000002": 70.0}
    # an amendment for company 1 lands later, in a second file
    (landing / "CIK0000000001-amend.json").write_text(json.dumps(_facts_doc([
        ("2022-01-01", "2022-12-31", 120, "a2", 2022, "FY", "10-K/A", "2023-05-01")])))
    ingest.start_ingest(spark, str(landing), store, ck, 2020, 2024).awaitTermination(300)
    second = {r["company_id"]: float(r["value"]) for r in ingest.current_metrics(spark, store).collect()}
    assert second == {"0000000001": 120.0, "0000000002": 70.0}
    [run] = os.listdir(os.path.join(store, "facts"))
    assert len(os.listdir(os.path.join(store, "facts", run))) >= 2
    # a new checkpoint counts its epochs anew and must not overwrite what is stored
    (landing / "CIK0000000003.json").write_text(json.dumps(_facts_doc([
        ("2022-01-01", "2022-12-31", 30, "c1", 2022, "FY", "10-K", "2023-02-01")])))
    ingest.start_ingest(spark, str(landing), store, ck + "-new", 2020, 2024).awaitTermination(300)
    third = {r["company_id"]: float(r["value"]) for r in ingest.current_metrics(spark, store).collect()}
    assert third == {"0000000001": 120.0, "0000000002": 70.0, "0000000003": 30.0}
    assert len(os.listdir(os.path.join(store, "facts"))) == 2


def test_hits_in_window_across_buckets_matches_brute_force(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    secs = [0, 30, 59, 60, 61, 119, 120, 120, 150, 185, 400]   # bucket edges at 60 s multiples
    rows = [(i, 7, base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    rows.append((99, 8, base + dt.timedelta(seconds=60)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["hits"] for r in admission.hits_in_window(df, window_seconds=60).collect()}
    expect = {}
    for i, k, t in rows:
        expect[i] = sum(1 for _, k2, t2 in rows if k2 == k and t - dt.timedelta(seconds=60) <= t2 <= t)
    assert got == expect
