"""T1 in event time against the batch twin, with shuffled micro-batches and idle keys."""

import random

from pyspark.sql import functions as F

from ledgerframe.streaming import admission, admission_stateful

SCHEMA = "event_id long, user_id long, s long"


def test_shuffled_batches_and_idle_keys(spark, tmp_path):
    pick = random.Random(6)
    rows = [(k, k % 3, pick.randrange(3000)) for k in range(300)]
    rows += [(1000 + k, 9, 20_000 + 10 * k) for k in range(20)]  # busy at the end
    rows += [(2000, None, 100), (2001, 1, None)]
    early = [r for r in rows if r[2] is not None and r[2] < 3000] + rows[-2:]
    pick.shuffle(early)
    batches = [early[k::4] for k in range(4)] + [[r for r in rows if r[2] and r[2] >= 20_000], [(3000, 5, 20_400)],
               [(4000, 0, 50)]]  # far too late
    landing = tmp_path / "in"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).select(
            "event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts")).coalesce(1).write.mode(
            "append").parquet(str(landing / f"b{k}"))
    old = {c: spark.conf.get(c, None) for c in [*admission_stateful.STATE_STORE, "spark.sql.shuffle.partitions"]}
    for c, v in {**admission_stateful.STATE_STORE, "spark.sql.shuffle.partitions": "2"}.items():
        spark.conf.set(c, v)
    try:
        decided = []
        for k in range(len(batches)):
            source = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz").parquet(f"{landing}/*")
            # One landing folder after the other: each run sees the files that were not read yet.
            (tmp_path / "seen").mkdir(exist_ok=True)
            for file in (landing / f"b{k}").glob("part-*"):
                (tmp_path / "seen" / f"{k}-{file.name}").write_bytes(file.read_bytes())
            source = spark.readStream.schema(source.schema).parquet(str(tmp_path / "seen"))
            out = admission_stateful.admission_in_event_time(source, limit=3, window_seconds=60, delay="1 hour")
            query = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
                lambda df, _: decided.extend(df.collect())).trigger(availableNow=True).start()
            assert query.awaitTermination(300)
        held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "ck"))
        left = {r["key"][0] for r in held.select("key").collect()}
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    got = {r["event_id"]: r["admitted"] for r in decided if not r["late"]}
    whole = spark.createDataFrame(rows, SCHEMA).where("s < 3000").select(
        "event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    want = {r["event_id"]: r["admitted"] for r in admission.admission_batch(whole, limit=3, window_seconds=60).collect()
            if r["event_id"] != 2000}
    assert {e: a for e, a in got.items() if e < 1000} == want and 50 < sum(want.values()) < 300
    assert 4000 not in got and all(not r["admitted"] for r in decided if r["late"])
    assert not left & {0, 1, 2}  # idle keys have left the store
