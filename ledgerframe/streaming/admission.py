"""Sliding-window admission per client (T1) and the plain hit audit.

Rule: a hit is admitted when fewer than ``limit`` *admitted* hits of the same
key lie in the preceding window; refused hits are not recorded; a hit exactly
``window`` old still counts (it is evicted only when strictly older).

The rule is a recurrence over each key's hits in time order, so it runs where
each key's hits are met in order with bounded state: the streaming operator
keeps at most ``limit`` admission times per key (``applyInPandasWithState``,
with an idle timeout that drops the state of quiet keys). The batch twin streams the keys of a
partition through the same recurrence, one behind the other. Only keys with very many hits are cut
into time chunks, whose effect on any state is a small table, and composed of these
(:mod:`ledgerframe.streaming.admission_chunks`).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerframe.session import checkpoint_dir
from ledgerframe.streaming import admission_chunks as chunks


def hits_in_window(events: DataFrame, key: str = "user_id", ts: str = "ts",
                   window_seconds: int = 60) -> DataFrame:
    """For each hit, the hits of its key in [ts - window, ts] (all hits,
    admitted or not).

    Skew-safe: time is cut into window-sized buckets and the range frame is
    partitioned by (key, bucket). Everything a hit can see lies in its own
    bucket or the one before, so each bucket also receives a copy of its
    predecessor's hits as context rows. A key with a third of all hits is
    spread over as many tasks as it has buckets (at twice the rows)."""
    w_us = window_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = events.withColumn("_us", us).withColumn("_bucket", F.floor(F.col("_us") / F.lit(w_us)))
    own = base.withColumn("_ctx", F.lit(False))
    ctx = base.withColumn("_bucket", F.col("_bucket") + 1).withColumn("_ctx", F.lit(True))
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-w_us, Window.currentRow)
    return (own.unionByName(ctx).withColumn("hits", F.count("*").over(w))
            .where(~F.col("_ctx")).drop("_us", "_bucket", "_ctx"))


def admit_sequence(times_us: np.ndarray, limit: int, window_us: int,
                   admitted: deque | None = None) -> tuple[np.ndarray, deque]:
    """The admission recurrence over one key's hit times (sorted). Returns the
    per-hit decisions and the admitted times still inside the window."""
    admitted = deque() if admitted is None else admitted
    out = np.zeros(len(times_us), dtype=bool)
    for i, now in enumerate(times_us):
        while admitted and now - admitted[0] > window_us:
            admitted.popleft()
        if len(admitted) < limit:
            admitted.append(int(now))
            out[i] = True
    return out, admitted


ADMIT_SCHEMA = "event_id long, key long, ts timestamp_ntz, admitted boolean"


#: Windows in a chunk of the batch twin, and chunks whose maps one task composes.
CHUNK_WINDOWS, CHUNKS_TOGETHER = 8, 64
#: Keys with more hits than this are cut into chunks.
HEAVY_HITS = 100_000
MAPS = "key long, pos long, at binary, count binary, last binary"
STATES = "key long, pos long, state binary"


def _pack(key, pos: int, table: tuple[np.ndarray, ...]) -> dict:
    return {"key": key, "pos": pos, **{n: x.astype("<i8").tobytes() for n, x in zip(("at", "count", "last"), table)}}


def _unpack(row, limit: int) -> tuple[np.ndarray, ...]:
    at, count, last = (np.frombuffer(getattr(row, n), "<i8") for n in ("at", "count", "last"))
    return at, count, last.reshape(-1, limit)


def admission_batch(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id",
                    limit: int = 3, window_seconds: int = 60, chunk_windows: int = CHUNK_WINDOWS,
                    together: int = CHUNKS_TOGETHER, heavy_hits: int = HEAVY_HITS) -> DataFrame:
    """T1 batch twin: (event_id, key, ts, admitted) for every hit.

    The keys of a partition, sorted by (key, time), go through one task as a stream that holds one
    key's state (``limit`` times at most). The hits of a key with more than ``heavy_hits`` are cut into
    time chunks instead (:func:`_admitted_by_chunks`), so a key with a third of all hits runs in as many
    tasks as it has chunks. ``limit`` is 1 at least; hits without a time or key are refused."""
    if limit < 1 or chunk_windows < 1 or together < 2:
        raise ValueError("limit and chunk_windows are 1 at least, together 2")
    window_us = window_seconds * 1_000_000
    span = chunk_windows * window_us
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(order).alias("event_id"), F.col(key).alias("key"), F.col(ts).alias("ts"),
                      micros.alias("us"))
    known = F.col("us").isNotNull() & F.col("key").isNotNull()
    refused = e.where(~known).select("event_id", "key", "ts", F.lit(False).alias("admitted"))
    hits = e.where(known)
    heavy = _kept(hits.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy_hits).select("key"))
    if heavy.isEmpty():
        return _admitted_in_order(hits, limit, window_us).unionByName(refused)
    light = _admitted_in_order(hits.join(heavy, "key", "left_anti"), limit, window_us)
    cut = hits.join(heavy, "key", "left_semi").withColumn("pos", F.floor(F.col("us") / F.lit(span)))
    return light.unionByName(_admitted_by_chunks(cut, limit, window_us, span, together)).unionByName(refused)


def _admitted_in_order(hits: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Whole keys, many to a task, as one sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, deque()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            times = batch.column("us").to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.diff(keys)) + 1
            ok = []
            for part, key in zip(np.split(times, begins), keys[np.concatenate([[0], begins])].tolist() if len(keys) else []):
                if key != current:
                    current, held = key, deque()
                admitted, held = admit_sequence(part.tolist(), limit, window_us, held)
                ok.append(admitted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("event_id", "key", "ts")] + [pa.array(np.concatenate(ok) if ok else [], pa.bool_())],
                ["event_id", "key", "ts", "admitted"])

    rows = hits.select(F.col("event_id").cast("long").alias("event_id"), F.col("key").cast("long").alias("key"),
                       F.col("ts").cast("timestamp_ntz").alias("ts"), "us")
    return rows.repartition("key").sortWithinPartitions(
        "key", "us", F.col("event_id").asc_nulls_last()).mapInArrow(run, ADMIT_SCHEMA)


def _admitted_by_chunks(hits: DataFrame, limit: int, window_us: int, span: int, together: int) -> DataFrame:
    """Keys of any number of hits, in chunks ``pos`` of ``span`` microseconds. Each chunk's map from the
    state before it to the state behind it is computed in a task of its own
    (:mod:`ledgerframe.streaming.admission_chunks`); maps are composed ``together`` at a time, level
    by level; the states then go back down the levels, and every chunk is replayed from its own. A task
    holds the hits of one chunk, or ``together`` maps."""
    def chunk_map(pdf: pd.DataFrame) -> pd.DataFrame:
        k, pos = pdf["key"].iloc[0], int(pdf["pos"].iloc[0])
        times = np.sort(pdf["us"].to_numpy())
        return pd.DataFrame([_pack(k, pos, chunks.chunk_table(times, pos * span, limit, window_us))])

    def compose_maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        whole = None
        for row in pdf.itertuples():
            table = _unpack(row, limit)
            whole = table if whole is None else chunks.compose(whole, table, window_us)
        return pd.DataFrame([_pack(pdf["key"].iloc[0], int(pdf["group"].iloc[0]), whole)])

    def split_states(maps: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        # Without a state from above, a key's chunks begin with none.
        state = (np.frombuffer(above["state"].iloc[0], "<i8") if len(above) else
                 np.full(limit, chunks.NONE, np.int64)).reshape(1, limit)
        rows = []
        for row in maps.sort_values("pos").itertuples():
            rows.append({"key": row.key, "pos": row.pos, "state": state.astype("<i8").tobytes()})
            _, state = chunks.step_states(state, _unpack(row, limit), window_us)
        return pd.DataFrame(rows, columns=["key", "pos", "state"])

    def replay(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "event_id"], kind="stable")
        state = np.frombuffer(before["state"].iloc[0], "<i8")
        held = deque(int(t) for t in state[::-1] if t > chunks.NONE)
        ok, _ = admit_sequence(pdf["us"].to_numpy(), limit, window_us, held)
        return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "key": pdf["key"].to_numpy(),
                             "ts": pdf["ts"].to_numpy(), "admitted": ok})

    group = F.floor(F.col("pos") / F.lit(together))
    levels = [_kept(hits.groupBy("key", "pos").applyInPandas(chunk_map, MAPS))]
    first, last = levels[0].agg(F.min("pos"), F.max("pos")).first()
    while first is not None and first != last:
        levels.append(_kept(levels[-1].withColumn("group", group).groupBy("key", "group").applyInPandas(
            compose_maps, MAPS)))
        first, last = first // together, last // together
    # The topmost level has one map per key, which begins with no state.
    states = levels[-1].select("key", "pos", F.lit(None).cast("binary").alias("state")).where("false")
    for maps in reversed(levels):
        states = maps.withColumn("group", group).groupBy("key", "group").cogroup(
            states.withColumnRenamed("pos", "group").groupBy("key", "group")).applyInPandas(split_states, STATES)
    return hits.groupBy("key", "pos").cogroup(states.groupBy("key", "pos")).applyInPandas(replay, ADMIT_SCHEMA)


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder: each level is read twice."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


STATE_SCHEMA = T.StructType([T.StructField("admitted_us", T.ArrayType(T.LongType()))])


def admission_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id",
                     limit: int = 3, window_seconds: int = 60, idle_timeout: str | None = "1 hour") -> DataFrame:
    """T1 on a stream: the same recurrence with ``applyInPandasWithState``; the
    state per key is the admitted times still inside the window (at most
    ``limit``). Hits of one key are ordered by (ts, order) within each
    micro-batch; keys idle for ``idle_timeout``, the window at least, lose their state (``None``:
    state is kept until the query ends)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    window_us = window_seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select(F.col(order).alias("event_id"), F.col(key).alias("key"), F.col(ts).alias("ts"),
                      micros.alias("us"))
    # State must outlive its window, or refused hits would be admitted again.
    timeout_ms = max(_duration_ms(idle_timeout), window_seconds * 1000) if idle_timeout else None

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        prior = deque(state.get[0]) if state.exists else deque()
        ok, kept = admit_sequence(pdf["us"].to_numpy(), limit, window_us, prior)
        state.update((list(kept),))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "key": pdf["key"].to_numpy(),
                            "ts": pdf["ts"].to_numpy(), "admitted": ok})

    return e.groupBy("key").applyInPandasWithState(
        run, ADMIT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout)


def _duration_ms(text: str) -> int:
    n, unit = text.split()
    scale = {"second": 1000, "seconds": 1000, "minute": 60_000, "minutes": 60_000,
             "hour": 3_600_000, "hours": 3_600_000, "day": 86_400_000, "days": 86_400_000}[unit]
    return int(n) * scale
