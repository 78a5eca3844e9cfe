"""Best-fit packing of token sequences (operator 4): minimum bin slack.

Documents are encoded, closed by an end id and cut into pieces of at most
``capacity`` ids. Which pieces share a sequence depends on their lengths alone,
so the search runs on the histogram of lengths (``capacity`` numbers at most,
whatever the corpus): each bin takes the longest piece that is left, then a bitset
subset-sum dynamic program over the lengths available finds the fullest feasible
combination with it, which is removed. A combination is used for as many bins as
its lengths allow at once, since the search would find it again.

Pieces find their places without any sort by length: every task numbers the
pieces of each length it writes, a prefix sum over (length, task) counts turns
that into a rank among all pieces of the length, and the rank decides the bin.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, text_or_empty
from ledgerframe.llm.token_ids import closed, default_vocabulary, token_ids

CAPACITY = 4096
END_ID = 1
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "part int, place long")


def fullest(lengths: list[tuple[int, int]], room: int) -> Counter:
    """The multiset of ``(length, count)`` with the largest sum of at most ``room``.

    ``lengths`` fall; bit ``s`` of ``reach`` says that the lengths so far can sum
    to ``s``. Copies of a length enter in powers of two. The search ends early
    once ``room`` itself is reached, so longer pieces are used first.
    """
    reach, stages, limit = 1, [], (1 << (room + 1)) - 1
    for length, count in lengths:
        left, step = min(count, room // length), 1
        while left:
            take = min(step, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, Counter()
    for before, length, take in reversed(stages):
        if not before >> target & 1:
            used[length] += take
            target -= length * take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(lengths and their number in a bin, bins of that kind)`` for all pieces."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    bins = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        others = [(n, c - (n == longest)) for n, c in left.items() if n <= room]
        used = fullest([x for x in others if x[1]], room)
        used[longest] += 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins.append((dict(sorted(used.items(), reverse=True)), times))
    return bins


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their number among equal lengths of a task.

    A null text is empty (its ids are the end id alone). ``with_ids`` adds the
    ids themselves as unsigned little-endian 32-bit numbers.
    """
    vocabulary = vocabulary or default_vocabulary()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, seen = token_ids(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, docs_of = [], iter(batch["doc_id"])
            for flat, ends in tokens.groups(batch["text"]):
                flat, ends = closed(flat, ends, end_id)
                begin = 0
                for end in ends.tolist():
                    doc = next(docs_of)
                    doc = None if pd.isna(doc) else int(doc)
                    for piece, at in enumerate(range(begin, end, capacity)):
                        some = flat[at:min(at + capacity, end)]
                        length = len(some)
                        rows.append((doc, piece, at - begin, length, zlib.crc32(some), part,
                                     seen[length], *[some.tobytes()] * with_ids))
                        seen[length] += 1
                    begin = end
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")
                       ).mapInPandas(cut, PIECES + ", ids binary" * with_ids)


def _runs(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length rows of (first rank, pieces per bin, first sequence, offset in a bin)."""
    runs: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for used, times in minimum_bin_slack(histogram, capacity):
        offset = 0
        for length, per_bin in used.items():
            runs.setdefault(length, []).append((taken[length], per_bin, sequence, offset))
            taken[length] += per_bin * times
            offset += length * per_bin
        sequence += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (stored :func:`pieces`) with ``sequence_id`` and ``offset`` for every piece.

    Repeated rows and null ids are pieces like any others; an empty table gives none.
    """
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    # At most one row per length up to the capacity.
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = _runs(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = counts.select("length", "part",
                          F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # The counts grow with the tasks: a shuffle by length and task at every size, never a broadcast.
    ranked = cut.join(bases.hint("merge"), ["length", "part"]).withColumn(
        "rank", F.col("base") + F.col("place")).drop("base", "place", "part")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), np.int64)
            offset = np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length", sort=False).indices.items():
                first, per_bin, base, begin = runs[length].T
                rank = batch["rank"].to_numpy()[rows]
                run = np.searchsorted(first, rank, "right") - 1
                beyond = rank - first[run]
                sequence[rows] = base[run] + beyond // per_bin[run]
                offset[rows] = begin[run] + beyond % per_bin[run] * length
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.drop("rank").dtypes)
    return ranked.mapInPandas(assign, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its place: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset`` (and ``ids``). Offsets of a sequence have no gaps."""
    cut = stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids),
                 "packing-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(cut, capacity).select(*names, *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids array<long>, doc_ids)`` of packed pieces that carry their ids."""
    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("offset")
        ids = np.frombuffer(b"".join(group["ids"]), "<u4").astype(np.int64)
        return pd.DataFrame([{"sequence_id": group["sequence_id"].iloc[0], "ids": ids.tolist(),
                              "doc_ids": [None if pd.isna(d) else int(d) for d in group["doc_id"]]}])

    return packed.groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, ids array<long>, doc_ids array<long>")
