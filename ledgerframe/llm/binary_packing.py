"""Packing by power-of-two decomposition (operator 13).

A document's ids, closed by an end id, are cut into pieces of binary lengths: as many
of ``capacity`` as fit, then one piece for each set bit of the rest, longest first.
Pieces of equal length make a bucket. A piece is a sequence of its own, so no
sequence crosses documents and none is padded; a batch takes ``tokens / length``
sequences of one bucket, so that all batches hold equally many tokens.

Cutting needs no other document: the job is one pass without a shuffle, and its
counts by bucket are as many rows as there are lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, text_or_empty
from ledgerframe.llm.token_ids import closed, default_vocabulary, token_ids

CAPACITY = 2048
END_ID = 1
#: Sequences that one task may number.
TASK_BITS = 40
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, "
          "bucket int, sequence_id long, offset long")


def binary_pieces(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length)`` of every piece, by document and start."""
    lengths = np.asarray(lengths, np.int64)
    top = capacity.bit_length() - 1
    whole, rest = lengths >> top, lengths & (capacity - 1)
    docs, starts, sizes = [np.repeat(np.arange(len(lengths)), whole)], [], []
    first = np.cumsum(whole) - whole
    starts.append((np.arange(len(docs[0])) - first[docs[0]]) << top)
    sizes.append(np.full(len(docs[0]), capacity, np.int64))
    for bit in range(top - 1, -1, -1):
        own = np.flatnonzero(rest >> bit & 1)
        docs.append(own)
        starts.append((whole[own] << top) + (rest[own] >> (bit + 1) << (bit + 1)))
        sizes.append(np.full(len(own), 1 << bit, np.int64))
    docs, starts, sizes = (np.concatenate(x) for x in (docs, starts, sizes))
    order = np.lexsort((starts, docs))
    return docs[order], starts[order], sizes[order]


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs``: ``doc_id, piece, start, length, ids_crc32, doc_tokens,
    bucket`` (the power of two), ``sequence_id, offset`` (always 0), and ``ids`` as unsigned
    little-endian 32-bit numbers on request.

    ``capacity`` is a power of two. A null text is empty (its piece is the end id);
    null ids and repeated rows are documents like others; an empty table gives no
    rows; other columns are not read. Sequence numbers are distinct and have gaps.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(vocabulary)
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            before = 0
            for flat, ends in tokens.groups(batch.column(1).to_pylist()):
                flat, ends = closed(flat, ends, end_id)
                lengths = np.diff(ends, prepend=0)
                doc, start, size = binary_pieces(lengths, capacity)
                at = (ends - lengths)[doc] + start
                cuts = list(zip(at.tolist(), (at + size).tolist()))
                n = len(doc)
                first = np.concatenate([[True], doc[1:] != doc[:-1]])
                piece = np.arange(n) - np.flatnonzero(first)[np.cumsum(first) - 1]
                columns = [batch.column(0).take(pa.array(doc + before)), piece.astype(np.int32), start, size,
                           np.fromiter((zlib.crc32(flat[a:b]) for a, b in cuts), np.int64, n),
                           lengths[doc], np.log2(size).astype(np.int32), number + np.arange(n),
                           np.zeros(n, np.int64)]
                if with_ids:
                    columns.append(pa.array([flat[a:b].tobytes() for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                number, before = number + n, before + len(ends)

    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
                  .mapInArrow(cut, PIECES + ", ids binary" * with_ids), "binary-pieces")


def write_buckets(docs: DataFrame, path: str, **options) -> None:
    """Writes one Parquet folder per bucket, whose rows are sequences with their ids."""
    pack(docs, with_ids=True, **options).write.partitionBy("bucket").parquet(path)


def bucket_sizes(packed: DataFrame, batch_tokens: int) -> DataFrame:
    """``(bucket, length, sequences, tokens, batch_sequences, batches)``: a row for each length
    that occurs. A batch of a bucket holds ``batch_tokens`` tokens (one sequence at least);
    the last one of a bucket may hold fewer."""
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("length")))
    return packed.groupBy("bucket", "length").agg(F.count("*").alias("sequences")).select(
        "bucket", "length", "sequences", (F.col("sequences") * F.col("length")).alias("tokens"),
        per_batch.alias("batch_sequences"), F.ceil(F.col("sequences") / per_batch).alias("batches"))
