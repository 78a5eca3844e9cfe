"""Token-id files with bit-plane shuffling (operator 6).

Documents are dealt out by ranges of ``doc_id`` and sorted; each task encodes its
range and writes the ids, every document closed by an end id, as files of whole
documents. A file is

    magic | planes of block 0 | planes of block 1 | ... | index | index size (u64) | magic

Ids are cut into blocks of a fixed number. A block is transposed into its 32 bit
planes or its 4 byte planes, and each plane is compressed with zstandard by itself
(planes above the largest id are all zero and cost a few bytes). The index holds
the block size, the plane kind, the end of every compressed plane (so a reader
seeks to single blocks) and the id and length of every document.

Files travel as binary cells of a Parquet table, one row per file: Spark's
committer makes them appear whole or not at all, and any store that Spark reads
will do.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import scratch_root, stored, text_or_empty
from ledgerframe.llm.token_ids import closed, default_vocabulary, token_ids

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 21
END_ID = 1
PLANES = {"bit": 32, "byte": 4}
FILES = "shard int, file int, first_doc long, n_ids long, data binary"


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block of ids, least significant first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def join_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The ids of one block; undoes :func:`split_planes`."""
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count,
                                       bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def write_file(docs: list[tuple[int | None, bytes]], kind: str = "byte",
               block_ids: int = BLOCK_IDS, level: int = 1) -> bytes:
    """A whole file for ``(doc_id, ids as u32 bytes)`` in the order given."""
    return file_bytes([i for i, _ in docs], [len(d) // 4 for _, d in docs],
                      np.frombuffer(b"".join(d for _, d in docs), "<u4"), kind, block_ids, level)


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, kind: str = "byte",
               block_ids: int = BLOCK_IDS, level: int = 1) -> bytes:
    """A whole file for documents whose ids lie in a row."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    parts, ends, at = [MAGIC], [], len(MAGIC)
    for start in range(0, len(ids), block_ids):
        for plane in split_planes(ids[start:start + block_ids], kind):
            parts.append(pack(plane))
            at += len(parts[-1])
            ends.append(at)
    index = pack(json.dumps({
        "kind": kind, "block_ids": block_ids, "n_ids": len(ids), "ends": ends,
        "docs": doc_ids, "lengths": lengths}).encode())
    return b"".join([*parts, index, len(index).to_bytes(8, "little"), MAGIC])


class TokenFile:
    """Reads one file: ``index``, ``block(k)``, ``documents()``."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:len(MAGIC)] != MAGIC or data[-len(MAGIC):] != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        foot = len(data) - len(MAGIC) - 8
        size = int.from_bytes(data[foot:foot + 8], "little")
        self.index = json.loads(self.unpack(data[foot - size:foot]))

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        at, planes = self.index, PLANES[self.index["kind"]]
        count = min(at["block_ids"], at["n_ids"] - k * at["block_ids"])
        ends = [len(MAGIC), *at["ends"]][k * planes:(k + 1) * planes + 1]
        return join_planes([self.unpack(self.data[a:b]) for a, b in zip(ends, ends[1:])],
                           count, at["kind"])

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, place of its first id in the file, ids)`` in file order; a file's ids
        are in memory together."""
        blocks = -(-self.index["n_ids"] // self.index["block_ids"])
        ids = np.concatenate([self.block(k) for k in range(blocks)])
        start = 0
        for doc, length in zip(self.index["docs"], self.index["lengths"]):
            yield doc, start, ids[start:start + length]
            start += length


def token_files(docs: DataFrame, vocabulary: str | None = None, kind: str = "byte",
                block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS, end_id: int = END_ID,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files ``(shard, file, first_doc, n_ids, data)`` of all documents in ascending id order.

    A null text is empty: its document is the end id alone. Rows with a null id
    come first; rows that repeat an id are kept and ordered by their text. A file
    ends with the document that fills it, so one very long document is one long file.
    """
    vocabulary = vocabulary or default_vocabulary()
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = token_ids(vocabulary)
        docs_held, lengths, held, size, file, shard = [], [], [], 0, 0, 0

        def flush() -> pd.DataFrame:
            data = file_bytes(docs_held, lengths, np.concatenate(held), kind, block_ids)
            return pd.DataFrame([{"shard": shard, "file": file, "first_doc": docs_held[0],
                                  "n_ids": size, "data": data}]).astype({"first_doc": "Int64"})

        for batch in batches:
            ids_of_docs = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            shard, doc = batch["shard"].iloc[0] if len(batch) else shard, 0
            for flat, ends in tokens.groups(batch["text"]):
                flat, ends = closed(flat, ends, end_id)
                first = done = 0  # texts and ids of the group that are in files already
                while first < len(ends):
                    # The file ends with the text that fills it.
                    full = np.searchsorted(ends, done + file_ids - size)
                    upto = min(full + 1, len(ends))
                    docs_held += ids_of_docs[doc + first:doc + upto]
                    lengths += np.diff(ends[first:upto], prepend=done).tolist()
                    held.append(flat[done:ends[upto - 1]])
                    size += int(ends[upto - 1]) - done
                    first, done = upto, int(ends[upto - 1])
                    if size >= file_ids:
                        yield flush()
                        docs_held, lengths, held, size, file = [], [], [], 0, file + 1
                doc += len(ends)
        if docs_held:
            yield flush()

    # Encoding is bound by the processor: no coalescing of its partitions by size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                          text_or_empty(text_col).alias("text")
                          ).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.withColumn("shard", F.spark_partition_id()).mapInPandas(encode, FILES)


def write_token_files(docs: DataFrame, path: str, **options) -> None:
    """Writes the files of :func:`token_files` as one Parquet table at ``path``."""
    token_files(docs, **options).write.parquet(path)


def _documents(files: DataFrame, last: str, of_ids) -> DataFrame:
    """A row for each document of the files, with ``of_ids`` of its ids."""
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["shard", "file", "doc_id", "place", *names]).astype(
            {"doc_id": "Int64"})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, file, data in zip(batch["shard"], batch["file"], batch["data"]):
                rows, size = [], 0
                for doc, place, ids in TokenFile(data).documents():
                    rows.append((shard, file, doc, place, *of_ids(ids)))
                    size += len(ids)
                    if size > 1 << 20:
                        yield frame(rows)
                        rows, size = [], 0
                yield frame(rows)

    names = [c.split()[0] for c in last.split(", ")]
    return files.select("shard", "file", "data").mapInPandas(
        decode, f"shard int, file int, doc_id long, place long, {last}")


def read_documents(files: DataFrame) -> DataFrame:
    """``(shard, file, doc_id, place, ids binary)`` for every document of the files."""
    return _documents(files, "ids binary", lambda ids: (ids.tobytes(),))


def file_starts(files: DataFrame) -> DataFrame:
    """``(shard, file, base)``: the number of ids in all files before each."""
    sizes = stored(files.select("shard", "file", "first_doc", "n_ids"), "token-files")
    # One row per shard (a Spark partition) is ordered as a whole, files only within theirs.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"),
                                        F.min(F.struct("first_doc", "shard")).alias("at"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))
    return sizes.join(shards, "shard").select(
        "shard", "file", (F.coalesce(F.sum("n_ids").over(within), F.lit(0))
                          + F.col("shard_base")).alias("base"))


def document_digests(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files."""
    read = _documents(files, "n_tokens long, ids_crc32 long",
                      lambda ids: (len(ids), zlib.crc32(ids)))
    return read.join(file_starts(files), ["shard", "file"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes all documents to new files in the shared folder and digests what is read back."""
    import uuid

    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/llm/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return document_digests(spark.read.schema(FILES).parquet(path))
