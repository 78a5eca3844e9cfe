"""Operator 13: exact pieces, round trips, buckets."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerframe.llm import binary_packing
from ledgerframe.llm.token_ids import default_vocabulary

ROWS = [(5, None), (3, ""), (9, "a b c"), (9, "a b c"), (None, "null id"), (1, "word " * 9000), (2, "x" * 30000),
        (2 ** 60 + 1, "İ!! <|endoftext|> \x01 \n")] + [(100 + k, "word " * (k * 7 % 300)) for k in range(200)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_binary_pieces_are_binary_digits():
    lengths = list(range(0, 300)) + [4096, 4097, 10 ** 6 + 3]
    doc, start, size = binary_packing.binary_pieces(np.array(lengths), 64)
    for k, n in enumerate(lengths):
        own = [(s, z) for d, s, z in zip(doc.tolist(), start.tolist(), size.tolist()) if d == k]
        want = [64] * (n // 64) + [1 << b for b in range(5, -1, -1) if n % 64 >> b & 1]
        assert [z for _, z in own] == want
        assert [s for s, _ in own] == [sum(want[:i]) for i in range(len(want))]


def test_pack(spark, docs, library):
    frame = docs(ROWS).withColumnRenamed("n_chars", "bucket")
    rows = binary_packing.pack(frame, capacity=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= 64 for r in rows)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    want = sorted((repr(d), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in ROWS if d != 9)
    got = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        if r["doc_id"] != 9:
            part = got.setdefault(repr(r["doc_id"]), [])
            assert r["start"] == len(part)
            part += np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted(got.items()) == want
    assert all(r["doc_tokens"] == len(got[repr(r["doc_id"])]) for r in rows if r["doc_id"] != 9)
    twice = [r for r in rows if r["doc_id"] == 9]
    assert sum(r["length"] for r in twice) == 8 and all(r["doc_tokens"] == 4 for r in twice)
    assert binary_packing.pack(docs([])).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pack(frame, capacity=100)


def test_buckets(spark, docs, tmp_path):
    path = str(tmp_path / "buckets")
    binary_packing.write_buckets(docs(ROWS), path, capacity=64)
    written = spark.read.parquet(path)
    assert {p.name for p in (tmp_path / "buckets").glob("bucket=*")} == {f"bucket={b}" for b in range(7)}
    sizes = {r["bucket"]: r for r in binary_packing.bucket_sizes(written, 128).collect()}
    for bucket, r in sizes.items():
        own = written.where(f"bucket = {bucket}")
        assert r["sequences"] == own.count() and r["tokens"] == r["sequences"] << bucket
        assert r["batch_sequences"] == 128 >> bucket
        assert r["batches"] == -(-r["sequences"] // r["batch_sequences"])
