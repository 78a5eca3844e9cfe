"""Operators 2, 4 and 6 against the libraries, bounds and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerframe.llm import packing, sentencepiece_fst, token_files
from ledgerframe.llm.token_ids import TokenIds, default_vocabulary

WORDS = ["the", "The", "Hello,", "İ!!", "H̱", "x" * 70, "12", "日本", "<|endoftext|>",
         "<|ENDOFTEXT|>", "\x01", "don't", "!!", "\n", " ", "\t", "é", "🙂", "é"]
EDGE = [(5, None), (3, ""), (9, "a b c"), (9, "a b c"), (None, "null id"), (1, "word " * 9000),
        (2, "x" * 30000), (4, "İ!! <|endoftext|> \x01 \n")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_ids_equal_the_library(library):
    mine, pick = TokenIds(default_vocabulary()), random.Random(4)
    for _ in range(3000):
        text = "".join(pick.choice(WORDS) + pick.choice(["", " "]) for _ in range(pick.randint(0, 12)))
        assert mine.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids,
                                          "<u4").tobytes(), text


def test_pieces_equal_sentencepiece():
    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducers(path)
    pick = random.Random(3)
    texts = ["", " ", "\n", " " * 33 + "the", "x" * 20000, "ab" * 5000, "<s> <0x41> </s>"]
    texts += ["".join(pick.choice("aeioutnsrhl  é日\n\t.,!🙂<>019AB") for _ in range(pick.randint(1, 60)))
              for _ in range(2000)]
    for text in texts:
        ids = theirs.encode(text)
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids, text
        assert mine.decode(ids) == theirs.decode(ids) == text


def unigram_model(path, pick, byte_fallback):
    """A small unigram model written by hand (nothing is trained)."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 1, byte_fallback
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_fallback
    words = {"".join(pick.choice("abc▁") for _ in range(pick.randint(1, 4))) for _ in range(60)} | {"▁", "a", "b"}
    words.discard("c")  # only unknown by itself
    pieces += [(w, -pick.randint(100, 900) / 64, 1) for w in sorted(words)] + [("ba!", 0.0, 4)]
    for piece, score, kind in pieces:
        model.pieces.add(piece=piece, score=score, type=kind)
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_unigram_models_equal_sentencepiece(tmp_path, byte_fallback):
    pick = random.Random(11)
    path = unigram_model(tmp_path / "m.model", pick, byte_fallback)
    theirs, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducers(path)
    texts = ["", "c", "cc", "ccc a", "ba!", "aba!a", "é日x"]
    texts += ["".join(pick.choice(["a", "b", "c", " ", "x", "é", "ba!", "日"]) for _ in range(pick.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text), text


def test_encode_and_decode_frames(spark, docs):
    given_docs = docs(EDGE)
    encoded = sentencepiece_fst.encode(given_docs)
    back = sentencepiece_fst.decode(encoded).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((i or -1, t or "") for i, t in EDGE)
    digest = sentencepiece_fst.digests(given_docs).collect()
    assert len(digest) == len(EDGE) and all(r["round_trip"] for r in digest)
    assert sentencepiece_fst.digests(docs([])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2 ** 32 - 1), min_size=1, max_size=40), max_size=8),
       st.sampled_from(["bit", "byte"]), st.integers(1, 50))
def test_file_round_trip(rows, kind, block):
    rows = rows or [[7]]
    data = token_files.write_file([(k, np.array(r, "<u4").tobytes()) for k, r in enumerate(rows)], kind, block)
    file = token_files.TokenFile(data)
    assert [(d, ids.tolist()) for d, _, ids in file.documents()] == list(enumerate(rows))
    flat = sum(rows, [])
    assert file.block((len(flat) - 1) // block).tolist() == flat[(len(flat) - 1) // block * block:]


def test_cut_file_is_refused():
    data = token_files.write_file([(1, np.array([1, 2], "<u4").tobytes())])
    with pytest.raises(ValueError):
        token_files.TokenFile(data[:-3])


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, docs, library, kind):
    rows = token_files.round_trip(docs(EDGE), kind=kind, file_ids=64, block_ids=50).collect()
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows)
    want, start = [], 0
    for doc, text in sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(library, text)
        want.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.round_trip(docs([])).count() == 0


def test_fullest_is_brute_force():
    pick = random.Random(1)
    for _ in range(200):
        lengths = sorted({pick.randint(1, 20): pick.randint(1, 3) for _ in range(4)}.items(), reverse=True)
        room = pick.randint(1, 40)
        sums = {0}
        for n, c in lengths:
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        used = packing.fullest(lengths, room)
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(used[n] <= c for n, c in lengths)


def test_packing(spark, docs, library):
    many = EDGE + [(100 + k, "word " * (k % 37)) for k in range(300)]
    packed = packing.pack(docs(many), capacity=64, with_ids=True)
    rows = packed.collect()
    total, by_sequence = 0, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        total += r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert len(by_sequence) <= -(-total // 64) + 1
    for doc, text in ((1, EDGE[5][1]), (5, None), (130, "word " * 30)):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == ids_of(library, text)
        assert [r["start"] for r in own] == [64 * k for k in range(len(own))]
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == total
    assert packing.pack(docs([])).count() == 0
