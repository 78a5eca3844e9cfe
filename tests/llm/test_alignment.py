"""Operator 11 against brute force over the two libraries."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerframe.llm import alignment

A_PATH, B_PATH = alignment.default_models()
WORDS = ["the", "The", "price", "don't", "x" * 40, "1999", "é", "日本", "🙂", "▁", "<s>", "<0x41>", "<|endoftext|>",
         "\n", "\n\n", "\t", " ", "  ", " ", " ", ",", "!!", "'s", "\x00", "\x01", "naïve"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


@pytest.fixture(scope="module")
def bytes_of():
    """Each A id's bytes, by the library's decoder of single bytes."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, n = {}, 0
    for b in range(256):
        letter[chr(b if b in prints else 256 + n)] = b
        n += b not in prints
    vocab = json.load(open(A_PATH, encoding="utf-8"))["model"]["vocab"]
    return {i: bytes(letter[c] for c in t) for t, i in vocab.items() if all(c in letter for c in t)}


def b_bytes(model, i):
    return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else \
        model.id_to_piece(i).replace("▁", " ").encode()


def brute(libraries, bytes_of, texts):
    """Per text (a, b, links as positions, groups as text)."""
    library, model = libraries
    out = []
    for text in texts:
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        raw = [[bytes_of[i] for i in a], [b_bytes(model, i) for i in b]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            out.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        links = [(i, ends[1].index(e)) for i, e in enumerate(ends[0]) if e in set(ends[1])]
        groups, at = [], (0, 0)
        for i, j in links:
            groups.append(",".join(map(str, a[at[0]:i + 1])) + "|" + ",".join(map(str, b[at[1]:j + 1])))
            at = (i + 1, j + 1)
        out.append((a, b, links, ";".join(groups)))
    return out


def sample(pick, n):
    out = [None, "", " ", "a", "a ", " a", "a  b", "x\n \ny", "▁", "word " * 700, " ".join("ab" * 300)]
    while len(out) < n:
        out.append("".join(pick.choice(WORDS) + pick.choice(["", " "]) for _ in range(pick.randint(1, 25))))
    return out


def test_digests(spark, docs, libraries, bytes_of):
    texts = sample(random.Random(2), 250)
    rows = list(enumerate(texts)) + [(None, texts[20]), (20, texts[20])]
    got = sorted(map(tuple, alignment.digests(docs(rows).withColumnRenamed("lang", "links")).collect()), key=repr)
    found = brute(libraries, bytes_of, [t for _, t in rows])
    counts = Counter((a[i], b[j]) for a, b, links, _ in found for i, j in links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    want = []
    for (doc, _), (a, b, links, groups) in zip(rows, found):
        own = [counts[a[i], b[j]] for i, j in links]
        best = sum(counts[a[i], b[j]] == most[b[j]] for i, j in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        want.append((doc, len(a), len(b), len(links), len(links), best, sum(own), digest))
    assert got == sorted(want, key=repr)
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows))  # some texts do not come back
    assert alignment.digests(docs([])).count() == 0


def test_align_and_pairs(spark, docs, libraries, bytes_of):
    texts = sample(random.Random(4), 60)
    rows = {r["doc_id"]: r for r in alignment.align(docs(list(enumerate(texts)))).collect()}
    found = brute(libraries, bytes_of, texts)
    counts = Counter()
    for k, (a, b, links, _) in enumerate(found):
        r = rows[k]
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert list(zip(r["links_a"], r["links_b"])) == links
        assert r["cuts"] == [sum(len(bytes_of[x]) for x in a[:i + 1]) for i, _ in links]
        counts.update((a[i], b[j]) for i, j in links)
    got = alignment.id_pairs(docs(list(enumerate(texts)))).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in got} == counts
    for r in got:
        assert r["best"] == (r["n"] == max(n for (_, y), n in counts.items() if y == r["b_id"]))


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lanes_do_not_change_links(libraries, bytes_of, lane):
    texts = [t or "" for t in sample(random.Random(lane), 150)]
    both = alignment.Aligner(A_PATH, B_PATH, lane)
    got = alignment.Aligned(both, texts)
    links = list(zip(got.links_a.tolist(), got.links_b.tolist()))
    want = [(i + got.a_docs[k], j + got.b_docs[k]) for k, f in enumerate(brute(libraries, bytes_of, texts)) for i, j in f[2]]
    assert links == want


def test_very_long_texts(libraries, bytes_of):
    both = alignment.aligner(A_PATH, B_PATH)
    for text in (" " * 1_200_000 + "x", "ab" * 200_000, "word " * 100_000, "\n" * 5000 + "x"):
        got = alignment.Aligned(both, [text, "a b"])
        assert got.a_ends[got.a_docs[1] - 1] == len(text) + 1 if got.a_docs[1] else True
        assert got.links_a[-1] == len(got.a) - 1 and got.links_b[-1] == len(got.b) - 1
