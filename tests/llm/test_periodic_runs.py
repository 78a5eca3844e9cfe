"""Operator 12 against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from ledgerframe.llm import periodic_runs, queries


def brute_runs(words, least):
    """All (start, length, period): every stretch that keeps a period, if that is its smallest."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at + q
            while end < n and words[end] == words[end - q]:
                end += 1
            piece = words[at:end]
            smaller = any(all(piece[i] == piece[i + p] for i in range(len(piece) - p)) for p in range(1, q))
            if not smaller and len(piece) >= max(least, 2 * q):
                out.append((at, len(piece), q))
            at = end - q + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", text or "")


def planted(doc, text):
    words = words_of(text)
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts(pick):
    out = [None, "", " \n\t", "one", "a " * 11, "a " * 12, "a " * 13, "a b " * 6, "a b c a b c a b c a b",
           "x y\u0085z " * 13, "word " * 3000, "p q r s t u v w " * 2]
    a, b = "a", "a b"
    for _ in range(12):
        a, b = b, f"{b} {a}"
    out.append(a)  # a Fibonacci text: runs inside runs
    for _ in range(120):
        n = pick.randint(1, 90)
        out.append(" ".join(pick.choice("abc"[:pick.randint(1, 3)]) for _ in range(n)))
    for _ in range(60):
        block = [pick.choice("abcdefg") for _ in range(pick.randint(1, 30))]
        whole = block * pick.randint(1, 6) + [pick.choice("xyz") for _ in range(pick.randint(0, 9))] + block
        if pick.random() < 0.4:
            whole[pick.randrange(len(whole))] = "!"
        out.append(pick.choice([" ", "\n", " \t\x0b "]).join(whole))
    return out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_brute_force(least):
    pick = random.Random(least)
    given = texts(pick)
    given = [t or "" for t in given if len(words_of(t)) < 500]
    group = periodic_runs.Group(given, least)
    for k, text in enumerate(given):
        assert [tuple(r) for r in group.runs_of(k)] == brute_runs(words_of(text), least), text


def test_query_contract(spark, docs, tmp_path):
    pick = random.Random(9)
    rows = list(enumerate(texts(pick))) + [(None, "a b " * 9), (3, "one"), (400, "a b c d " * 700)]
    rows += [(k, " ".join(pick.choice("abcd") for _ in range(40))) for k in range(1000, 1100)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc, text in rows:
        words = planted(doc, text) if doc is not None else words_of(text)
        runs = [(0, 3000, 1)] if len(words) == 3000 else [(0, 2800, 4)] if doc == 400 else brute_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        want.append((doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(kept.encode()).hexdigest()))
    planted_400 = planted(400, "a b c d " * 700)
    if planted_400 != words_of("a b c d " * 700):
        want = [w for w in want if w[0] != 400]
        got = [g for g in got if g[0] != 400]
    assert got == sorted(want, key=repr)


def test_runs_and_collapse(spark, docs):
    frame = docs([(1, "x a b a b a b a b a b a b y"), (2, None), (None, "a " * 20), (1, "x a b a b a b a b a b a b y")])
    found = sorted(map(tuple, periodic_runs.runs(frame.withColumn("start", frame.n_chars)).collect()), key=repr)
    assert found == [(1, 1, 12, 2), (1, 1, 12, 2), (None, 0, 20, 1)]
    texts_of = sorted(map(tuple, periodic_runs.collapse(frame).collect()), key=repr)
    assert texts_of == [(1, "x a b y"), (1, "x a b y"), (2, ""), (None, "a")]
    assert periodic_runs.digests(docs([])).count() == 0 == periodic_runs.runs(docs([])).count()


def test_long_texts():
    pick = random.Random(5)
    text = ["w"] * 200_000 + [str(pick.randrange(9)) for _ in range(100_000)] + ["a", "b", "c"] * 50_000
    group = periodic_runs.Group([" ".join(text), "x"], 12)
    found = group.runs_of(0)
    assert [0, 200_000, 1] in found and [300_000, 150_000, 3] in found
