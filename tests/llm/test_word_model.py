import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerframe.llm import quality_lm, toxicity, word_lm

LABELS = "doc_id long, quality int, toxic int"


def _brute(texts):
    """-log p of a text under interpolated modified Kneser-Ney, token by token."""
    runs = [word_lm.TOKEN.findall(t) for t in texts]
    seen = {3: Counter(g for r in runs if r for g in zip(*(["<", "<", *r, ">"][k:] for k in range(3))))}
    for order in (2, 1):
        seen[order] = Counter(g[1:] for g in seen[order + 1])
    off, total, spare = {}, Counter(), Counter()
    for order, counts in seen.items():
        n1, n2, n3, n4 = (Counter(counts.values())[k] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        off[order] = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]
        for g, n in counts.items():
            total[order, g[:-1]] += n
            spare[order, g[:-1]] += off[order][min(n, 3) - 1]

    def p(g):
        order = len(g)
        if not order:
            return 1 / (len(seen[1]) + 1)
        if not total[order, g[:-1]]:
            return p(g[1:])
        n = seen[order][g]
        return (n - off[order][min(n, 3) - 1] * (n > 0) + spare[order, g[:-1]] * p(g[1:])) / total[order, g[:-1]]

    def cost(text):
        r = ["<", "<", *word_lm.TOKEN.findall(text), ">"]
        return -sum(math.log(p(g)) for g in zip(r, r[1:], r[2:])) if len(r) > 3 else 0.0
    return cost


@pytest.mark.parametrize("shard_chars", [word_lm.SHARD_CHARS, 100])
def test_word_costs_are_kneser_ney(spark, docs, monkeypatch, shard_chars):
    monkeypatch.setattr(word_lm, "SHARD_CHARS", shard_chars)
    words = "the cat sat on a mat , and saw 1999 Привет мир .".split()
    rows = [(k, " ".join(words[(k * j * j + j) % len(words)] for j in range(3 + k % 17))) for k in range(40)]
    rows += [(50, "unknown words here the cat"), (51, ""), (52, None), (7, rows[7][1]), (None, "the cat sat")]
    frame = docs(rows)
    good = spark.createDataFrame([(k,) for k in range(30)], "doc_id long")
    half = frame.select("doc_id", "text", word_lm.half_of("doc_id").alias("f"),
                        word_lm.row_key("doc_id", "text").alias("at")).collect()
    trusted = [r for r in half if r["doc_id"] is not None and r["doc_id"] < 30]
    cost = {f: _brute([r["text"] for r in trusted if r["f"] != f]) for f in (0, 1)}
    got = {r["at"]: r for r in word_lm.word_costs(frame, good, "doc_id", "text").collect()}
    for r in half:
        text = r["text"] or ""
        n = len(word_lm.TOKEN.findall(text))
        assert got[r["at"]]["symbols"] == n + (n > 0)
        assert got[r["at"]]["cost"] / 1e6 == pytest.approx(cost[r["f"]](text), abs=1e-4 + 3e-6 * n)


def test_quality_sees_words_not_letters(spark, docs):
    line = "the price of bread rose by 1200 in the year 1999 , and the baker was glad . "
    loud = line.upper().replace("1200", "7777").replace("1999", "8888")
    rows = [(k, line * (3 + k % 4)) for k in range(40)] + [(100, line * 4), (101, loud * 4), (102, "qbread " * 60)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], LABELS)
    out = {r["doc_id"]: r["keep"] for r in quality_lm.quality(docs(rows), labels).collect()}
    assert out[100] and not out[101] and not out[102]


def test_threshold_is_the_quantile(spark, docs):
    line = "one two three four five six seven "
    rows = [(k, line * (1 + k % 5) + "odd" * (k % 7 == 0)) for k in range(30)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], LABELS)
    out = quality_lm.quality(docs(rows), labels).collect()
    worst = max(r["perplexity"] for r in out)
    assert worst <= out[0]["threshold"] <= worst * math.exp(quality_lm.BIN)


def _packed_counts(seed, packets, each):
    """Rows of one shard as tasks send them, and the counts of their trigrams."""
    pick, rows, counts = np.random.default_rng(seed), [], Counter()
    names = [c.split()[0] for c in word_lm.MODEL.split(", ")]
    for _ in range(packets):
        found, n = np.unique(pick.integers(10, [400, 90, 60], (each, 3)), axis=0, return_counts=True)
        counts.update(dict(zip(map(tuple, found.tolist()), n.tolist())))
        b, c, a = found.T
        rows.append((3, None, *word_lm._shape(b, c, a), word_lm._small(n)))
    return pa.Table.from_batches([word_lm._rows([r], names, word_lm.MODEL) for r in rows]), counts


def test_runs_of_a_shard_give_the_counts_and_values_of_the_whole(monkeypatch):
    given, counts = _packed_counts(1, packets=5, each=3000)
    got = {}
    for size in (10**9, 500, 1):
        monkeypatch.setattr(word_lm, "RUN_TRIGRAMS", size)
        merged, = word_lm._packed_rows(word_lm._merged(given))
        t, n = word_lm._Packed(merged).whole(), word_lm._numbers(merged["n"])
        b, c = t.b[t.b_of_pair][t.pair], t.c[t.pair]
        assert dict(zip(zip(b.tolist(), c.tolist(), t.a.tolist()), n.tolist())) == counts
        assert [merged[f"t{k}"] for k in range(1, 5)] == [sum(x == k for x in counts.values()) for k in range(1, 5)]
        pairs = Counter(key[:2] for key in counts)
        assert [merged[f"p{k}"] for k in range(1, 5)] == [sum(x == k for x in pairs.values()) for k in range(1, 5)]
        k = word_lm.Constants.__new__(word_lm.Constants)
        k.off3 = k.off2 = k.off1 = [0.5, 0.9, 1.2]
        k.total, k.unknown = 5000, 1e-4
        shard = word_lm.Shard(merged, np.arange(1, 1 + len(word_lm._asked_words(t.b, t.c))), k)
        got[size] = [shard.values(word_lm._Packed(row).whole(), k.unknown).tolist() for row in word_lm._packed_rows(given)]
        got[size].append([x.tolist() for x in (shard.pairs, shard.triples, shard.contexts, shard.gain3, shard.log_g3)])
    assert got[10**9] == got[500] == got[1]


def test_merging_a_shard_takes_little_more_than_its_packed_rows(monkeypatch):
    monkeypatch.setattr(word_lm, "RUN_TRIGRAMS", 20_000)
    given, counts = _packed_counts(2, packets=8, each=60_000)
    tracemalloc.start()
    word_lm._merged(given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 8 * 60_000


def test_a_worker_keeps_no_words_after_its_toxicity_task(spark, docs):
    rows = docs([(k, f"word{k} other{k % 7}") for k in range(200)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], LABELS)
    toxicity.toxicity(rows, labels).collect()

    def kept(batches):
        for batch in batches:
            from ledgerframe.llm.toxicity import _terms_of_word

            yield batch[["id"]].assign(id=_terms_of_word.cache_info().currsize)

    assert spark.range(64).repartition(16).mapInPandas(kept, "id long").agg({"id": "max"}).first()[0] == 0


ODD = ["", " ", "\n", "a", "a\n", "\na", "a b\n\nb a", " a  b ", "tab\tand\r\nend", "x" * 70 + " " + "y" * 32 + "z", "it's 3.5%!?",
       "a_b\u00a0c\u2028d", "\x00 \x1c\x85e\u0301", "\u4f60\u597d\uff0c\u4e16\u754c \u0645\u0631\u062d\u0628\u0627", "\U0001f600a\U0001f600 \n a"]


@pytest.mark.parametrize("line_ends", [True, False])
def test_tokens_are_those_of_each_whole_text(line_ends):
    texts = [t for t in ODD if line_ends or "\n" not in t] * 2
    want = [word_lm.TOKEN.findall(t) for t in texts]
    words = sorted({w for run in want for w in run})
    code = dict(zip(words, word_lm.word_codes(pa.array(words)).tolist()))
    assert len(set(code.values())) == len(words) and max(code.values()) < 1 << 48
    codes, flat, n = word_lm._tokens(pa.array(texts))
    assert n.tolist() == [len(run) for run in want]
    assert codes[flat].tolist() == [code[w] for run in want for w in run]


@pytest.mark.parametrize("keys", [1 << 63, 1])
def test_a_batch_has_the_trigrams_of_its_texts(monkeypatch, keys):
    monkeypatch.setattr(word_lm, "KEYS", keys)
    monkeypatch.setattr(word_lm, "GROUP_CHARS", 20)
    batch, sizes = word_lm._Batch(), []
    for group in word_lm._groups(pa.array(["skipped", *ODD, *ODD]).slice(1)):
        sizes += batch.add(group).tolist()
    want = Counter()
    for k, text in enumerate(ODD * 2):
        run = word_lm.TOKEN.findall(text)
        codes = [1, 1, *word_lm.word_codes(pa.array(run, pa.string())).tolist(), 2]
        assert sizes[k] == len(run) + bool(run)
        want.update((b, c, a & ((1 << 40) - 1), k) for a, b, c in zip(codes, codes[1:], codes[2:]) if run)
    *found, times = (x.tolist() for x in batch.trigrams(by_text=True))
    rows = list(zip(*found))
    assert dict(zip(rows, times)) == want and len(rows) == len(want)
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    every = Counter()
    for key, n in want.items():
        every[key[:3]] += n
    b, c, a, _, times = (x.tolist() for x in batch.trigrams(by_text=False))
    assert dict(zip(zip(b, c, a), times)) == every and len(b) == len(every)


class _Task:
    """Takes a task's function in place of Spark."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_a_repeated_word_is_cut_and_hashed_once(monkeypatch):
    given = []

    class Counting:
        def findall(self, text, found=word_lm.TOKEN.findall):
            given.append(len(text))
            return found(text)

    monkeypatch.setattr(word_lm, "TOKEN", Counting())
    texts = pa.RecordBatch.from_arrays([pa.array(["the cat sat, the dog ran.\n" * 200] * 50)], ["text"])
    rows = [r for batch in word_lm._counted(_Task(), 1)(iter([texts])) for r in word_lm._packed_rows(pa.Table.from_batches([batch]))]
    assert sum(word_lm._numbers(r["n"]).sum() for r in rows) == 50 * (200 * 9 + 1)
    assert sum(given) < 100
