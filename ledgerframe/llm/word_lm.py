"""A modified Kneser-Ney model of word n-grams (orders 1 to 3) in sharded count tables.

All trusted text is counted, in two halves by the hash of the document id; a document
is scored by the half that it is not in, so a trusted one costs what any good text
costs that the model has not seen. Counts are joined, never gathered: they grow with
the corpus.

Trigrams ``a b c`` are dealt by their middle word. Its shard then has all counts that the
probability of ``c`` after ``a b`` needs (trigrams, their contexts ``a b``, the pairs ``b c`` and their
context ``b``) but the unigrams, of which it is sent those of its own words. A text's trigrams are
dealt alike and join the counts there; a shard returns one sum per text. Each shard adds

    log p(c | a b) - log p(c)  +  log p(b)

for the trigrams of its middle words, where the middle word of a text's first trigram, its
start, stands for its end: over a text these add up to its log probability.

Counts and requests travel as packed rows (one per shard and some million tokens): distinct middle
words, their right and those words' left neighbours, as cut hashes. A task holds a shard's rows packed, and
unpacks :data:`RUN_TRIGRAMS` of them at a time. The two halves, and
:data:`ROUNDS` parts of the documents of each, are scored one after the other, and the
shuffle files of each part are freed when its sums are written: disk holds the counts of one
half and the requests of one part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm.common import dropped, given_back, stored, text_or_empty

# Words (long runs in pieces), single signs, line ends.
TOKEN = re.compile(r"\w{1,32}|[^\w\s]|\n")
START, END = 1, 2
HALVES, ROUNDS = 2, 2
MICRO = 1e6
#: Characters of all texts per shard, of texts that are cut into words together, and tokens that are packed together.
SHARD_CHARS = 32_000_000
GROUP_CHARS = 2_000_000
FLUSH_TOKENS = 1_000_000
#: Trigrams of texts are sorted as numbers below this, else column by column.
KEYS = 1 << 63
#: Trigrams of a shard that are unpacked together (more if one middle word has more).
RUN_TRIGRAMS = 250_000
#: Bytes of a word's hash, and of a left neighbour's (told apart among those of one pair only).
WORD_BYTES, LEFT_BYTES = 6, 5
SHAPE = "b binary, rights binary, c binary, lefts binary, a binary"
MODEL = f"shard int, part int, {SHAPE}, n binary"
SEEN = ", ".join(f"{x}{k} long" for x in "tp" for k in range(1, 5))
SUMS = "batch long, sums binary, ats binary"
ASKED = f"shard int, batch long, texts int, {SHAPE}, sizes binary, docs binary, times binary, ats binary"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_codes(words: pa.Array) -> np.ndarray:
    codes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    return (codes & ((1 << 8 * WORD_BYTES) - 1)).astype(np.int64)


def half_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(HALVES)).cast("int")


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows of one id and text, which cost the same."""
    return F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col))


# ---------------------------------------------------------------- packing
def _cut(codes: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _whole(raw, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1).astype(np.int64)


def _small(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(kind).tobytes())


def _plain(raw, kind: str = "<u4") -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _numbers(raw, kind: str = "<u4") -> np.ndarray:
    return _plain(raw, kind).astype(np.float64 if kind == "<f8" else np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _rising(numbers: np.ndarray) -> np.ndarray:
    """The different numbers (``np.unique`` hashes them first, which takes longer)."""
    numbers = np.sort(numbers)
    return numbers[_starts(numbers)]


def _lists(b: np.ndarray, c: np.ndarray, a: np.ndarray) -> list:
    """Distinct trigrams, by ``b, c, a``, as nested lists."""
    new_b = _starts(b)
    new_c = new_b | _starts(c)
    at_b, at_c = np.flatnonzero(new_b), np.flatnonzero(new_c)
    rights = np.diff(np.append(np.cumsum(new_c)[at_b] - 1, len(at_c)))
    return [_cut(b[at_b], WORD_BYTES), rights.astype("<u4"), _cut(c[at_c], WORD_BYTES),
            np.diff(np.append(at_c, len(a))).astype("<u4"), _cut(a, LEFT_BYTES)]


def _shape(b: np.ndarray, c: np.ndarray, a: np.ndarray) -> list[bytes]:
    return [x if isinstance(x, bytes) else _small(x) for x in _lists(b, c, a)]


class _Packed:
    """A packed row that is unpacked run by run of its middle words ``b``."""

    def __init__(self, row: dict):
        self.b, self.lefts = _whole(row["b"], WORD_BYTES), _plain(row["lefts"])
        self.c, self.a = row["c"], row["a"]
        #: Where the pairs and the trigrams of each middle word begin.
        self.pair_at = np.append(0, np.cumsum(_numbers(row["rights"])))
        self.at = np.append(0, np.cumsum(self.lefts, dtype=np.int64))[self.pair_at]

    def run(self, x: int, y: int) -> _Trigrams:
        """The trigrams of ``b[x:y]``."""
        pairs, own = self.pair_at[x:y + 1], slice(*(LEFT_BYTES * self.at[[x, y]]).tolist())
        return _Trigrams(self.b[x:y], np.diff(pairs), _whole(self.c[WORD_BYTES * int(pairs[0]):WORD_BYTES * int(pairs[-1])], WORD_BYTES),
                         self.lefts[pairs[0]:pairs[-1]].astype(np.int64), _whole(self.a[own], LEFT_BYTES))

    def whole(self) -> _Trigrams:
        return self.run(0, len(self.b))


class _Trigrams:
    """Nested lists: ``b``; ``c`` and the place of its ``b``; ``a`` and that of its pair."""

    def __init__(self, b: np.ndarray, rights: np.ndarray, c: np.ndarray, lefts: np.ndarray, a: np.ndarray):
        self.b, self.c, self.a, self.lefts = b, c, a, lefts
        self.b_of_pair = np.repeat(np.arange(len(b)), rights)
        self.pair = np.repeat(np.arange(len(c)), lefts)


def _packed_rows(table: pa.Table) -> Iterator[dict]:
    """The rows of an Arrow table, binary cells as buffers that are not copied."""
    for batch in table.to_batches():
        for k in range(batch.num_rows):
            yield {name: x[k].as_buffer() if pa.types.is_binary(x.type) else x[k].as_py()
                   for name, x in zip(batch.schema.names, batch.columns)}


def _runs(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first words of runs of about :data:`RUN_TRIGRAMS` trigrams, of which ``n`` have the middle word ``b``."""
    order = np.argsort(b, kind="stable")
    words, n = b[order], n[order]
    first = np.flatnonzero(_starts(words))
    before = (np.cumsum(n) - n)[first]
    return words[first][_starts(before // RUN_TRIGRAMS)]


def _groups(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a column of texts of about :data:`GROUP_CHARS` characters (a longer text alone)."""
    ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GROUP_CHARS, "right")))
        yield column.slice(at, to - at)
        at = to


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of different words, the places among them of all texts' tokens in a row, and how many each text has.

    No token has a space or goes beyond a line end: each different chunk between those is cut into tokens once."""
    spread = pc.replace_substring(pc.cast(texts, pa.large_string()), "\n", " \n ")
    cut = pc.split_pattern(spread, " ")
    chunks = cut.flatten().dictionary_encode()
    place, different = chunks.indices.to_numpy(), chunks.dictionary
    # A line end follows each chunk; the chunk that is one itself is emptied, and gets its token at last.
    line = pc.index(different, "\n").as_py()
    lines = pa.array(np.arange(len(different)) == line)
    joined = "\n".join(pc.if_else(lines, "", different).to_numpy(zero_copy_only=False).tolist() + [""])
    found = pa.array(TOKEN.findall(joined), pa.string()).dictionary_encode()
    words, at = found.dictionary, found.indices.to_numpy()
    end_of_line = pc.index(words, "\n").as_py()
    seams = np.flatnonzero(at == end_of_line)
    sizes = np.diff(seams, prepend=-1) - 1
    starts = np.cumsum(sizes) - sizes
    at = np.append(np.delete(at, seams), end_of_line)
    if line >= 0:
        sizes[line], starts[line] = 1, len(at) - 1
    each = sizes[place]
    ends = np.append(0, np.cumsum(each))
    flat = at[np.repeat((starts[place] - ends[:-1]).astype(np.int32), each) + np.arange(ends[-1], dtype=np.int32)]
    offsets = cut.offsets.to_numpy()
    return word_codes(words), flat, np.diff(ends[offsets - offsets[0]])


class _Batch:
    """The tokens of some texts as numbers of words."""

    def __init__(self):
        self.codes, self.numbers, self.sizes, self.words, self.tokens = [np.array([START, END])], [], [], 2, 0

    def add(self, texts: pa.Array) -> np.ndarray:
        """Each text's number of tokens and an end; 0 without any token."""
        codes, flat, n = _tokens(texts)
        sizes = np.where(n > 0, n + 3, 0)
        ends = np.cumsum(sizes)[n > 0]
        first = ends - sizes[n > 0]
        numbers = np.empty(sizes.sum(), np.int32)
        word = np.ones(len(numbers), bool)
        for x, number in ((first, 0), (first + 1, 0), (ends - 1, 1)):
            numbers[x], word[x] = number, False
        numbers[word] = flat + self.words
        self.codes.append(codes)
        self.numbers.append(numbers)
        self.sizes.append(sizes)
        self.words += len(codes)
        self.tokens += len(numbers)
        return n + (n > 0)

    def trigrams(self, by_text: bool) -> tuple[np.ndarray, ...]:
        """``(b, c, a, text, times)`` of the different trigrams, of each text or (``text`` is 0) of all, by
        ``b, c, a`` and text."""
        codes, number = np.unique(np.concatenate(self.codes), return_inverse=True)
        sizes = np.concatenate(self.sizes)
        run = number[np.concatenate(self.numbers)]
        inner = np.ones(len(run), bool)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        inner[first], inner[first + 1] = False, False
        last = np.flatnonzero(inner)
        a, b, c = run[last - 2], run[last - 1], run[last]
        n, texts = len(codes), len(sizes) if by_text else 1
        text = np.repeat(np.arange(texts), np.maximum(sizes - 2, 0)) if by_text else np.zeros(len(a), np.int64)
        if n ** 3 * texts <= KEYS:
            # All four in one number: numbers sort faster than places.
            key = ((b * n + c) * n + a) * texts + text
            key.sort()
            first = np.flatnonzero(_starts(key))
            times = np.diff(np.append(first, len(key)))
            key, text = np.divmod(key[first], texts)
            key, a = np.divmod(key, n)
            b, c = np.divmod(key, n)
        else:
            order = np.lexsort((text, a, c, b))
            b, c, a, text = b[order], c[order], a[order], text[order]
            first = np.flatnonzero(_starts(b, c, a, text))
            times = np.diff(np.append(first, len(b)))
            b, c, a, text = b[first], c[first], a[first], text[first]
        return codes[b], codes[c], codes[a] & ((1 << 8 * LEFT_BYTES) - 1), text, times


def _shards(b: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """``(shard, from, to)`` of the parts of rising middle words."""
    cuts = np.searchsorted(b, [-(-s * (1 << 8 * WORD_BYTES) // shards) for s in range(shards + 1)])
    return [(s, int(x), int(y)) for s, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]


# ---------------------------------------------------------------- counts
def _counted(texts: DataFrame, shards: int) -> DataFrame:
    """The distinct trigrams of ``texts(text)`` with their counts, some million tokens at a time."""
    names = [c.split()[0] for c in MODEL.split(", ")]

    def pack(batch: _Batch) -> pa.RecordBatch:
        b, c, a, _, n = batch.trigrams(by_text=False)
        rows = [(s, None, *_shape(b[x:y], c[x:y], a[x:y]), _small(n[x:y])) for s, x, y in _shards(b, shards)]
        return _rows(rows, names, MODEL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch()
        for arrow in batches:
            for texts in _groups(arrow.column("text")):
                held.add(texts)
                if held.tokens >= FLUSH_TOKENS:
                    yield pack(held)
                    held = _Batch()
        if held.tokens:
            yield pack(held)
        given_back()

    return texts.select("text").mapInArrow(count, MODEL)


def _rows(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _merged(table: pa.Table) -> pa.Table:
    """The counts of one shard, and how many trigrams and pairs have counts 1 to 4."""
    some = [(_Packed(row), _plain(row["n"])) for row in _packed_rows(table)]
    firsts = _runs(np.concatenate([p.b for p, _ in some]), np.concatenate([np.diff(p.at) for p, _ in some]))
    edges = [np.append(np.searchsorted(p.b, firsts), len(p.b)).tolist() for p, _ in some]
    lists, counts, seen = [[] for _ in range(5)], [], Counter()
    for k in range(len(firsts)):
        runs = [(p.run(x, y), n[p.at[x]:p.at[y]]) for (p, n), e in zip(some, edges) for x, y in [e[k:k + 2]] if y > x]
        b = np.concatenate([t.b[t.b_of_pair][t.pair] for t, _ in runs])
        c, a = (np.concatenate([x(t) for t, _ in runs]) for x in (lambda t: t.c[t.pair], lambda t: t.a))
        n = np.concatenate([n for _, n in runs]).astype(np.int64)
        order = np.lexsort((a, c, b))
        b, c, a, n = b[order], c[order], a[order], n[order]
        first = np.flatnonzero(_starts(b, c, a))
        n, b, c, a = np.add.reduceat(n, first), b[first], c[first], a[first]
        pairs = np.diff(np.append(np.flatnonzero(_starts(b, c)), len(b)))
        for x, y in (("t", n), ("p", pairs)):
            seen.update({f"{x}{i}": int((y == i).sum()) for i in range(1, 5)})
        for one, more in zip(lists, _lists(b, c, a)):
            one.append(more)
        counts.append(n.astype("<u4"))
    shape = [b"".join(x) if isinstance(x[0], bytes) else _small(np.concatenate(x)) for x in lists]
    names = [*[c.split()[0] for c in MODEL.split(", ")], *[c.split()[0] for c in SEEN.split(", ")]]
    row = (table.column("shard")[0].as_py(), None, *shape, _small(np.concatenate(counts)), *[seen[x] for x in names[-8:]])
    return pa.Table.from_batches([_rows([row], names, f"{MODEL}, {SEEN}")])


def _asked_words(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The words whose unigram a shard needs; the start's is the end's."""
    return _rising(np.concatenate([c, np.where(b == START, END, b)]))


def _unigrams(model: DataFrame, shards: int) -> DataFrame:
    """``(shard, part, n)``: for each shard the numbers of different words before its words, ``part`` by part
    of the hashes; and per part a row without a shard of how many words have numbers 1 to 4, the sum
    and the words."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b, c = _whole(row.b, WORD_BYTES), _whole(row.c, WORD_BYTES)
                words = _asked_words(b, c)
                own, n = np.unique(c, return_counts=True)
                seen = np.zeros(len(words), np.int64)
                seen[np.searchsorted(words, own)] = n
                yield pd.DataFrame([{"part": p, "shard": row.shard, "words": _cut(words[x:y], WORD_BYTES), "n": _small(seen[x:y])}
                                    for p, x, y in _shards(words, shards)])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [_whole(w, WORD_BYTES) for w in pdf["words"]]
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(place, np.concatenate([_numbers(x) for x in pdf["n"]]), len(every)).astype(np.int64)
        ends = np.cumsum([0, *map(len, words)])
        part = pdf["part"].iloc[0]
        rows = [{"shard": s, "part": part, "n": _small(n[place[x:y]])} for s, x, y in zip(pdf["shard"], ends, ends[1:])]
        rows.append({"shard": None, "part": part, "total": int(n.sum()), "words": int((n > 0).sum()),
                     **{f"w{k}": int((n == k).sum()) for k in range(1, 5)}})
        return pd.DataFrame(rows, columns=["shard", "part", "n", "total", "words", *[f"w{k}" for k in range(1, 5)]]).astype(
            {c: "Int64" for c in ["shard", "part", "total", "words", "w1", "w2", "w3", "w4"]})

    dealt = model.select("shard", "b", "c").mapInPandas(
        deal, "part int, shard int, words binary, n binary")
    return dealt.groupBy("part").applyInPandas(
        add, "shard int, part int, n binary, total long, words long, w1 long, w2 long, w3 long, w4 long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The modified discounts of counts 1, 2 and more, from how many have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    steps = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0,
             3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(steps)]


def _off(n: np.ndarray, by: list[float]) -> np.ndarray:
    return np.where(n == 1, by[0], np.where(n == 2, by[1], by[2])) * (n > 0)


class Constants:
    """What a half's shards share: discounts by order, the sum over unigrams, an unknown word's probability."""

    def __init__(self, model: DataFrame, words: DataFrame):
        seen = model.agg(*[F.sum(f"{x}{k}").alias(f"{x}{k}") for x in "tp" for k in range(1, 5)]).first()
        own = words.where("shard is null").agg(*[F.sum(x).alias(x) for x in ("total", "words", "w1", "w2", "w3", "w4")]).first()
        self.off3, self.off2, self.off1 = (discounts(*[r[f"{x}{k}"] for k in range(1, 5)])
                                           for r, x in ((seen, "t"), (seen, "p"), (own, "w")))
        self.total = own["total"]
        more = own["words"] - own["w1"] - own["w2"]
        spare = own["w1"] * self.off1[0] + own["w2"] * self.off1[1] + more * self.off1[2]
        self.unknown = spare / self.total / (own["words"] + 1)


class Shard:
    """The probabilities that one shard's counts give."""

    def __init__(self, row: dict, n1: np.ndarray, k: Constants):
        own, n = _Packed(row), _plain(row["n"])
        self.b = own.b
        self.words = _asked_words(own.b, _whole(row["c"], WORD_BYTES))
        with np.errstate(divide="ignore"):
            # Left of a text's end alone: a word whose unigram is never asked for.
            log1 = np.log((n1 - _off(n1, k.off1)) / k.total + k.unknown)
        self.log_b = log1[np.searchsorted(self.words, np.where(own.b == START, END, own.b))]
        self.lefts = _rising(_whole(row["a"], LEFT_BYTES))
        self.pairs, self.triples = np.empty(len(own.lefts), np.int64), np.empty(len(n), np.int64)
        self.log_g2, self.gain2, self.gain3 = np.empty(len(own.b)), np.empty(len(own.lefts)), np.empty(len(n))
        contexts, log_g3 = [], []
        edges = np.append(np.searchsorted(own.b, _runs(own.b, np.diff(own.at))), len(own.b)).tolist()
        for x, y in zip(edges, edges[1:]):
            t, pairs, triples = own.run(x, y), slice(*own.pair_at[[x, y]]), slice(*own.at[[x, y]])
            b3, left, n3 = t.b_of_pair[t.pair], np.searchsorted(self.lefts, t.a), n[triples].astype(np.int64)
            c = np.searchsorted(self.words, t.c)
            self.pairs[pairs] = (x + t.b_of_pair) * len(self.words) + c
            off2 = _off(t.lefts, k.off2)
            total2 = np.bincount(t.b_of_pair, t.lefts, len(t.b))
            g2 = np.bincount(t.b_of_pair, off2, len(t.b)) / total2
            p2 = (t.lefts - off2) / total2[t.b_of_pair] + g2[t.b_of_pair] * np.exp(log1[c])
            self.log_g2[x:y], self.gain2[pairs] = np.log(g2), np.log(p2) - log1[c]
            self.triples[triples] = (pairs.start + t.pair) * len(self.lefts) + left
            found, place = np.unique((x + b3) * len(self.lefts) + left, return_inverse=True)
            off3 = _off(n3, k.off3)
            total3 = np.bincount(place, n3)
            g3 = np.bincount(place, off3) / total3
            p3 = (n3 - off3) / total3[place] + g3[place] * p2[t.pair]
            self.gain3[triples] = np.log(p3) - log1[c][t.pair]
            contexts.append(found)
            log_g3.append(np.log(g3))
        self.contexts, self.log_g3 = np.concatenate(contexts), np.concatenate(log_g3)

    def values(self, t: _Trigrams, unknown: float) -> np.ndarray:
        """Each trigram's part of a text's log probability."""
        b = _find(self.b, t.b)
        first = np.where(b >= 0, self.log_b[b], np.log(unknown))
        word = _find(self.words, t.c)
        b2 = b[t.b_of_pair]
        pair = _find_some(self.pairs, b2, word, len(self.words))
        second = np.where(pair >= 0, self.gain2[pair], np.where(b2 >= 0, self.log_g2[b2], 0.0))
        left, pair3, b3 = _find(self.lefts, t.a), pair[t.pair], b2[t.pair]
        width = len(self.lefts)
        triple = _find_some(self.triples, pair3, left, width)
        context = _find_some(self.contexts, np.where(triple < 0, b3, -1), left, width)
        third = np.where(triple >= 0, self.gain3[triple],
                         second[t.pair] + np.where(context >= 0, self.log_g3[context], 0.0))
        return third + first[t.b_of_pair][t.pair]


def _find(rising: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where there is none."""
    at = np.minimum(np.searchsorted(rising, keys), len(rising) - 1)
    return np.where(rising[at] == keys, at, -1)


def _find_some(rising: np.ndarray, high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The place of each key ``high * width + low``, -1 where either is -1."""
    out = np.full(len(high), -1)
    known = np.flatnonzero((high >= 0) & (low >= 0))
    out[known] = _find(rising, high[known] * width + low[known])
    return out


# ---------------------------------------------------------------- scoring
def _asked(docs: DataFrame, shards: int) -> DataFrame:
    """The distinct trigrams of many texts of ``docs(at, text)`` at a time with the texts that have each and how
    often; the first row of a batch also has the keys and sizes of all its texts."""
    names = [c.split()[0] for c in ASKED.split(", ")]

    def pack(batch: _Batch, ats: list, number: int) -> pa.RecordBatch:
        b, c, a, text, times = batch.trigrams(by_text=True)
        ats = np.concatenate(ats)
        head = np.flatnonzero(_starts(b, c, a))
        bounds = np.append(head, len(b))
        sizes = np.diff(bounds)
        b, c, a = b[head], c[head], a[head]
        kind = "<u2" if len(ats) <= 1 << 16 else "<u4"
        parts = _shards(b, shards) or [(0, 0, 0)]
        rows = []
        for s, x, y in parts:
            own = slice(bounds[x], bounds[y])
            rows.append((s, number, len(ats), *_shape(b[x:y], c[x:y], a[x:y]), _small(sizes[x:y]),
                         _small(text[own], kind), _small(times[own]),
                         _small(ats.reshape(-1), "<i8") if s == parts[0][0] else None))
        return _rows(rows, names, ASKED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, ats = _Batch(), []
        for arrow in batches:
            keys, done = arrow.column("at").to_numpy(), 0
            for texts in _groups(arrow.column("text")):
                ats.append(np.stack([keys[done:done + len(texts)], held.add(texts)], axis=1))
                done += len(texts)
                if held.tokens >= FLUSH_TOKENS or sum(map(len, ats)) >= FLUSH_TOKENS:
                    yield pack(held, ats, number)
                    held, ats, number = _Batch(), [], number + 1
        if ats:
            yield pack(held, ats, number)
        given_back()

    return docs.select("at", "text").mapInArrow(deal, ASKED)


def _sums(k: Constants):
    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        counts, parts, shard = [], {}, None
        for row in _packed_rows(own):
            if row["b"] is not None:
                counts.append(row)
            else:
                parts[row["part"]] = _numbers(row["n"])
        if counts:
            shard = Shard(counts.pop(), np.concatenate([parts[p] for p in sorted(parts)]), k)
        rows = []
        for row in _packed_rows(asked):
            t = _Packed(row).whole()
            value = shard.values(t, k.unknown) if shard else np.full(len(t.a), np.log(k.unknown))
            docs = _numbers(row["docs"], "<u2" if row["texts"] <= 1 << 16 else "<u4")
            each = np.repeat(value, _numbers(row["sizes"])) * _numbers(row["times"])
            rows.append((row["batch"], _small(np.bincount(docs, each, row["texts"]), "<f8"),
                         row["ats"] and row["ats"].to_pybytes()))
        given_back()
        return pa.Table.from_batches([_rows(rows, ["batch", "sums", "ats"], SUMS)])

    return score


def _costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of a batch's texts over all shards."""
    total = np.sum([_numbers(x, "<f8") for x in pdf["sums"]], axis=0)
    ats = _numbers(pdf["ats"].dropna().iloc[0], "<i8").reshape(-1, 2)
    return pd.DataFrame({"at": ats[:, 0], "symbols": ats[:, 1], "cost": np.rint(-total * MICRO).astype(np.int64)})


@contextmanager
def _freeing(spark: SparkSession):
    """Shuffle files go when the job that made them has ended; nothing here reads them again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def word_costs(docs: DataFrame, good: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``(at, symbols, cost)`` of every :func:`row_key`: tokens (and an end) and micro-nats;
    None without any trusted text.

    Words are told apart by hashes of 48 bits, left neighbours of a pair by 40: two that share one add up."""
    spark = docs.sparkSession
    given = docs.select(row_key(id_col, text_col).alias("at"), F.col(id_col).cast("long").alias("doc_id"),
                        half_of(id_col).alias("f"), text_or_empty(text_col).alias("text"))
    shards = int(1 + (given.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS)

    def counts(half: int) -> tuple[DataFrame, DataFrame] | None:
        # Ids grow with the corpus: the texts of a half are shuffled to their ids, never a broadcast.
        trusted = stored(given.where(F.col("f") == half).join(good.hint("shuffle_merge"), "doc_id", "left_semi").where(
            "text <> ''").select("text"), "words-trusted")
        model = stored(_counted(trusted, shards).groupBy("shard").applyInArrow(_merged, f"{MODEL}, {SEEN}"), "words-counts")
        dropped(trusted)
        if model.isEmpty():
            dropped(model)
            return None
        return model, stored(_unigrams(model, shards), "words-unigrams")

    def trusted_in(half: int) -> bool:
        """Whether the half has a trusted text with any token."""
        some = given.where(F.col("f") == half).where(F.col("text").rlike(r"\S|\n")).select("doc_id")
        return not some.join(good, "doc_id", "left_semi").isEmpty()

    with _freeing(spark):
        costs, alone = [], [h for h in range(HALVES) if not trusted_in(h)]
        for half in range(HALVES):
            found = None if half in alone else counts(half)
            if found is None:
                continue
            model, words = found
            k = Constants(model, words)
            names = [c.split()[0] for c in MODEL.split(", ")]
            own = model.select(*names).unionByName(words.where("shard is not null").select("shard", "part", "n"),
                                                   allowMissingColumns=True)
            # A row is scored by the other half; if that one is empty, by its own.
            for other in range(HALVES):
                if other == half and not alone:
                    continue
                for part in range(ROUNDS):
                    asked = given.where((F.col("f") == other) & (F.pmod(F.shiftright("at", 8), F.lit(ROUNDS)) == part))
                    sums = own.groupBy("shard").cogroup(_asked(asked, shards).groupBy("shard")).applyInArrow(
                        _sums(k), SUMS)
                    costs.append(stored(sums.groupBy("batch").applyInPandas(
                        _costs, "at long, symbols long, cost long"), "words-sums"))
            dropped(model)
            dropped(words)
        if not costs:
            return None
        every = costs[0]
        for more in costs[1:]:
            every = every.unionByName(more)
        return stored(every.groupBy("at").agg(F.first("symbols").alias("symbols"), F.first("cost").alias("cost")), "words-costs")
