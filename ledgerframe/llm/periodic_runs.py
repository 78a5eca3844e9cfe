"""Periodic runs of words (operator 12): descending-LCP Kruskal.

A run is a longest stretch of words with smallest period ``q`` (words ``q`` apart are
equal) and at least two periods long. For the texts of a group the suffixes are sorted
by prefix doubling and the common prefixes (LCP) of neighbours taken from the ranks of
the doubling steps. The neighbours' links are then joined by decreasing LCP: every
suffix class is an ordered set of positions, the smaller of two classes enters the
larger one, and two positions that become adjacent at a distance ``d`` within the LCP
``l`` seed a run of period ``d`` that ends ``l`` words after the second. A run's first
position and the one a period later are such a pair, and no pair has a period that is
not its stretch's smallest: a smaller one would divide it, and put a position of the
same class between the two. So seeds of one period and end are one run, which begins at
the first of them.

A run of ``least`` words needs an LCP of half as many. Texts without a repeated stretch
of that length are not sorted, and classes whose positions are all further apart than
their longest LCP cannot seed a run and are not joined.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import text_or_empty

#: Words of the shortest run.
LEAST = 12
#: Characters of the texts that are analysed together (a longer text alone).
GROUP_CHARS = 8_000_000
DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of non-negative numbers."""
    out = keys[0]
    for key in keys[1:]:
        out = np.unique(out * (int(key.max(initial=0)) + 1) + key, return_inverse=True)[1]
    return out


def _repeat(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of stretches that are ``first`` and, ``shift`` on, ``second``, where they
    occur again; -1 elsewhere."""
    out = np.full(len(first), -1, np.int64)
    here = np.flatnonzero((first[:len(first) - shift] >= 0) & (second[shift:] >= 0))
    if len(here):
        key = first[here] * (int(second.max()) + 1) + second[here + shift]
        _, rank, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[rank] > 1
        out[here[again]] = rank[again]
    return out


def repeating(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Positions where a stretch of ``size`` words begins that its document has again."""
    if len(words) < size:
        return np.empty(0, np.int64)
    one = _ranks(doc, words)
    one = np.where(np.bincount(one)[one] > 1, one, -1)
    # Stretches by doubling, as long as they fit, then one that overlaps.
    have, length = one, 1
    while length < size:
        shift = min(length, size - length)
        have, length = _repeat(have, have, shift), length + shift
    return np.flatnonzero(have >= 0)


def suffix_links(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(x, y, lcp)`` of neighbouring suffixes with an LCP of at least ``least``.

    Each document of ``words`` ends with a word that nothing else equals."""
    n = len(words)
    rank = _ranks(doc, words)
    order = np.argsort(rank, kind="stable")
    begins = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    place = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = place  # the first place of the class
    levels, length = [rank.astype(np.int32)], 1
    while True:
        # Places in classes of more than one suffix are ordered by the class that follows.
        alone = begins & np.append(begins[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        some = order[open_at]
        # A class never reaches beyond its document's last word.
        after = rank[np.minimum(some + length, n - 1)]
        some = some[np.lexsort((after, rank[some]))]
        order[open_at] = some
        own, after = rank[some], rank[np.minimum(some + length, n - 1)]
        starts = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        begins[open_at] = starts
        rank = rank.copy()
        rank[some] = open_at[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
        length *= 2
        levels.append(rank.astype(np.int32))
    x, y = order[:-1], order[1:]
    near = levels[min(least, 1 << (len(levels) - 1)).bit_length() - 1]
    same = near[x] == near[y]
    x, y = x[same], y[same]
    lcp = np.zeros(len(x), np.int64)
    for step in range(len(levels) - 1, -1, -1):
        equal = levels[step][np.minimum(x + lcp, n - 1)] == levels[step][np.minimum(y + lcp, n - 1)]
        lcp[equal] += 1 << step
    long = lcp >= least
    return x[long], y[long], lcp[long]


def _promising(x: np.ndarray, y: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Links of the classes (links in a row) in which two positions are within the longest LCP."""
    first = np.concatenate([[True], x[1:] != y[:-1]])
    group = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    position = np.concatenate([x[heads], y])
    of = np.concatenate([group[heads], group])
    order = np.lexsort((position, of))
    position, of = position[order], of[order]
    gap = np.where(of[1:] == of[:-1], position[1:] - position[:-1], np.iinfo(np.int64).max)
    nearest = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(nearest, of[1:], gap)
    return (nearest <= np.maximum.reduceat(lcp, heads))[group]


def seeds(x: np.ndarray, y: np.ndarray, lcp: np.ndarray) -> dict[tuple[int, int], int]:
    """The first position of each (period, end) that joining the links seeds."""
    order = np.argsort(-lcp, kind="stable")
    places, local = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    classes = [[p] for p in places.tolist()]
    owner = list(range(len(classes)))
    found: dict[tuple[int, int], int] = {}

    def seed(begin: int, second: int, near: int) -> None:
        if second - begin <= near:
            key = (second - begin, second + near)
            if found.get(key, begin) >= begin:
                found[key] = begin

    local = local.tolist()
    for a, b, near in zip(local[:len(x)], local[len(x):], lcp[order].tolist()):
        while owner[a] != a:  # path halving
            owner[a] = a = owner[owner[a]]
        while owner[b] != b:
            owner[b] = b = owner[owner[b]]
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        large, small = classes[a], classes[b]
        owner[b], classes[b] = a, None
        if len(small) == 1:
            p = small[0]
            at = bisect_left(large, p)
            if at:
                seed(large[at - 1], p, near)
            if at < len(large):
                seed(p, large[at], near)
            large.insert(at, p)
            continue
        cuts = [bisect_left(large, p) for p in small]
        for k, (p, at) in enumerate(zip(small, cuts)):
            # Neighbours of the larger class that no other newcomer parts from p.
            if at and (not k or cuts[k - 1] < at):
                seed(large[at - 1], p, near)
            if at < len(large) and (k + 1 == len(small) or cuts[k + 1] > at):
                seed(p, large[at], near)
        if len(small) * 16 < len(large):
            for p in small:
                insort(large, p)
        else:
            classes[a] = sorted(large + small)  # two rising runs: linear
    return found


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``(document, start, length, period)`` of all runs of at least ``least`` words, by
    document, start and period. ``words`` are the word numbers of all documents in a row,
    ``ends`` where each ends. Starts count from the document's first word."""
    none = np.empty((0, 4), np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - begins)
    half = -(-least // 2)
    own = np.unique(doc[repeating(words, doc, half)])
    if not len(own):
        return none
    # The documents that repeat anything, each closed by a word that no other text has.
    sizes = (ends - begins)[own]
    stops = np.cumsum(sizes + 1)
    starts = stops - sizes - 1
    text = np.empty(stops[-1], np.int64)
    inner = np.ones(len(text), bool)
    inner[stops - 1] = False
    local = np.repeat(np.arange(len(own)), sizes + 1)
    text[inner] = words[np.repeat(begins[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    text[stops - 1] = int(words.max()) + 1
    x, y, lcp = suffix_links(text, local, half)
    if not len(x):
        return none
    some = _promising(x, y, lcp)
    found = seeds(x[some], y[some], lcp[some])
    rows = np.array([(begin, end - begin, period) for (period, end), begin in found.items()
                     if end - begin >= least], np.int64).reshape(-1, 3)
    of = local[rows[:, 0]]
    rows = np.column_stack([own[of], rows[:, 0] - starts[of], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


class Group:
    """The words, runs and kept words of some texts."""

    def __init__(self, texts: list[str], least: int):
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words, ends = cut.flatten(), cut.offsets.to_numpy()[1:].astype(np.int64)
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        self.words = words.filter(pa.array(real))
        self.ends = np.concatenate([[0], np.cumsum(real)])[ends]
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        codes = self.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.runs = find_runs(codes, self.ends, least)
        self.of_text = np.searchsorted(self.runs[:, 0], np.arange(len(texts) + 1))

    def runs_of(self, text: int) -> list[list[int]]:
        return self.runs[self.of_text[text]:self.of_text[text + 1], 1:].tolist()

    def collapsed(self) -> pa.Array:
        """Every text's words, joined by one space, without those after the first period of a run."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        at = self.begins[self.runs[:, 0]] + self.runs[:, 1]
        np.add.at(edge, at + self.runs[:, 3], 1)
        np.add.at(edge, at + self.runs[:, 2], -1)
        kept = np.cumsum(edge[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], self.ends])]
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.words.filter(pa.array(kept)))
        return pc.binary_join(words, pa.scalar(" ", pa.large_string()))


def _groups(texts: list[str], least: int) -> Iterator[Group]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > GROUP_CHARS:
            yield Group(group, least)
            group, size = [], 0
    if group:
        yield Group(group, least)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, period)`` of every run of at least ``least`` words (numbered from 0).

    Null and empty texts have no runs, null ids and repeated rows are documents like
    others, other columns are not read. A text is analysed whole, in one task, whatever
    its length; memory is some 30 numbers per word of the longest text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for group in _groups(batch.column(1).to_pylist(), least):
                found = group.runs
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found[:, 0] + before)),
                     *[pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)]],
                    ["doc_id", "start", "length", "period"])
                before += len(group.ends)

    return _given(docs, id_col, text_col).mapInArrow(find, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with one period of every run left; words are joined by one space."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for group in _groups(batch.column(1).to_pylist(), least):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(before, len(group.ends)), group.collapsed().cast(pa.string())],
                    ["doc_id", "text"])
                before += len(group.ends)

    return _given(docs, id_col, text_col).mapInArrow(cut, "doc_id long, text string")


def digests(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the number of runs, the longest one (ties: first start, then period) and SHA-256
    of all runs (``start,length,period`` lines) and of the collapsed text. See :func:`runs`."""
    def sha(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for group in _groups(batch.column(1).to_pylist(), least):
                rows = []
                for k, text in enumerate(group.collapsed()):
                    own = group.runs_of(k)
                    best = max(own, key=lambda r: (r[1], -r[0], -r[2])) if own else None
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                    rows.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                                 sha(lines.encode()), sha(text.as_buffer())))
                columns = [list(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(before, len(rows)),
                     *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]],
                    [c.split()[0] for c in DIGESTS.split(", ")])
                before += len(rows)

    return _given(docs, id_col, text_col).mapInArrow(digest, DIGESTS)

