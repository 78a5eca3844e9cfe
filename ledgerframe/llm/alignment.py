"""Alignment of two tokenizers' ids of the same text (operator 11).

``A`` is a byte-level BPE vocabulary, ``B`` a sentencepiece model that puts a space
before the text. Both cut a space and the text into byte ranges; offsets where ranges of
both end cut the tokens into groups, and the two tokens that end at such an offset are
linked.

The ends are merged in lockstep: one state vector holds the A and B pointers of all
lanes, a step compares the ends at all pointers, emits links and cuts where they are equal
and advances the pointer of the smaller end (both, where equal). Finished lanes are
compacted away. A lane is a document, or part of a long one: a document is parted at
offsets where both end, so that a very long text is many lanes and not many steps.

Of two linked tokens one's bytes end with the other's, so the id pairs that can be linked
at all are listed from the vocabularies (some hundred thousand, whatever the corpus). A link
is stored as its pair's number in that list, the corpus-wide counts are one number per
pair, and they are all that goes back to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import stored, text_or_empty
from ledgerframe.llm.token_ids import byte_letters, byte_ranks

#: Characters of the texts that are aligned together (a longer text alone).
GROUP_CHARS = 2_000_000
#: About as many A tokens are in a lane of a long document.
LANE_TOKENS = 256
#: Tokens after the wanted place that are tried for the end of a lane.
LANE_TRIES = 64
#: Fixed value: how a byte-level tokenizer splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
#: Chunks that go to the sentencepiece library as one text.
CHUNKS_TOGETHER = 256
#: Chunks that are empty, that begin or end with white space or hold the mark of a space in
#: pieces: their neighbours could matter.
EDGE = ("^[{0}]|[{0}]$|^$|" + BLANK).format(
    "\\x09-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
#: White space that the pattern search of the fast encoder may not hold.
LONG_BLANK = re.compile(r"\s{1000}")
ROWS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, links binary, groups_sha256 string")


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteTokens:
    """Ids of a byte-level vocabulary and each id's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in whole["model"]["vocab"].items()
                         if all(c in byte_of for c in t)}
        self.path, self.merges, self._library = path, None, None
        split, found = whole["pre_tokenizer"] or {}, byte_ranks(whole)
        if (found and not whole["normalizer"] and split.get("type") == "ByteLevel"
                and split.get("use_regex") and not split.get("add_prefix_space")):
            import tiktoken

            ranks, self.id_of_rank = found
            self.merges = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text behind a space."""
        return [self._by_library(f" {t}") if self.merges is None or LONG_BLANK.search(t)
                else self._merged(f" {t}") for t in texts]

    def units(self, chunks: list[str]) -> np.ndarray:
        """The ids of all chunks in a row, each behind a space."""
        whole = " ".join(["", *chunks])
        return self._merged(whole) if self.merges else self._by_library(whole)

    def _merged(self, text: str) -> np.ndarray:
        return self.id_of_rank[np.array(self.merges.encode_ordinary(text), np.int64)]

    def _by_library(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return np.array(self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


class PieceTokens:
    """Ids of a sentencepiece model and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        #: Whether no piece reaches over a space, so that each chunk's ids are its own.
        self.splits = not any(BLANK in self.model.id_to_piece(i).lstrip(BLANK) for i in self.bytes_of)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u4") for ids in self.model.encode(texts, num_threads=1)]

    def units(self, chunks: list[str]) -> np.ndarray:
        blocks = [" ".join(chunks[at:at + CHUNKS_TOGETHER]) for at in range(0, len(chunks), CHUNKS_TOGETHER)]
        return np.array(list(chain.from_iterable(self.model.encode(blocks, num_threads=1))), "<u4")


def linkable(a: dict[int, bytes], b: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All id pairs of which one's bytes end with the other's, by A and B id."""
    ids_of: list[dict[bytes, list[int]]] = []
    for tokens in (a, b):
        ids: dict[bytes, list[int]] = {}
        for i, raw in tokens.items():
            if raw:
                ids.setdefault(raw, []).append(i)
        ids_of.append(ids)
    of_a, of_b = ids_of
    pairs = [(i, j) for raw, own in of_a.items() for at in range(len(raw))
             for j in of_b.get(raw[at:], ()) for i in own]
    pairs += [(i, j) for raw, own in of_b.items() for at in range(1, len(raw))
              for i in of_a.get(raw[at:], ()) for j in own]
    pairs.sort()
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray,
             a_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a_ends`` and ``b_ends`` (both rising) of all equal ends, by position.

    A lane begins at ``a_at`` and ``b_at``, behind an equal end, and stops before
    ``a_stop``, whose last end is an equal one."""
    links_a, links_b = [], []
    alive = a_at < a_stop
    i, j, stop = a_at[alive], b_at[alive], a_stop[alive]
    while len(i):
        a, b = a_ends[i], b_ends[j]
        equal = a == b
        links_a.append(i[equal])
        links_b.append(j[equal])
        i = i + (a <= b)
        j = j + (b <= a)
        alive = i < stop
        if not alive.all():
            i, j, stop = i[alive], j[alive], stop[alive]
    if not links_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    links_a, links_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(links_a)
    return links_a[order], links_b[order]


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray,
          size: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a_at, b_at, a_stop)`` of lanes of about ``size`` A tokens; documents begin at the first
    and end at the last numbers of ``a_docs`` and ``b_docs``."""
    tokens = np.diff(a_docs)
    parts = np.maximum(1, tokens // size)
    doc = np.repeat(np.arange(len(tokens)), parts - 1)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1) + 1
    # The wanted last token of a part; the next tokens are tried until both end together.
    want = a_docs[doc] + k * size - 1
    found_a, found_b = [], []
    for _ in range(LANE_TRIES):
        at = np.searchsorted(b_ends, a_ends[want])
        both = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[want] if len(want) else at > 0
        found_a.append(want[both] + 1)
        found_b.append(at[both] + 1)
        want = want[~both] + 1
        want = want[want < len(a_ends)]
        if not len(want):
            break
    a_at = np.concatenate([a_docs[:-1], *found_a])
    b_at = np.concatenate([b_docs[:-1], *found_b])
    a_at, first = np.unique(a_at, return_index=True)
    keep = a_at < a_docs[-1]
    a_at, b_at = a_at[keep], b_at[first][keep]
    return a_at, b_at, np.append(a_at[1:], a_docs[-1])


class Aligned:
    """The tokens, links and groups of some texts; texts that do not come back from their
    tokens' bytes have none."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        self.aligner = aligner
        raw = b"".join([f" {t}".encode("utf-8", "surrogatepass") for t in texts])
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
        whole = np.array([bool(t) for t in texts])
        encoded = aligner.encode(texts)
        for tokens, (flat, ends) in zip((aligner.a, aligner.b), encoded):
            whole &= came_back(aligner.raw_of[tokens], flat, ends, raw, sizes)
        (self.a, self.a_docs), (self.b, self.b_docs) = (_only(flat, ends, whole) for flat, ends in encoded)
        self.a_ends = np.cumsum(aligner.size_of[aligner.a][self.a])
        self.b_ends = np.cumsum(aligner.size_of[aligner.b][self.b])
        starts = lanes(self.a_ends, self.b_ends, self.a_docs, self.b_docs, aligner.lane)
        self.links_a, self.links_b = lockstep(self.a_ends, self.b_ends, *starts)
        #: Links (and groups) of each document end here.
        self.of_doc = np.searchsorted(self.links_a, self.a_docs)

    def pairs(self) -> np.ndarray:
        """The number of each link's id pair."""
        return self.aligner.number(self.a[self.links_a], self.b[self.links_b])

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document; '' without tokens."""
        cut_a, cut_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        cut_a[self.links_a], cut_b[self.links_b] = True, True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        # A group's B ids follow its A ids.
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.links_b + 1])[group_a]
        place_b = np.arange(len(self.b)) + self.links_a[group_b] + 1
        n = len(self.a) + len(self.b)
        ids, marks = np.empty(n, np.int64), np.empty(n, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a] = np.where(cut_a, ord("|"), ord(","))
        marks[place_b] = np.where(cut_b, ord(";"), ord(","))
        digits, sizes = self.aligner.digits
        rows, long = digits[ids], sizes[ids]
        rows[np.arange(n), long] = marks
        flat = rows[np.arange(rows.shape[1]) <= long[:, None]]
        ends = np.concatenate([[0], np.cumsum(long + 1)])[self.a_docs + self.b_docs].tolist()
        return [hashlib.sha256(flat[a:b - 1]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:])]


def came_back(raw_of: pa.Array, flat: np.ndarray, ends: np.ndarray, raw: bytes, sizes: np.ndarray) -> np.ndarray:
    """Which texts are the bytes of their tokens; ``raw`` has all texts' bytes in a row."""
    joined = raw_of.take(pa.array(flat.astype(np.int64)))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(flat) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    at = (offsets - offsets[0])[np.concatenate([[0], ends])]
    want, want_at = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    if np.array_equal(at, want_at) and np.array_equal(data, want):
        return np.ones(len(sizes), bool)
    return np.array([np.array_equal(data[a:b], want[c:d]) for a, b, c, d in
                     zip(at, at[1:], want_at, want_at[1:])], bool)


def _only(flat: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts, and where each text's begin and the last one's end."""
    sizes = np.diff(ends, prepend=0)
    return flat[np.repeat(some, sizes)].astype(np.int64), np.cumsum(np.concatenate([[0], sizes * some]))


class Aligner:
    """Both tokenizers and the id pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str, lane: int = LANE_TOKENS):
        self.a, self.b, self.lane = ByteTokens(a_path), PieceTokens(b_path), lane
        self.size_of, self.raw_of, self.spaced = {}, {}, {}
        for tokens in (self.a, self.b):
            raw = [tokens.bytes_of.get(i, b"") for i in range(max(tokens.bytes_of) + 2)]
            self.size_of[tokens] = np.array([len(r) for r in raw], np.int64)
            self.raw_of[tokens] = pa.array(raw, pa.large_binary())
            self.spaced[tokens] = np.array([r.startswith(b" ") for r in raw])
        self.pair_a, self.pair_b = linkable(self.a.bytes_of, self.b.bytes_of)
        self.stride = int(self.pair_b.max()) + 1
        self.keys = self.pair_a * self.stride + self.pair_b
        ids = max(len(s) for s in self.size_of.values())
        width = len(str(ids))
        self.digits = (np.zeros((ids, width + 1), np.uint8), np.array([len(str(i)) for i in range(ids)]))
        for i in range(ids):
            text = str(i).encode()
            self.digits[0][i, :len(text)] = np.frombuffer(text, np.uint8)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By A and by B: the ids of all texts in a row, and each text's end.

        Single spaces between other characters part a text into chunks whose ids are their own
        in both vocabularies; each different chunk is encoded once, other texts whole."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        places = cut.flatten().dictionary_encode()
        at, of = cut.offsets.to_numpy(), places.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = places.dictionary
        bad = pc.match_substring_regex(chunks, EDGE).to_numpy(zero_copy_only=False) if self.b.splits else True
        bad = np.broadcast_to(bad, len(chunks))
        odd = np.add.reduceat(bad[of], at[:-1]) > 0
        easy = np.flatnonzero(~bad)
        # An odd text is a unit of its own, in the place of its first chunk.
        unit = np.full(len(chunks), -1, np.int64)
        unit[easy] = np.arange(len(easy))
        units = unit[of]
        units[at[:-1][odd]] = len(easy) + np.arange(odd.sum())
        kept = ~np.repeat(odd, np.diff(at))
        kept[at[:-1][odd]] = True
        ends = np.cumsum(kept)[at[1:] - 1]
        words, rest = chunks.take(pa.array(easy)).to_pylist(), [t for t, o in zip(texts, odd) if o]
        out = []
        for tokens in (self.a, self.b):
            flat = tokens.units(words) if words else np.empty(0, "<u4")
            heads = np.flatnonzero(self.spaced[tokens][flat])
            if len(heads) != len(words):
                raise ValueError("a token reaches over a space")
            alone = tokens.encode(rest)
            offsets = np.cumsum(np.concatenate([[0], np.diff(np.append(heads, len(flat))), [len(x) for x in alone]]))
            ids = pa.LargeListArray.from_arrays(offsets.astype(np.int64), np.concatenate([flat, *alone])).take(
                pa.array(units[kept]))
            out.append((ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()[ends]))
        return out

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a * self.stride + b).astype("<i4")

    def groups(self, texts: list[str]) -> Iterator[Aligned]:
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                yield Aligned(self, group)
                group, size = [], 0
        if group:
            yield Aligned(self, group)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    return Aligner(a_path, b_path)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def align(docs: DataFrame, models: tuple[str, str] | None = None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, a_ids, b_ids, links_a, links_b, cuts)``: both tokenizers' ids, the positions in
    them of linked tokens, and the byte offsets (in a space and the text) where both end.

    Empty and null texts, and texts that do not come back from both tokenizers' bytes, have
    empty lists. Null ids and repeated rows are documents like others; other columns are
    not read; an empty table gives no rows."""
    models = models or default_models()
    names = ["doc_id", "a_ids", "b_ids", "links_a", "links_b", "cuts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for got in aligner(*models).groups(batch.column(1).to_pylist()):
                n = len(got.a_docs) - 1
                count = np.diff(got.of_doc)
                origin = np.concatenate([[0], got.a_ends])[got.a_docs[:-1]]
                lists = [(got.a, got.a_docs), (got.b, got.b_docs),
                         (got.links_a - np.repeat(got.a_docs[:-1], count), got.of_doc),
                         (got.links_b - np.repeat(got.b_docs[:-1], count), got.of_doc),
                         (got.a_ends[got.links_a] - np.repeat(origin, count), got.of_doc)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(before, n),
                     *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                       for flat, ends in lists]], names)
                before += n

    schema = "doc_id long, " + ", ".join(f"{n} array<long>" for n in names[1:])
    return _given(docs, id_col, text_col).mapInArrow(run, schema)


def linked(docs: DataFrame, models: tuple[str, str] | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The stored alignment: per document its numbers, digest and links (4 bytes each, the
    numbers of their id pairs). Rows as in :func:`align`."""
    models = models or default_models()
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for got in aligner(*models).groups(batch.column(1).to_pylist()):
                n = len(got.a_docs) - 1
                count = pa.array(np.diff(got.of_doc).astype(np.int64))
                links = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer((4 * got.of_doc).astype("<i4")), pa.py_buffer(got.pairs())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(before, n), pa.array(np.diff(got.a_docs)), pa.array(np.diff(got.b_docs)),
                     count, count, links, pa.array(got.digests(), pa.string())], names)
                before += n

    return stored(_given(docs, id_col, text_col).mapInArrow(run, ROWS), "aligned")


def _links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch in a row, and where each document's end."""
    each = [np.frombuffer(x.as_buffer(), "<i4") for x in column]
    return np.concatenate([np.empty(0, "<i4"), *each]), np.cumsum([0, *map(len, each)])


def pair_counts(rows: DataFrame, models: tuple[str, str] | None = None) -> DataFrame:
    """``(pair, n)``: how many links of :func:`linked` rows hold each id pair. A task sums its
    links by pair, so at most one row per pair and task is shuffled."""
    models = models or default_models()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(*models).keys), np.int64)
        for batch in batches:
            total += np.bincount(_links(batch.column(0))[0], minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["pair", "n"])

    return rows.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def id_pairs(docs: DataFrame, models: tuple[str, str] | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(a_id, b_id, n, best)``: linked id pairs, their links, and whether no A id has more
    links with that B id."""
    models = models or default_models()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*models)
        for batch in batches:
            pair = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(both.pair_a[pair]), pa.array(both.pair_b[pair]),
                                              batch.column(1)], ["a_id", "b_id", "n"])

    counted = pair_counts(linked(docs, models, id_col, text_col), models).mapInArrow(
        ids, "a_id long, b_id long, n long")
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    return counted.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def digests(docs: DataFrame, models: tuple[str, str] | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best`` (links whose pair is
    the corpus-wide most frequent of its B id, ties included), ``count_sum`` (the counts of all
    its links' pairs) and ``groups_sha256``. Rows without tokens: zeros and ''."""
    models = models or default_models()
    rows = linked(docs, models, id_col, text_col)
    # At most one row per linkable id pair, which the vocabularies bound.
    found = pair_counts(rows, models).toPandas()
    both = aligner(*models)
    counts = np.zeros(len(both.keys), np.int64)
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    most = np.zeros(both.stride, np.int64)
    np.maximum.at(most, both.pair_b, counts)
    best = counts == most[both.pair_b]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, ends = _links(batch.column("links"))
            sums = [np.diff(np.concatenate([[0], np.cumsum(worth[links])])[ends])
                    for worth in (best.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names[:5]], *map(pa.array, sums), batch.column("groups_sha256")],
                [*names[:5], "n_best", "count_sum", "groups_sha256"])

    names = [c.split()[0] for c in ROWS.split(", ")]
    return rows.mapInArrow(look_up, ROWS.replace("links binary", "n_best long, count_sum long"))
