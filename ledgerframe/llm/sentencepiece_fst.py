"""SentencePiece encoding and decoding by weighted transducers (operator 2).

A model file is compiled once per worker into three transducers: the normaliser
(blanks become the meta symbol, one in front of the text), the pieces (a trie from the
start state over a piece's characters back to it, with the piece's cost as weight) and
the byte fallback (characters without a piece become their UTF-8 byte pieces). A text
is composed with them lazily, state by state, and the tropical-semiring shortest path
from its start to its end gives the pieces.

For unigram models a state is a position. For BPE models a state is a position and the
piece that ends there, and an arc to the next piece exists only if merging the two
pieces' characters gives back exactly these two. A sequence of pieces is what the merges
of the whole text give if and only if that holds for every neighbouring pair (the first
merge across a border would also be the first one across it in the pair alone), so the
composition has one accepting path, the model's own segmentation.

Only normaliser rules that keep characters are compiled (the identity); a model with a
character map of its own is refused rather than encoded differently.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import text_or_empty

META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO_WORDS, MEMO_CHARS, MEMO_PAIRS = 600_000, 48, 1_000_000
MARKS = ".,;:!?#$%&*|"
#: Fixed value: an unknown character of a unigram model scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducers:
    """The compiled model; ``encode`` composes a text with it and finds the path."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        model = model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if (norm.precompiled_charsmap or self.kind not in (UNIGRAM, BPE)
                or model.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces):
            raise ValueError("only unigram and BPE models with the identity normaliser are compiled")
        self.dummy_prefix, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.names = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.unknown = self.types.index(UNKNOWN)
        normal = [x for x, t in zip(self.scores, self.types) if t == NORMAL] or [0.0]
        self.unknown_score = np.float32(min(normal)) - np.float32(UNKNOWN_PENALTY)
        # A user's symbol is worth more than any pieces over it; scores add up in single precision.
        self.weights = [np.float32(len(n.encode()) * max(normal) - 0.1 if t == USER else x)
                        for n, t, x in zip(self.names, self.types, self.scores)]
        self.bytes = {int(n[3:5], 16): i for i, (n, t) in enumerate(zip(self.names, self.types))
                      if t == BYTE}
        self.ids = {n: i for i, (n, t) in enumerate(zip(self.names, self.types))
                    if t in (NORMAL, USER)}
        # The piece transducer: a trie; the entry under "" leaves with the piece's id.
        self.trie: dict = {}
        for name, i in self.ids.items():
            state = self.trie
            for mark in name:
                state = state.setdefault(mark, {})
            state[""] = i
        if self.kind == BPE and any(c not in self.ids for n in self.ids for c in n):
            raise ValueError("a character of some piece has no piece of its own")
        # Pieces never cross from other text into the meta symbol; line ends that no longer
        # piece holds are borders as well.
        long = [n for n in self.ids if len(n) > 1]
        self.splits_words = not any(META in n.lstrip(META) for n in long)
        self.splits_lines = not any("\n" in n for n in long)
        self.surface = [self._surface(i) for i in range(len(self.names))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _surface(self, i: int) -> bytes:
        """What a piece decodes to."""
        if self.types[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.types[i] == CONTROL else self.names[i].replace(META, " ").encode()

    def normalise(self, text: str) -> str:
        """The normaliser's output string; without text there is none."""
        text = text.replace(META, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (META if self.dummy_prefix else "") + text.replace(" ", META)

    def merged(self, marks: str) -> list[str]:
        """The merges of a short string: the best-scored pair first, the left one of equals."""
        parts = list(marks)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may come after ``left`` (-1: start, or after a byte fallback)."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            names = [self.names[i] for i in (left, right) if i >= 0]
            known = self.pairs[key] = self.merged("".join(names)) == names
        return known

    def _arcs(self, marks: str, p: int) -> list[tuple[int, int]]:
        """``(end, piece)`` of the pieces that begin at ``p``, short ones first. A character
        without a piece has one arc, its byte fallback, named -1."""
        arcs, q, node, size = [], p, self.trie, len(marks)
        while q < size and (node := node.get(marks[q])) is not None:
            q += 1
            if (piece := node.get("")) is not None:
                arcs.append((q, piece))
        return arcs or [(p + 1, -1)]

    def _fallback(self, mark: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in mark.encode("utf-8", "surrogatepass")]

    def shortest_path(self, marks: str) -> list[int]:
        """Ids along the shortest path of the composition with one normalised string."""
        path = self._only_path(marks) if self.kind == BPE else self._cheapest_path(marks)
        ids: list[int] = []
        before = 0
        for p, piece in path:
            # Without byte fallback a run of unknown characters is one id.
            if piece >= 0:
                ids.append(piece)
            elif self.bytes or before >= 0:
                ids += self._fallback(marks[p])
            before = piece
        return ids

    def _only_path(self, marks: str) -> list[tuple[int, int]]:
        """The accepting path of a BPE model. There is one, so the first found is the
        shortest: depth first, long pieces first, states without a way on remembered."""
        size, dead, follows = len(marks), set(), self.pairs.get
        p, last, arcs = 0, -1, self._arcs(marks, 0)
        trail = []
        while True:
            while arcs:
                q, piece = arcs.pop()
                if piece >= 0:
                    known = follows(last << 20 | piece)
                    if not (self.follows(last, piece) if known is None else known):
                        continue
                if (q, piece) in dead:
                    continue
                trail.append((p, last, arcs, piece))
                if q == size:
                    return [(at, out) for at, _, _, out in trail]
                p, last, arcs = q, piece, self._arcs(marks, q)
            dead.add((p, last))
            p, last, arcs, _ = trail.pop()

    def _cheapest_path(self, marks: str) -> list[tuple[int, int]]:
        """The path of the highest score of a unigram model; states are positions in order, the
        path that is found first stays among equals. A character without a piece of its own has an
        arc of an unknown one."""
        size = len(marks)
        score: list = [np.float32(0)] + [None] * size
        back = [None] * (size + 1)
        for p in range(size):
            arcs = [(q, piece) for q, piece in self._arcs(marks, p) if piece >= 0]
            if not any(q == p + 1 for q, _ in arcs):
                arcs.append((p + 1, -1))
            for q, piece in arcs:
                total = score[p] + (self.unknown_score if piece < 0 else self.weights[piece])
                if score[q] is None or total > score[q]:
                    score[q], back[q] = total, (p, piece)
        path, at = [], size
        while at:
            path.append(back[at])
            at = back[at][0]
        return path[::-1]

    def _segments(self, marks: str) -> list[str]:
        """Parts of a normalised string whose paths are independent."""
        if not self.splits_words or self.kind != BPE:
            return [marks] if marks else []
        return _SEGMENT_LINES.findall(marks) if self.splits_lines else _SEGMENT.findall(marks)

    def _ids_of(self, part: str) -> bytes:
        """The ids of a part. Marks at its end continue the path of what stands before
        them if the two pieces that meet there may follow one another."""
        known = self.young.get(part) or self.old.get(part)
        if known is not None:
            return known
        root = part.rstrip(MARKS)
        if root and root != part and self.kind == BPE and len(part) <= MEMO_CHARS:
            before, after = self._ids_of(root), self._ids_of(part[len(root):])
            self.young[root] = before
            left, right = int.from_bytes(before[-4:], "little"), int.from_bytes(after[:4], "little")
            if BYTE not in (self.types[left], self.types[right]) and self.follows(left, right):
                return before + after
        return np.array(self.shortest_path(part), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        parts = self._segments(self.normalise(text))
        if len(self.young) >= MEMO_WORDS:
            self.old, self.young = self.young, {}
        young, long = self.young, []
        for part in set(parts):
            if part not in young:
                young[part] = self._ids_of(part)
                if len(part) > MEMO_CHARS:
                    long.append(part)
        out = b"".join(map(young.__getitem__, parts))
        for part in long:
            del young[part]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: pieces joined, byte runs decoded, the meta symbol a blank,
        the dummy prefix taken off; control pieces are silent, unknown ones ``⁇``."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


# A blank run with the word after it; a word after a line end has no blank.
_SEGMENT = re.compile(f"{META}*[^{META}]+|{META}+")
_SEGMENT_LINES = re.compile(f"{META}*[^{META}\n]+|{META}+|\n")


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducers:
    return Transducers(path)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every row; a null or empty text has no ids. Repeated
    rows and null ids are kept."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compiled(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [
                np.frombuffer(fst.encode(t), "<u4").astype(np.int32) for t in batch["text"]]}
                ).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")
                       ).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of every row; null ids are no ids."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compiled(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [
                fst.decode([] if ids is None else list(ids)) for ids in batch["ids"]]}
                ).astype({"doc_id": "Int64"})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")
                          ).mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip)`` of every row's whole text:
    its ids, and whether decoding them gives the text back (a meta symbol in a text comes
    back as a blank)."""
    import hashlib

    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fst = compiled(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = fst.encode(text)
                back = fst.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids),
                             hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                             back == text))
            out = pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "decoded_sha256", "round_trip"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_or_empty(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
