"""Token ids of whole texts by a public tokenizer, for use inside Spark tasks.

The word tokenizer drops white space and never looks across it, so the ids of a
text are the ids of its space-separated chunks in a row. Arrow cuts a group of
texts into chunks and numbers the different ones; each is encoded once per group.

Chunks of plain characters (nearly all) are lowered and marked at their words' ends
in one pass, and the byte-pair merges of all of them run in one call: the vocabulary
is read as byte ranks in which a word's last byte and the mark merge before all else.
Other chunks go to the tokenizers library, and so does every text when the
vocabulary is not of this kind.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerframe.llm.common import given_back

#: Characters of the texts that are cut and looked up together (a longer text alone).
GROUP_CHARS = 8_000_000
#: A character that stands alone between two chunks for the library; chunks that hold
#: it go to the library one by one.
SEPARATOR = "\x01"
#: Chunks that go to the library in one call.
WORDS_TOGETHER = 256
#: Ends of words and of chunks in the marked text; no plain character.
WORD_END, CHUNK_END = "\x01", "\x02"
#: Characters that composing leaves alone, that lower case one by one, and whose class
#: (letter, digit, sign, white space) Python and the tokenizer see alike.
PLAIN = ("[\\t\\r\\n\\x20-\\x7e\\x{c0}-\\x{24f}\\x{400}-\\x{482}\\x{48a}-\\x{4ff}"
         "\\x{2010}-\\x{2027}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{4e00}-\\x{9fa5}\\x{ac00}-\\x{d7a3}]*")
#: Special tokens are found in texts with this mark.
SPECIAL = "<|"
#: Fixed value: the tokenizer's own split of words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split on plain characters.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s\x02]|_)+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where
    it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def byte_ranks(vocabulary: dict, mark: bytes = b"") -> tuple[dict[bytes, int], np.ndarray] | None:
    """``(ranks of byte strings, id of each rank)`` of a byte-level BPE vocabulary file.

    With an end-of-word suffix, ``mark`` stands for it and the pairs of a byte and
    the mark rank before all merges. None if the file is of another kind."""
    model = vocabulary["model"]
    suffix = model.get("end_of_word_suffix") or ""
    if (model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges")
            or model.get("continuing_subword_prefix") or bool(suffix) != bool(mark)):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    byte_of = {letter: bytes([b]) for b, letter in enumerate(letters)}

    def raw(token: str) -> bytes:
        end = mark if suffix and token.endswith(suffix) else b""
        return b"".join([byte_of[c] for c in token.removesuffix(suffix if end else "")]) + end

    tokens = [*letters, *[letter + suffix for letter in letters * bool(suffix)]]
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        tokens.append(a + b)
    try:
        ranks = {raw(t): k for k, t in enumerate(tokens)}
        ids = np.array([vocab[t] for t in tokens], "<u4")
    except KeyError:
        return None
    return (ranks, ids) if len(ranks) == len(tokens) else None


class TokenIds:
    """``ids(text)``: the text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.mark = self._encode(SEPARATOR)
        words = self._encode("a b"), self._encode("a"), self._encode("b")
        self.splits = (len(self.mark) == 1 and words[0] == words[1] + words[2]
                       and self._encode(f"a {SEPARATOR} b") == words[1] + self.mark + words[2])
        self.merges = self.id_of_rank = None
        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        found = byte_ranks(whole, WORD_END.encode())
        if self.splits and found and SPLIT in json.dumps(whole["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\"):
            import tiktoken

            ranks, self.id_of_rank = found
            self.chunk_end = ranks[(CHUNK_END + WORD_END).encode()]
            self.merges = tiktoken.Encoding(
                "words", pat_str=f"[^{WORD_END}{CHUNK_END}\\s]+{WORD_END}|{CHUNK_END}{WORD_END}",
                mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain chunks in a row, and how many each has."""
        if not chunks:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        marked = WORD.sub(rf"\g<0>{WORD_END}", CHUNK_END.join(chunks).lower())
        ranks = np.array(self.merges.encode_ordinary(
            marked.replace(CHUNK_END, CHUNK_END + WORD_END)), np.int64)
        cuts = np.flatnonzero(ranks == self.chunk_end)
        ends = np.append(cuts - np.arange(len(cuts)), len(ranks) - len(cuts))
        return self.id_of_rank[np.delete(ranks, cuts)], np.diff(ends, prepend=0)

    def _other(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk by the library."""
        out: dict[str, np.ndarray] = {}
        whole = [c for c in chunks if SEPARATOR in c]
        out.update((c, np.array(self._encode(c), "<u4")) for c in whole)
        rest = [c for c in chunks if SEPARATOR not in c]
        for at in range(0, len(rest), WORDS_TOGETHER):
            some = rest[at:at + WORDS_TOGETHER]
            ids = np.array(self._encode(f" {SEPARATOR} ".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            out.update(zip(some, [ids[a:b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)])],
                           strict=True))
        return [out[c] for c in chunks]

    def ids(self, text: str) -> bytes:
        return self._group([text])[0].tobytes()

    def ids_of(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``ids`` of each text."""
        for flat, ends in self.groups(texts):
            whole, at = flat.tobytes(), 0
            for end in (4 * ends).tolist():
                yield whole[at:end]
                at = end

    def groups(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of groups of texts of bounded size: all in a row, and each text's end."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                yield self._group(group)
                group, size = [], 0
        if group:
            yield self._group(group)
        group = None
        given_back()

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.splits:
            each = [np.array(self._encode(t), "<u4") for t in texts]
            return np.concatenate(each), np.cumsum([len(e) for e in each])
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        places = cut.flatten().dictionary_encode()
        # Each different chunk of the group once.
        chunks = places.dictionary
        plain = pc.match_substring_regex(chunks, f"^{PLAIN}$") if self.merges else None
        if plain is None:
            easy = np.zeros(len(chunks), bool)
        else:
            special = pc.match_substring(chunks, SPECIAL)
            easy = pc.and_not(plain, special).to_numpy(zero_copy_only=False)
        flat, sizes = self._plain(chunks.filter(pa.array(easy)).to_pylist())
        hard = self._other(chunks.filter(pa.array(~easy)).to_pylist())
        # Plain chunks first, then the others; a chunk's place among them.
        place = np.empty(len(chunks), np.int64)
        place[np.flatnonzero(easy)] = np.arange(len(sizes))
        place[np.flatnonzero(~easy)] = np.arange(len(sizes), len(chunks))
        flat = np.concatenate([flat, *hard])
        ends = np.cumsum(np.concatenate([[0], sizes, [len(h) for h in hard]]).astype(np.int64))
        indices = place[places.indices.to_numpy(zero_copy_only=False)]
        ids = pa.LargeListArray.from_arrays(ends, flat).take(pa.array(indices))
        return (ids.flatten().to_numpy(zero_copy_only=False),
                ids.offsets.to_numpy()[cut.offsets.to_numpy()[1:]])


def closed(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's ids with ``end_id`` after each text, and the new ends."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(flat) + len(ends), "<u4")
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own], out[ends - 1] = flat, end_id
    return out, ends


@lru_cache(maxsize=2)
def token_ids(vocabulary: str) -> TokenIds:
    """One tokenizer per worker process."""
    return TokenIds(vocabulary)
