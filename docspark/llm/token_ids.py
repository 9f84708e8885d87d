"""Token ids of whole batches: each distinct white-space piece is encoded once, texts are gathered with numpy.

The tokenizer drops white space and never joins across it, so a text's ids are its pieces' ids end to end, and it
lower-cases, so A-Z may be folded first unless a special token's string could be in the text; tests hold this
against the tokenizer's own encoding of whole texts.
"""

from __future__ import annotations

import ctypes
import json
import os
from dataclasses import dataclass

import numpy as np

from docspark.llm.words import SPACED, SPACED_LOWER, words_of

#: Ends a document in a token stream.
END_OF_DOCUMENT = 1
#: Distinct pieces kept; past it the memory starts anew.
MEMORY = 520_000
#: Pieces in one string given to the tokenizer, and strings in one call.
GROUP, CALL = 64, 64
PLAIN_ENDS = (".", ",")
CLOSERS = "\"')]»”’"
SENTENCE_ENDS = (".", "!", "?", "…", "。")


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: other tasks' workers share the executor's limit."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class HashTable:
    """64-bit keys to numbers from 0, for whole arrays at a time: open addressing, linear probing."""

    def __init__(self, bits: int = 16):
        self.count = 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        slot = (keys & self.mask).astype(np.int64)
        held = self.keys[slot]
        hit = held == keys
        out[hit] = self.at[slot[hit]]
        rest = np.flatnonzero(~hit & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(self.mask)
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number new, distinct keys in their order."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            old, at = self.keys[self.keys != 0], self.at[self.keys != 0]
            self._alloc((2 * (self.count + len(keys)) - 1).bit_length())
            self._put(old, at)
        self._put(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.count += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = (keys & self.mask).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[rest[free]]
            done = self.keys[s] == keys[rest]
            self.at[s[done]] = numbers[rest[done]]
            rest = rest[~done]
            slot[rest] = (slot[rest] + 1) & int(self.mask)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def closing_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a full stop or comma ends a piece behind a Latin letter.

    The tokenizer parts letters from marks there too, so the piece's ids are those of its two parts, and far fewer distinct
    pieces remain. Letters are a-z and the two-byte ones from U+00C0 on; a combining mark is none.
    """
    last = data[ends - 1]
    marked = np.flatnonzero(((last == 46) | (last == 44)) & (ends - starts >= 2))
    at = ends[marked] - 1
    before = data[at - 1]
    second = (data[np.maximum(at - 2, 0)] == 0xC3) & (at - starts[marked] >= 2) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7)
    return at[_LETTER[before] | second]


@dataclass
class Encoded:
    """ids of all texts end to end; first: n + 1 offsets; breaks: offsets in ids after which a sentence or line ends."""

    ids: np.ndarray
    first: np.ndarray
    breaks: np.ndarray


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        """special_as_text: special tokens' strings in a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The same model without the steps that change nothing in a lower-case word of ASCII letters.
        plain = json.loads(self.tokenizer.to_str())
        plain["normalizer"], plain["added_tokens"] = None, []
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        del plain, vocabulary
        self._clear()
        give_back()

    def _clear(self) -> None:
        self.table = HashTable()
        self.flat = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ends = np.empty(0, bool)

    def _encode_grouped(self, tokenizer, pieces: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """ids and sizes of pieces that hold so many pre-tokens each; None if the ends of words don't tell."""
        ids = []
        for at in range(0, len(pieces), GROUP * CALL):
            own = pieces[at : at + GROUP * CALL]
            for e in tokenizer.encode_batch_fast([" ".join(own[i : i + GROUP]) for i in range(0, len(own), GROUP)], add_special_tokens=False):
                ids += e.ids
        ids = np.array(ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != words.sum():
            return None
        return ids, np.diff(ends[np.cumsum(words) - 1], prepend=0)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        # A piece of letters is one pre-token, one with a full stop or comma behind it two: many go in one string.
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        words = np.ones(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            core = p
            if p[-1:] in PLAIN_ENDS:
                core, words[i] = p[:-1], 2
            kinds[(0 if core.isascii() and core.islower() else 1) if core.isalpha() else 2].append(i)
        order, ids, sizes = [], [], []
        for own, tokenizer in zip(kinds[:2], (self.plain, self.tokenizer), strict=True):
            if not own:
                continue
            spaced = [p if n == 1 else f"{p[:-1]} {p[-1]}" for p, n in ((pieces[i], words[i]) for i in own)]
            found = self._encode_grouped(tokenizer, spaced, words[own])
            if found is None:
                kinds[2].extend(own)
            else:
                order += own
                ids.append(found[0])
                sizes.append(found[1])
        for at in range(0, len(kinds[2]), 2048):
            own = kinds[2][at : at + 2048]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([pieces[i] for i in own], add_special_tokens=False)]
            order += own
            ids += found
            sizes.append(np.array([len(x) for x in found], np.int64))
        size = np.concatenate(sizes)
        self.table.add(keys[order])
        self.start = np.concatenate([self.start, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, *ids])
        closed = [pieces[i].rstrip(CLOSERS).endswith(SENTENCE_ENDS) for i in order]
        self.ends = np.concatenate([self.ends, np.array(closed, bool)])

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int | None = END_OF_DOCUMENT) -> Encoded:
        """data, bounds: as words_of takes them. end: this id closes every text; None: nothing does."""
        raw = data.tobytes()
        special = b"<|" in raw
        words = words_of(data, bounds, SPACED if special else SPACED_LOWER, closing_marks)
        keys = np.where(words.hashes == 0, np.uint64(1), words.hashes)
        if self.table.count > MEMORY:
            self._clear()
            give_back()
        which = self.table.find(keys)
        lost = np.flatnonzero(which < 0)
        if len(lost):
            new, one = np.unique(keys[lost], return_index=True)
            one = lost[one]
            pieces = [raw[a:b] for a, b in zip(words.starts[one].tolist(), words.ends[one].tolist(), strict=True)]
            self._learn(new, [(p if special else p.lower()).decode("utf-8", "replace") for p in pieces])
            which[lost] = self.table.find(keys[lost])
        sizes = self.size[which].astype(np.int64)
        upto = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[which] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)]
        first = np.concatenate([[0], upto])[words.first]
        closed = self.ends[which]
        inner = words.ends < len(data)
        closed[inner] |= data[words.ends[inner]] == 10
        breaks = np.unique(upto[closed])
        if end is None:
            return Encoded(ids, first, breaks)
        text_of = np.searchsorted(first[1:], breaks, "left")
        ids = np.insert(ids, first[1:], end).astype(np.uint32)
        return Encoded(ids, first + np.arange(len(first)), breaks + text_of)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker process, file and mode."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]
