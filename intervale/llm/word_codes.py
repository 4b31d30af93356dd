"""Token ids of whole texts, each distinct word encoded once.

Byte-level merges never cross the pattern's matches, so a text's ids are the ids of its words in order; special
strings are cut out first, as the library does. Words are found, hashed and looked up for about GROUP characters of
texts at a time; long texts are cut into parts at words' starts, so memory hangs on GROUP and the longest word alone.
A word is known by 64 bits: a polynomial of its code points, or beyond LONG of them a digest of its bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from intervale.llm.flat import mix, powers
from intervale.llm.pretoken import parts, word_starts

#: Words kept between groups; beyond it the table starts anew.
KEPT_WORDS = 1 << 20
GROUP, LONG = 1 << 18, 64
_SLOT_BITS = 21
_U = np.uint64
#: Encodes words to all their ids in order and the number of ids of each.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + _U(0x6A09E667F3BCC909))


class Places:
    """A hash table of 64-bit keys (not 0) to row numbers, for arrays of keys; linear probing."""

    def __init__(self) -> None:
        self.keys, self.rows = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.rows[slot[hit]]
            going = ~hit & (held != 0)
            todo, slot = todo[going], (slot[going] + 1) & ((1 << _SLOT_BITS) - 1)
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Distinct unknown keys at rows from `first` on."""
        todo, slot = np.arange(len(keys)), (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            got = free & (self.keys[slot] == keys[todo])
            self.rows[slot[got]] = todo[got] + first
            todo, slot = todo[~got], (slot[~got] + 1) & ((1 << _SLOT_BITS) - 1)


class WordCodes:
    """Ids of texts; `special` maps special strings to their ids."""

    def __init__(self, encode: Encode, special: dict[str, int], kept: int = KEPT_WORDS, group: int = GROUP):
        self.encode, self.special, self.kept, self.group = encode, special, kept, group
        longest = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if special else None
        self._clear()

    def _clear(self) -> None:
        self.places, self.words = Places(), 0
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def _keep(self, keys: np.ndarray, words: list[str]) -> None:
        plain = [w not in self.special for w in words]
        ids, sizes = self.encode([w if p else "" for w, p in zip(words, plain, strict=True)])
        if not all(plain):
            at = np.flatnonzero(~np.array(plain))
            ids = np.insert(ids, (np.cumsum(sizes) - sizes)[at], [self.special[words[k]] for k in at])
            sizes[at] = 1
        last = self.words + len(words)
        while last > len(self.start) or self.used + len(ids) > len(self.ids):
            self.ids, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.start, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[self.words : last] = sizes
        self.start[self.words : last] = self.used + np.cumsum(sizes) - sizes
        self.places.add(keys, self.words)
        self.words, self.used = last, self.used + len(ids)

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Non-empty parts of a text, and whether each is a special string."""
        cut = self.cut(text) if self.cut and any(s in text for s in self.special) else [text]
        for k, part in enumerate(cut):
            if k % 2:
                yield part, True
            elif part:
                yield from ((p, False) for p in ([part] if len(part) <= self.group else parts(part, self.group)))

    def _codes(self, pieces: list[str], special: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces laid end to end, and where each piece's end."""
        if self.words > self.kept:
            self._clear()
        text = "".join(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        begins = word_starts(points, ends - sizes)
        for k in np.flatnonzero(special):
            begins[ends[k] - sizes[k] + 1 : ends[k]] = False
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_values()[points] * up[: len(points)], out=sums[1:])
        keys = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)) | _U(1)
        for k in np.flatnonzero(end - start > LONG):
            keys[k] = int.from_bytes(hashlib.blake2b(text[start[k] : end[k]].encode(), digest_size=8).digest(), "little") | 1
        rows = self.places.find(keys)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            new, at = np.unique(keys[unknown], return_index=True)
            at = unknown[at]
            first = self.words
            self._keep(new, [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            rows[unknown] = first + np.searchsorted(new, keys[unknown])
        count = self.size[rows].astype(np.int64)
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[rows] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.append(0, stop)[np.searchsorted(start, ends)]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Every text's ids as unsigned 32-bit integers, in order."""
        pieces: list[str] = []
        special: list[bool] = []
        owners: list[int] = []
        held: list[np.ndarray] = []
        done, size = 0, 0

        def solve(upto: int) -> Iterator[np.ndarray]:
            """Texts before `upto`, whose pieces are all there; ids of the text at `upto` are held."""
            nonlocal done, held, size
            ids, ends = self._codes(pieces, special) if pieces else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            bound = np.searchsorted(owners, np.arange(done, upto + 2))  # first piece of each text
            at = np.append(0, ends)[bound]
            for k in range(upto - done):
                mine = ids[at[k] : at[k + 1]]
                yield np.concatenate([*held, mine]) if held else mine
                held = []
            if at[-1] > at[-2]:
                held.append(ids[at[-2] : at[-1]])
            done, size = upto, 0
            pieces.clear(), special.clear(), owners.clear()

        for k, text in enumerate(texts):
            for piece, is_special in self._pieces(text):
                pieces.append(piece)
                special.append(is_special)
                owners.append(k)
                size += len(piece)
                if size >= self.group:
                    yield from solve(k)
        yield from solve(len(texts))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def library_encode(model) -> Encode:
    """Words by the library's own merges; each word's bytes as the symbols that its byte-level splitter hands on."""
    symbols = dict(enumerate(byte_symbols()))
    tokenize = model.tokenize

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        shown, ids, sizes, a = b"".join(raw).decode("latin-1").translate(symbols), [], [], 0
        for r in raw:
            b = a + len(r)
            got = [x.id for x in tokenize(shown[a:b])]
            ids += got
            sizes.append(len(got))
            a = b
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    return encode


@lru_cache(2)
def library_words(path: str) -> WordCodes:
    """Codes by the library for a byte-level .json tokenizer (others raise); one per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    spec = json.loads(t.to_str())
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    return WordCodes(library_encode(t.model), special)
