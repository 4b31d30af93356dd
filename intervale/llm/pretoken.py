"""Token starts of the byte-level tokenizer's pattern, for many texts at once.

The pattern scans from left to right, and whether a word starts at a character hangs on the characters around it only:
on the classes (letter, number, white space, other) before and after it and on contractions. So the starts of all
words of a long run of texts come from a few array operations, and a text may be cut where white space follows anything else.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

# Code points that the `regex` module (Unicode 17) takes for letters or numbers and the
# tokenizers library's matcher does not; found by comparing both over every code point.
NOT_YET_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LETTER, NUMBER, OTHER, WHITE = range(4)
_newer = [[int(x, 16) for x in (r.split("-") * 2)[:2]] for r in NOT_YET_LETTERS.split()]
_cut = regex.compile(r"(?<=\S)\s").search


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    for low, high in _newer:
        out[low : high + 1] = OTHER
    return out


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point; `firsts` are the starts of the texts laid end to end in `points` (none of them empty)."""
    n, kind = len(points), classes()[points]
    first = np.zeros(n + 3, bool)
    first[firsts] = first[n:] = True
    white, same = kind == WHITE, ~first[1:n]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    into = white[:-1] & ~white[1:] & same  # the last white space before something else
    start[1:][into & (points[:-1] == 32)] = False  # a blank joins what follows
    start[:-1] |= into
    marks = np.flatnonzero((points == 39) & start)
    if len(marks):  # contractions: 's 't 'm 'd 're 've 'll
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        near = ~first[marks + 1]
        short = near & np.isin(one, [115, 116, 109, 100])
        long = near & ~first[marks + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        start[marks[short | long] + 1] = False
        after = np.concatenate([marks[short] + 2, marks[long] + 3])
        start[after[after < n]] = True
    return start


def split(text: str) -> list[str]:
    """The pattern's matches in order, by the `regex` module: together they are the whole text."""
    plain = text.translate(dict.fromkeys((x for low, high in _newer for x in range(low, high + 1)), "\ue000"))
    return [text[m.start() : m.end()] for m in regex.finditer(public_tokenizers.PATTERN, plain)]


def parts(text: str, size: int) -> list[str]:
    """`text` cut into parts of `size` characters or somewhat more, each at a word's start whatever stands around it."""
    out, at = [], 0
    while len(text) - at > size and (m := _cut(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]
