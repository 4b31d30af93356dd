"""Texts of an Arrow column as one flat byte array, with word and shingle hashes of all of them at once.

Words are runs of bytes other than space and 0x09-0x0D; hashes are 64-bit polynomials over the bytes,
A-Z lower-cased, with a finalising mix. All functions work on pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
SHINGLE = 5
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BASE = _U(int(_rng.integers(1 << 62)) * 2 + 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_STEP = [_U(int(x) | 1) for x in _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> list[np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + (1 << 16))
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and n + 1 offsets; null strings are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(flat: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `size` bytes; a longer row is a piece alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 values)."""
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = _IN_WORD[flat]
    change = inside[1:] != inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(flat))]
    cut = np.unique(bounds[inside[bounds] & inside[bounds + 1]])
    edges = np.flatnonzero(change)
    starts, ends = edges[::2], edges[1::2]
    if len(cut):  # words of two rows that touch
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_VALUE[flat] * up[: len(flat)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's windows of five words, repeats included, and n + 1 offsets.

    A row of one to four words has one shingle, the whole sequence; a row without words has none.
    """
    starts, ends, first = word_spans(flat, offsets)
    words = word_hashes(flat, starts, ends)
    count = np.diff(first)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(count.dtype))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], n) + np.arange(out[-1])
    got = np.zeros(len(at), np.uint64)
    length = np.minimum(np.repeat(count, n), SHINGLE)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        got += np.where(length > k, padded[at + k] * _STEP[k], _U(0))
    return mix(got + length.astype(np.uint64)), out


def long_shingles(row: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """The same of one long row, by pieces that end with a word and begin with the last four of the piece before.

    A piece is longer only where a word is, or where it has fewer than five.
    """
    n, a, size = len(row), 0, piece
    while a < n:
        b = a + size
        while b < n and not (gaps := np.flatnonzero(~_IN_WORD[row[b : b + piece]])).size:
            b += piece
        b = min(n, b + int(gaps[0])) if b < n else n
        part, at = row[a:b], np.array([0, b - a])
        starts, _, _ = word_spans(part, at)
        if len(starts) < SHINGLE:
            if b == n:
                if a == 0:
                    yield shingles(part, at)[0]
                return
            size = b - a + piece
            continue
        yield shingles(part, at)[0]
        a, size = a + int(starts[1 - SHINGLE]), piece
        if b == n:
            return


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    flat, offsets = texts_of(column)
    for i, j, part, at in pieces(flat, offsets):
        if len(part) > 2 * PIECE:  # one long row
            yield np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, long_shingles(part))]))
            continue
        got, out = shingles(part, at)
        for k in range(j - i):
            yield np.unique(got[out[k] : out[k + 1]])
