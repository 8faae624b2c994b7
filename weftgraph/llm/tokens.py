"""Vectorised word and shingle hashing over UTF-8 bytes.

A batch of texts is one byte buffer. Words get 64-bit polynomial hashes from prefix
sums, so no Python object is made for a word; every step is a numpy pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SHINGLE = 5
#: Bytes of text that are hashed at a time; bounds the memory of the per-byte arrays.
CHUNK = 1 << 20

_BASE = U(0x9E3779B97F4A7C13)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240517)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LANES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def lut(separators: bytes, lower: bool) -> np.ndarray:
    """A byte map: 0 for separators, else the byte, A-Z as a-z if ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Words `[^\x20\x09-\x0D]+` with A-Z lower-cased. (A NUL byte is part of a word: it maps to 255, which UTF-8 never has.)
WORDS_LOWER = lut(BLANKS, True)
WORDS_LOWER[0] = 255
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z lower-cased.
LETTERS_LOWER = lut(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up, down = np.full(size, _BASE, U), np.full(size, _BASE_INVERSE, U)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _hashed(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, ...]:
    """The joined bytes, where words start and end in them, prefix sums and their scale, and where each text's words begin."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    mapped = table[buffer]
    inside = np.concatenate(([False], mapped != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(buffer))
    sums = np.empty(len(buffer) + 1, U)
    sums[0] = 0
    np.cumsum(_TABLE[mapped] * up, out=sums[1:])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buffer, starts, ends, sums, down, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and, for each text, where its words begin (one entry more than texts)."""
    _, starts, ends, sums, down, bounds = _hashed(texts, table)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _LANES[15]), bounds


def beginning_hashes(texts: list[bytes], table: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width the hashes of the words' first ``width`` letters; 0 for words that aren't longer."""
    buffer, starts, ends, sums, down, _ = _hashed(texts, table)
    letters = np.flatnonzero((buffer & 0xC0) != 0x80)
    nth = np.searchsorted(letters, starts)
    out = []
    for width in widths:
        at = letters[np.minimum(nth + width, len(letters) - 1)]
        out.append(np.where(at < ends, mix((sums[at] - sums[starts]) * down[starts] + np.full(1, width, U) * _LANES[14]), U(0)))
    return out


def shingle_sets(texts: list[bytes], table: np.ndarray = WORDS_LOWER, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, bounds = word_hashes(texts, table)
    whole = max(0, len(words) - width + 1)
    rolled = np.zeros(whole, U)
    for j in range(width):
        rolled += words[j : j + whole] * _LANES[j]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            yield mix((words[a:b] * _LANES[: b - a]).sum(dtype=U, keepdims=True) + _LANES[9 + b - a : 10 + b - a])
        else:
            yield words[:0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a string column as byte strings (null: empty), of about ``limit`` bytes each."""
    held: list[bytes] = []
    size = first = 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        if held and size + len(text) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held
