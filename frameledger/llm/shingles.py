"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of a batch.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; A-Z count as a-z. In UTF-8 these bytes never occur inside another character, so working on
bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[list(_SPACES)] = True
_U = np.uint64
CHUNK_BYTES = 1 << 18


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on the seed alone."""
    return splitmix(np.arange(n, dtype=np.uint64) + _U(seed * 1_000_003)) | _U(1)


_BYTE = splitmix(np.arange(256, dtype=np.uint64) + _U(77))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = _U(0x9D39247E33776D41)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        for_base = np.full(size, _BASE, dtype=np.uint64)
        for_base[0] = 1
        for_inverse = np.full(size, _INVERSE, dtype=np.uint64)
        for_inverse[0] = 1
        powers, inverses = np.multiply.accumulate(for_base), np.multiply.accumulate(for_inverse)
        if size > 4 * CHUNK_BYTES:
            return powers, inverses
        _POWERS, _INVERSES = powers, inverses
    return _POWERS, _INVERSES


def _hash_block(block: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a block that cuts no word."""
    word = ~white[block]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    powers, inverses = _powers(len(block) + 1)
    sums = np.zeros(len(block) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[block] * powers[: len(block)], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * inverses[starts]), starts


def word_hashes(buffer: bytes, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a buffer of any length, in bounded blocks.

    ``white`` marks the bytes that stand between words.
    """
    data = np.frombuffer(buffer, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data) and not white[data[end]]:
            gaps = np.flatnonzero(white[data[end : end + CHUNK_BYTES]])
            end = end + int(gaps[0]) if len(gaps) else min(end + CHUNK_BYTES, len(data))
        h, s = _hash_block(data[at:end], white)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def batches(texts: list[bytes | None]) -> Iterator[tuple[list[int], bytes, np.ndarray]]:
    """Group texts into buffers of bounded size: their numbers, the joined bytes, each one's first byte."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if rows and size + len(t) > CHUNK_BYTES:
            yield rows, b"\n".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(t)
        size += len(t) + 1
    if rows:
        yield rows, b"\n".join(parts), np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, repeats included; the whole run if there are fewer words."""
    if not len(words):
        return words
    factors = constants(11, width)
    if len(words) < width:
        return splitmix(np.array([(words * factors[: len(words)]).sum(dtype=np.uint64) + _U(len(words))], dtype=np.uint64))
    n = len(words) - width + 1
    total = words[:n] * factors[0]
    for k in range(1, width):
        total += words[k : k + n] * factors[k]
    return splitmix(total)


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The set of each text as a sorted array of hashes, in the texts' order."""
    for rows, buffer, firsts in batches(texts):
        hashes, starts = word_hashes(buffer)
        cuts = np.searchsorted(starts, np.append(firsts, len(buffer) + 1))
        for k in range(len(rows)):
            yield np.unique(shingle_hashes(hashes[cuts[k] : cuts[k + 1]], width))
