"""Hashes of words and of windows of consecutive words, for whole batches of texts at once.

A word's hash is a polynomial with odd base over random values of its bytes, modulo 2**64; a window's hash
is another one over the hashes of its words. Both come from one prefix sum, so that the work is linear in the
text whatever the length of windows.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE[:, WHITE] = 0
#: Odd bases of the polynomials over bytes and over words, two independent ones of each.
BASES = _rng.integers(1, 2**62, (2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time; a longer run without white space is hashed whole.
CHUNK = 1 << 21

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and their inverses."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        up = np.full(size, np.uint64(base))
        down = np.full(size, np.uint64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Where to cut ``data`` into chunks: at starts of rows or just after white space."""
    cuts = [0]
    while cuts[-1] < len(data):
        at = cuts[-1] + CHUNK
        if at >= len(data):
            cuts.append(len(data))
            continue
        k = int(np.searchsorted(offsets, at, "right")) - 1
        if offsets[k] > cuts[-1]:
            cuts.append(int(offsets[k]))
            continue
        stop = int(offsets[k + 1])
        while at < stop:
            white = np.flatnonzero(WHITE[data[at : at + CHUNK]])
            if len(white):
                at += int(white[0]) + 1
                break
            at += CHUNK
        cuts.append(min(at, stop))
    return cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of UTF-8 bytes with the offsets of their rows (from 0): each word's hash, and the number of words before
    each row and after the last. Words are the maximal runs of bytes other than the six white ones."""
    hashes, begins = [], []
    cuts = _cuts(data, offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        ink = ~WHITE[part]
        up, down = powers(int(BASES[0, kind]), b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE[kind][part] * up[: b - a], out=total[1:])
        before = np.concatenate(([False], ink[:-1])) & ~edge[a:b]
        after = np.concatenate((ink[1:], [False])) & ~edge[a + 1 : b + 1]
        start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        hashes.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        begins.append(start + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets, "left")


def window_sums(words: np.ndarray, kind: int = 0) -> np.ndarray:
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(int(BASES[1, kind]), max(1, len(words)))[0][: len(words)], out=total[1:])
    return total


def window_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """The hash of the words from ``start`` up to ``end``, places in the words that ``sums`` was made of."""
    down = powers(int(BASES[1, kind]), len(sums))[1]
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
