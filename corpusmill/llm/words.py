"""Vectorised word hashing over Arrow batches of texts.

Every operator that looks at words turns a whole batch of texts into one
``uint64`` array of word hashes plus document offsets. A word is a maximal run
of bytes outside a separator set; A-Z are folded to a-z first. UTF-8 makes
byte-wise separators exact as long as they are ASCII, which all of ours are.

Word hashes are 64-bit: a random table value per byte, summed with powers of an
odd base modulo 2**64, then finalised together with the length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once; bounds the temporary arrays of a task to some 40 MB.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240517)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM_GAP = np.zeros(256, dtype=bool)
ALNUM_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche, element-wise over ``uint64``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, PIECE + 64)
        for k, b in enumerate((_BASE, _INV)):
            steps = np.full(size, b, dtype=U)
            steps[0] = 1
            _pow[k] = np.cumprod(steps, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def _hash_piece(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    pw, inv = _powers(len(a))
    total = np.zeros(len(a) + 1, dtype=U)
    np.cumsum(_TABLE[a] * pw, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def spans(buf: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``buf``, which must end in a separator."""
    gap = gaps[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def hash_words(texts: Iterable[bytes], gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and per text the end of its words.

    ``hashes[offsets[i]:offsets[i + 1]]`` are the words of text ``i``.
    """
    return hash_words_and_ends(texts, gaps, 0)[:2]


def hash_words_and_ends(texts: Iterable[bytes], gaps: np.ndarray = WHITE, last: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hash_words`, and a number made of the ``last`` bytes of each word."""
    texts = list(texts)
    raw = b"\n".join(texts) + b"\n"
    buf = LOWER[np.frombuffer(raw, dtype=np.uint8)]
    starts, ends = spans(buf, gaps)
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        out[i:j] = _hash_piece(buf[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate(([0], np.searchsorted(starts, bounds))).astype(np.int64)
    tails = np.zeros(len(starts), dtype=np.int64)
    for j in range(last):
        at = ends - 1 - j
        tails = tails * 256 + np.where(at >= starts, buf[np.maximum(at, 0)], 0)
    return out, offsets, tails


_STEP = [U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F), U(0xEB44ACCAB455D165)]


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` consecutive entries; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    acc = np.zeros(n, dtype=U)
    for j in range(k):
        acc += h[j : j + n] * _STEP[j % len(_STEP)] + U(j + 1)
    return mix(acc)


def shingle_sets(texts: Iterable[bytes], k: int, gaps: np.ndarray = WHITE) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has one shingle, its whole word sequence (its length
    goes into the hash); a text without words has none.
    """
    h, off = hash_words(texts, gaps)
    windows = combine(h, k)
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(windows[lo : hi - k + 1])
        elif hi > lo:
            yield combine(h[lo:hi], hi - lo) ^ U(hi - lo)
        else:
            yield np.zeros(0, dtype=U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches(texts: Iterable[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive groups of texts of about ``limit`` bytes, with the first one's index."""
    group: list[bytes] = []
    size = start = i = 0
    for i, t in enumerate(texts):
        t = t or b""
        if group and size + len(t) > limit:
            yield start, group
            group, size, start = [], 0, i
        group.append(t)
        size += len(t) + 1
    if group:
        yield start, group
