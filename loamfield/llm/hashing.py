"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes outside space and 0x09-0x0D, which is also how
``bytes.split()`` cuts.  A word's 64-bit hash is a polynomial in its bytes modulo 2**64,
taken from prefix sums, so that a whole batch of texts costs a few passes of numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F | 1
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in a new array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values(fold_case: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
    if fold_case:
        v[65:91] = v[97:123]
    v[SPACE] = 0
    return v


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_powers: dict[int, np.ndarray] = {}
#: Powers of a base that a worker keeps, at most; those for longer texts are made anew.
MOST_KEPT = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= MOST_KEPT:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    _, offsets = byte_view(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first byte of every word, and the len+1 word offsets of the texts."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_VALUES[fold_case][raw] * powers(_STEP, len(raw)), out=total[1:])
    bounds = total[np.append(starts, len(raw))]
    h = (bounds[1:] - bounds[:-1]) * powers(inverse(_STEP), len(raw))[starts]
    return mix(h), starts, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, ends of texts not regarded; empty with fewer than k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 8:
        out = np.zeros(n, U64)
        for j, p in enumerate(powers(_BASE, k)):
            out += words[j : j + n] * p
    else:
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers(_BASE, len(words)), out=total[1:])
        out = (total[k:] - total[:n]) * powers(inverse(_BASE), n)
    return mix(out + U64(k))


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes, A-Z lower-cased; with fewer words the whole sequence as one."""
    raw, offsets = byte_view(texts)
    words, _, at = word_hashes(raw, offsets, True)
    grams = gram_hashes(words, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            yield gram_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, U64)
