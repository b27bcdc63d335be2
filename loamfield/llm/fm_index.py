"""A word-level FM-index in numpy: a wavelet matrix over the Burrows-Wheeler transform.

The index answers for patterns of up to ``depth`` words: suffixes are sorted by their first
``depth`` words only, which is all that backward search of such patterns relies on.  Many
patterns are searched in step, so that each step is a few array operations.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes of a sequence of small ints, one bit a symbol and level, with a rank sample every 64 bits.

    A plane keeps each different run of 64 bits once, and for every run the 32-bit number of
    its like: what the transform of repetitive texts makes uniform, or repeats, takes half of
    its bits.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(symbols), bits, []
        x = symbols
        for level in range(bits - 1, -1, -1):
            ones = ((x >> level) & 1).astype(bool)
            packed = np.zeros((self.n >> 6) * 8 + 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            kept, slot = np.unique(words, return_inverse=True)
            self.levels.append((kept, slot.astype(np.int32), before, self.n - int(before[-1])))
            x = np.concatenate([x[~ones], x[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position; ``start`` as origin() gives it."""
        p = at
        for level, (kept, slot, before, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level)) & 1
            w = p >> 6
            r = before[w] + np.bitwise_count(kept[slot[w]] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
            p = np.where(one, zeros + r, p - r)
        return p - start

    def origin(self, symbols: np.ndarray) -> np.ndarray:
        """Where the run of each symbol starts on the lowest level."""
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b)."""
    key = (a.astype(np.int64) << 32) | b
    order = np.argsort(key, kind="stable")
    k = key[order]
    rank = np.zeros(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    return rank


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    """x shifted by so many words; 0 beyond the end."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


class FMIndex:
    """Index of texts given as one array of word codes, and their lengths.

    ``owner`` is a number for each text; searches report the smallest owner among the
    occurrences of a pattern of ``depth`` words.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int):
        if depth < 2:
            raise ValueError("depth is 2 or more")
        self.depth, self.lengths = depth, lengths
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        is_end = np.zeros(len(words) + len(lengths), bool)
        is_end[ends] = True
        alphabet, codes = np.unique(words, return_inverse=True)
        text = np.zeros(len(is_end), np.int64)
        text[~is_end] = codes + 1
        self.text, n = text, len(text)
        names, size = text, 1
        while size * 2 < depth:
            names = _names(names, _ahead(names, size))
            size *= 2
        shorter = names if depth - 1 == size else _names(names, _ahead(names, depth - 1 - size))
        order = np.argsort(_names(names, _ahead(names, depth - size)), kind="stable")
        del names
        self.tree = WaveletMatrix(text[order - 1], max(1, int(len(alphabet)).bit_length()))
        counts = np.bincount(text, minlength=len(alphabet) + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.origin = self.tree.origin(np.arange(len(alphabet) + 1))
        # The rows that agree in depth - 1 words, to which a match of depth words is cut back; and each row's owner.
        self.block_start, self.block_end = _blocks(shorter[order])
        self.owners = np.append(np.repeat(owner, lengths + 1)[order], np.iinfo(np.int64).max)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner of the rows of each interval [lo, hi); intervals are the same or apart."""
        start, of = np.unique(lo, return_inverse=True)
        end = np.zeros(len(start), np.int64)
        end[of] = hi
        return np.minimum.reduceat(self.owners, np.column_stack([start, end]).ravel())[::2][of]

    def matches(self) -> np.ndarray:
        """Smallest owner of each window of ``depth`` words of the indexed texts, by place in the text; -1 where no window starts.

        The texts are streamed through the index from their ends, all in step.  The pattern
        grows by a word to the left, which narrows its interval of rows; once ``depth`` words
        are matched the smallest owner in the interval is the statistic, and the pattern is cut
        back to ``depth - 1`` words, the enclosing interval.
        """
        out = np.full(len(self.text), -1, np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        lengths, at = self.lengths[order], (self.starts + self.lengths)[order] - 1
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), len(self.text), np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -step, "left"))
            lo, hi, at = lo[:live], hi[:live], at[:live]
            c = self.text[at]
            base = self.origin[c]
            ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]), np.concatenate([base, base]))
            lo, hi = self.smaller[c] + ranks[:live], self.smaller[c] + ranks[live:]
            if step + 1 >= self.depth:
                out[at] = self.least(lo, hi)
                lo, hi = self.block_start[lo], self.block_end[lo]
            at = at - 1
        return out


def _blocks(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the run of equal names that each row lies in."""
    heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(names))
    size = ends - heads
    return np.repeat(heads, size).astype(np.int32), np.repeat(ends, size).astype(np.int32)
