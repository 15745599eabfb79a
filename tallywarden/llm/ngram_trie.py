"""Compact n-gram levels for numpy: Elias-Fano sequences and quantised probabilities in one memory map.

Everything here works on whole arrays of queries at a time, inside a task.
"""

from __future__ import annotations

import mmap

import numpy as np

# Steps of a power of ten that a stored probability is rounded down to. 16 bits reach down to 10^-32.
STEPS = 2048
# Share of a count that is set aside for words not seen in a context.
DISCOUNT = 0.5

_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
_PLACE = np.array([[*[b for b in range(8) if i >> b & 1], *[0] * 8][:8] for i in range(256)], dtype=np.int64)


def quantised(probability: np.ndarray) -> np.ndarray:
    """Steps below one, rounded so that no probability is put up."""
    return np.ceil(-np.log10(probability) * STEPS).astype(np.int64)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The same arrays as views of one anonymous memory map, each at a multiple of 8 bytes."""
    starts = np.cumsum([0, *(-(-a.nbytes // 8) * 8 for a in arrays)])
    space = mmap.mmap(-1, max(int(starts[-1]), 8))
    views = []
    for at, a in zip(starts, arrays, strict=False):
        view = np.frombuffer(space, dtype=a.dtype, count=a.size, offset=int(at))
        view[:] = a
        views.append(view)
    return views


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as bytes, with eight spare bytes to read beyond the end."""
    body = np.packbits(bits, bitorder="little")
    return np.concatenate([body, np.zeros(16 - body.size % 8, np.uint8)])


class EliasFano:
    """Numbers in ascending order, at about 2 + log2(universe / n) bits each."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = int(values.size)
        # Eight bytes are read at a time, at any bit.
        self.width = min(56, max(0, (max(universe, 1) // max(self.n, 1)).bit_length() - 1))
        low = values & ((1 << self.width) - 1)
        lows = np.empty((self.n, self.width), np.uint8)
        for k in range(self.width):
            lows[:, k] = (low >> k) & 1
        marks = np.zeros(self.n + (universe >> self.width) + 2, np.uint8)
        marks[(values >> self.width) + np.arange(self.n)] = 1
        self.parts = [_packed(lows.ravel()), _packed(marks), np.zeros(0, np.int64)]
        ones = _ONES.astype(np.uint8)[self.parts[1].reshape(-1, 8)].sum(1, dtype=np.int64)
        self.parts[2] = np.concatenate([[0], np.cumsum(ones)])

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros_like(i)
        at = i * self.width
        out = np.zeros(i.shape, np.uint64)
        first = at >> 3
        for k in range(-(-(self.width + 7) // 8)):
            out |= self.parts[0][first + k].astype(np.uint64) << np.uint64(8 * k)
        value = out >> (at & 7).astype(np.uint64)
        return (value & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the i-th set bit, or of the i-th clear one."""
        before = self.parts[2] if ones else np.arange(self.parts[2].size, dtype=np.int64) * 64 - self.parts[2]
        word = np.searchsorted(before, i, side="right") - 1
        left = i - before[word]
        byte = word * 8
        bytes_ = self.parts[1] if ones else ~self.parts[1]
        for _ in range(7):
            here = _ONES[bytes_[byte]]
            further = left >= here
            left = left - np.where(further, here, 0)
            byte = byte + further
        # A byte that was not passed stays, for what is left is below its count.
        return byte * 8 + _PLACE[bytes_[byte], left]

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.width) | self.low(i)

    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the first number from x up among those from ``start`` to before ``end``, or ``end``."""
        high, low = x >> self.width, x & ((1 << self.width) - 1)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        hi = self._select(high, False) - high
        lo, hi = np.clip(lo, start, end), np.clip(hi, start, end)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.low(np.where(open_, mid, 0)) < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


class Level:
    """Children of the contexts 0 .. n-1: monotone pointers to each context's range, and ids made monotone
    by the context, searched within the range."""

    def __init__(self, context: np.ndarray, child: np.ndarray, contexts: int, words: int):
        self.words = words
        starts = np.searchsorted(context, np.arange(contexts + 1))
        self.ids = EliasFano(context.astype(np.int64) * words + child, max(contexts, 1) * words)
        self.pointers = EliasFano(starts, int(context.size) + 1)

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Place of a child in the level, -1 if the context does not have it; a context of -1 has none."""
        found = np.full(context.shape, -1, np.int64)
        at = np.flatnonzero(context >= 0)
        if not self.ids.n or not at.size:
            return found
        context, child = context[at], child[at]
        start, end = self.pointers.get(context), self.pointers.get(context + 1)
        place = self.ids.successor(context * self.words + child, start, end)
        inside = place < end
        hit = inside.copy()
        hit[inside] = self.ids.get(place[inside]) == context[inside] * self.words + child[inside]
        found[at] = np.where(hit, place, -1)
        return found


class NgramTrie:
    """Back-off probabilities of words after one and two others, from counts of a shard's training n-grams.

    Words are numbered 0 .. words-1; a context is (previous word v, the one before it u). Seen n-grams have
    (count - DISCOUNT) / count of the context; DISCOUNT times the number of different followers over the
    count of the context is left for the shorter context. ``whole`` marks the words v whose followers are all in
    this shard; only these have a bigram level.
    """

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray, words: int, whole: np.ndarray):
        """``v``, ``u``, ``w``: distinct n-grams, sorted by v, u, w, with their counts."""
        pair = v * words + u
        new = np.concatenate([[True], pair[1:] != pair[:-1]]) if pair.size else np.zeros(0, bool)
        context = np.cumsum(new) - 1
        contexts = int(new.sum())
        total = np.bincount(context, counts, contexts)
        kinds = np.bincount(context, minlength=contexts)
        self.pairs = Level(v[new], u[new], words, words)
        self.triples = Level(context, w, contexts, words)
        mine = whole[v]
        both, at = np.unique(v[mine] * words + w[mine], return_inverse=True)
        follows = np.bincount(at, counts[mine], both.size)
        self.first = both // words if words else both
        self.bigrams = Level(self.first, both % words if words else both, words, words)
        self.total = np.bincount(self.first, follows, words)
        spread = np.bincount(self.first, minlength=words)
        with np.errstate(divide="ignore", invalid="ignore"):
            codes = [
                quantised((counts - DISCOUNT) / total[context]),
                quantised(DISCOUNT * kinds / total),
                quantised((follows - DISCOUNT) / self.total[self.first]),
                np.where(self.total > 0, quantised(np.where(self.total > 0, DISCOUNT * spread / self.total, 1)), 0),
            ]
        sequences = [s for level in (self.pairs, self.triples, self.bigrams) for s in (level.ids, level.pointers)]
        views = iter(mapped([p for s in sequences for p in s.parts] + [c.astype(np.uint16) for c in codes]))
        for s in sequences:
            s.parts = [next(views) for _ in s.parts]
        self.triple_codes, self.pair_backoff, self.bigram_codes, self.word_backoff = views

    def cost(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps below one of w after u, v, and whether that is all of it; else the shorter context's is to be added."""
        context = self.pairs.find(v, u)
        triple = self.triples.find(context, w)
        steps = np.zeros(v.shape, np.int64)
        seen = triple >= 0
        steps[seen] = self.triple_codes[triple[seen]]
        rest = np.flatnonzero(~seen)
        known = rest[context[rest] >= 0]
        steps[known] = self.pair_backoff[context[known]]
        bigram = self.bigrams.find(v[rest], w[rest])
        two = bigram >= 0
        steps[rest[two]] += self.bigram_codes[bigram[two]]
        seen[rest[two]] = True
        steps[rest[~two]] += self.word_backoff[v[rest[~two]]]
        return steps, seen
