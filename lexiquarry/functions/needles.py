"""Many needles in many texts at once, as bytes.

A needle of n bytes is told by the hashes of its first and its last p bytes, where p is the greatest power of two up to n: together these cover it. A text's hashes of p
bytes come from prefix sums, so each byte is looked at once for every p in use, however many needles there are. What is found is
given as it stands in the text; equal hashes of different bytes go when it is joined to the needles.
"""

from __future__ import annotations

import numpy as np

_BASE = (np.uint64(0x2545F4914F6CDD1D), np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64)))  # and its inverse
_held: dict[int, np.ndarray] = {}
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 1 << 20  # bytes of text looked at together


def _powers(which: int, n: int) -> np.ndarray:
    """The first powers of a base; those that a slice of texts needs are kept."""
    if which not in _held:
        _held[which] = _multiplied(which, SLICE + (1 << 16))
    return _held[which][:n] if n <= len(_held[which]) else _multiplied(which, n)


def _multiplied(which: int, n: int) -> np.ndarray:
    steps = np.full(n, _BASE[which], np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


class _Sums:
    """Hashes of any stretch of a sequence of bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _powers(0, len(data)), out=self.sums[1:])
        self.back = _powers(1, len(data) + 1)

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start])

    def every(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:n]) * self.back[:n])


def _both(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    return _mixed(first ^ _mixed(last + np.asarray(size).astype(np.uint64)))


def _slices(offsets: np.ndarray):
    """Stretches (first, last) of the texts that ``offsets`` part, of about ``SLICE`` bytes; a longer text goes alone."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, to
        at = to


def keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the first part, that of both parts and the size of each needle; the needles lie in ``data`` from each of ``offsets`` to the next. Empty ones have size 0."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in _slices(offsets):
        sums, start = _Sums(data[offsets[a] : offsets[b]]), offsets[a:b] - offsets[a]
        size = np.diff(offsets[a : b + 1])
        part = (1 << np.frexp(np.maximum(size, 1))[1].astype(np.int64)) >> 1
        part = np.where(size > 0, part, 0)
        first = sums.at(start, part)
        parts.append((first, _both(first, sums.at(start + size - part, part), size), size))
    return tuple(np.concatenate(c) for c in zip(*parts))


class Needles:
    """Needles by their :func:`keys`, to be looked for in texts."""

    def __init__(self, first: np.ndarray, both: np.ndarray, size: np.ndarray):
        some = size > 0
        self.empty = not some.all()
        first, both, size = first[some], both[some], size[some]
        self.both = np.unique(both)
        self.parts = []
        power = np.frexp(size)[1].astype(np.int64) - 1
        for p in np.unique(power).tolist():
            mine = power == p
            # the distinct sizes of the needles that begin alike, behind each other
            h, n = first[mine], size[mine]
            order = np.lexsort((n, h))
            h, n = h[order], n[order]
            told = np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])])
            h, n = h[told], n[told]
            heads, begin = np.unique(h, return_index=True)
            shift = np.uint64(64 - min(25, len(heads).bit_length() + 4))
            known = np.zeros(1 << (64 - int(shift)), bool)
            known[heads >> shift] = True
            self.parts.append((1 << p, heads, np.append(begin, len(h)), n, shift, known))

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, size) of one place of every needle that a text holds, none of empty needles; the texts lie in ``data`` from each of ``offsets`` to the next."""
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in _slices(offsets):
            base = int(offsets[a])
            sums = _Sums(data[base : offsets[b]])
            ends = offsets[a + 1 : b + 1] - base
            for part, heads, begin, sizes, shift, known in self.parts:
                codes = sums.every(part)
                place = np.flatnonzero(known[codes >> shift])
                head = np.searchsorted(heads, codes[place])
                same = heads[np.minimum(head, len(heads) - 1)] == codes[place]
                place, head = place[same], head[same]
                # by few at a time: a place may begin needles of several sizes
                count = begin[head + 1] - begin[head]
                got = [(np.zeros(0, np.int64),) * 4]
                for i, j in _slices(np.concatenate([[0], np.cumsum(count)])):
                    n = count[i:j]
                    at = np.repeat(place[i:j], n)
                    size = sizes[np.repeat(begin[head[i:j]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                    text = np.searchsorted(ends, at, side="right")
                    inside = at + size <= ends[text]
                    at, size, text = at[inside], size[inside], text[inside]
                    key = _both(codes[at], sums.at(at + size - part, part), size)
                    slot = np.searchsorted(self.both, key)
                    held = self.both[np.minimum(slot, len(self.both) - 1)] == key
                    at, size, text, slot = at[held], size[held], text[held], slot[held]
                    once = np.unique(text * len(self.both) + slot, return_index=True)[1]
                    got.append((at[once], size[once], text[once], slot[once]))
                at, size, text, slot = (np.concatenate(c) for c in zip(*got))
                once = np.unique(text * len(self.both) + slot, return_index=True)[1]
                out.append((a + text[once], base + at[once], size[once]))
        return tuple(np.concatenate(c) for c in zip(*out))
