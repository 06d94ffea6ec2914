"""Repeated windows of units (words or bytes), found exactly through content-defined phrases.

Every window of ``window`` units holds a trigger: the least of its ``gram``-unit rolling hashes, the leftmost among equals. That depends on
the window's content alone, so equal windows have the same trigger at the same place in them. Consecutive windows with the same
trigger form a run; the units they cover are a phrase. A text is so parsed into overlapping phrases, about one for every
(window - gram) / 2 units, and each of its windows lies in exactly one of them.

A window can only be repeated if its trigger is, so phrases whose trigger occurs once are left out, and what is left is a
dictionary of distinct phrases with their counts. Windows are compared one by one only between different phrases that share a trigger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexiquarry.llm.common import mix64

PIECE = 1 << 20  # units handled at once; longer texts are cut into pieces that overlap by a window less one
_BASE = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)
_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n at least (which: 0, 1 the bases, 2, 3 their inverses)."""
    if which not in _powers or len(_powers[which]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, (_BASE + _INVERSE)[which], np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit units, from prefix sums."""

    def __init__(self, units: np.ndarray, which: int):
        self.which = which
        self.sums = np.empty(len(units) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(units * powers(which, len(units)), out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of the ``size`` units from each place on."""
        n = max(0, len(self.sums) - size)
        return mix64((self.sums[size:] - self.sums[:n]) * powers(self.which + 2, n), size)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * powers(self.which + 2, len(self.sums))[start], 0) + (end - start).astype(np.uint64)


@dataclass
class Runs:
    """Runs of windows: the trigger's hash, text number, first window, number of windows, phrase digest."""

    key: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    digest: np.ndarray | None


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def pieces(lens: np.ndarray, window: int, most: int = PIECE):
    """(text number, offset, length) of what is handled at once: texts of at least a window, long ones cut."""
    for doc in np.flatnonzero(lens >= window):
        n = int(lens[doc])
        for at in range(0, n - window + 1, most - window + 1):
            yield int(doc), at, min(most, n - at)


def runs(units: np.ndarray, lens: np.ndarray, window: int, gram: int, digests: bool = True) -> Runs:
    """The runs of texts laid end to end in ``units`` (``lens``: units of each)."""
    begin = np.cumsum(lens) - lens
    out: list[tuple] = []
    group: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        data = np.concatenate([units[begin[d] + at : begin[d] + at + n] for d, at, n in group]) if len(group) > 1 else units[begin[group[0][0]] + group[0][1] :][: group[0][2]]
        first = Rolling(data, 0)
        hashes = first.every(gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        bits = np.uint64(22)
        low = _sliding_least((hashes >> bits << bits) | place, window - gram + 1)
        trigger = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
        ns = np.array([n for _, _, n in group])
        ends = np.cumsum(ns)
        index = np.repeat(np.arange(len(group)), ns)[: len(trigger)]
        valid = np.arange(len(trigger)) + window <= ends[index]
        where = np.flatnonzero(valid)
        t = trigger[where]
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        start = where[edge]
        count = np.diff(np.append(edge, len(where)))
        g = index[start]
        docs, offs = np.array([d for d, _, _ in group])[g], np.array([at for _, at, _ in group])[g] - (ends - ns)[g]
        digest = Rolling(data, 1).of(start, start + count + window - 1) if digests else None
        out.append((hashes[t[edge]], docs, start + offs, count, digest))

    for piece in pieces(lens, window):
        group.append(piece)
        size += piece[2]
        if size >= PIECE // 4:
            flush()
            group, size = [], 0
    if group:
        flush()
    if not out:
        none = np.zeros(0, np.int64)
        return Runs(none.astype(np.uint64), none, none, none, none.astype(np.uint64))
    return Runs(*[np.concatenate(c) if c[0] is not None else None for c in zip(*out)])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all windows of the runs, one run after the other."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def covered(n: int, start: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's ``n`` units some flagged window covers; bit i of ``mask`` flags the window i after ``start``."""
    row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(mask, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = start[row] + bit
    change = np.bincount(at, minlength=n + 1)
    change -= np.bincount(at + window, minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


# ---------------------------------------------------------------- units

_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The XXH3 of every word, and the number of words of each text. (Sums of powers would make words alike that are built to be, such as Thue-Morse words.)"""
    from xxhash import xxh3_64_intdigest

    out, lens = [np.zeros(0, np.uint64)], []
    for text in texts:
        words = text.split()
        lens.append(len(words))
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(out), np.array(lens, np.int64)
