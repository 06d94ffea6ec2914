"""Benchmark decontamination under edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are lower-cased, runs of white space become one space, and both sides are compared as UTF-8 bytes. A document holds an item if some
part of it is within ``RATE`` edits for each of the item's bytes.

Items are put into classes of similar length. A window is the stretch of a class's length from the start of a word, or from where grams shared with
the class set in (an item may be glued to what stands before). Windows that share
too few grams with a class to be within the edits (the q-gram lemma: each edit destroys at most q of them) are passed over,
which loses nothing. The others are embedded by CGK random walks, under which edit distance becomes Hamming distance, next to the items of their
class; a few sampled positions of an embedding are a key, and equal keys make a candidate. Each class takes as many walks, of ``TABLES`` keys of ``SYMBOLS`` positions
each, as bring ``RECALL`` of its own items back after random edits at the full rate (:func:`planned_walks`). Candidates are verified exactly by bit-parallel dynamic programming.

Documents are only read, in place: nothing is shuffled. Items are sent to every executor in blocks of ``ITEM_BYTES``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.common import batches, record, table

RATE = 0.1
SHORTEST = 16  # bytes; shorter items are looked for as they are, between word bounds
RECALL = 0.97  # aimed at for items with all the edits allowed, in each third of a class's lengths
MOST_WALKS = 24
TABLES = 10  # keys of each walk
SYMBOLS = 3
CLASSES = (3, 8)  # of lengths, under 64 bytes and from there on
ITEM_BYTES = 16 << 20
#: bytes that words are made of: letters, digits, and those of UTF-8 beyond ASCII
_WORDY = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def fuzzy_find(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance between ``item`` and any part of ``text``, and where that part ends first."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = every, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (every & ~(xh | pv))
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1) & every
        mh = (mh << 1) & every
        pv = mh | (every & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def _grams(data: bytes, q: int) -> np.ndarray:
    """The number of every q-gram of ``data`` (q up to 8)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = np.ndarray((n,), "<u8", buffer=data + bytes(8), strides=(1,))
    return wide & np.uint64((1 << 8 * q) - 1) if q < 8 else wide.copy()


class _Class:
    """Items of similar length, their grams' counts and their keys."""

    def __init__(self, members: list[tuple[int, bytes]], rate: float, seed: int, walks: int):
        lens = [len(x) for _, x in members]
        edits = [int(rate * n) for n in lens]
        self.members, self.edits = members, edits
        self.q = 8 if min(lens) >= 64 else 4
        self.sets = [set(_grams(x, self.q).tolist()) for _, x in members]
        # windows must be able to hold the longest member; grams that must survive in the weakest one, occurrences counted
        self.reach = max(n + k for n, k in zip(lens, edits))
        self.least = max(1, min(n - self.q + 1 - self.q * k for n, k in zip(lens, edits)))
        self.needs = [max(1, len(s) - self.q * k) for s, k in zip(self.sets, edits)]  # distinct grams that are left
        self.size = min(lens)
        self.vocabulary = np.unique(np.concatenate([np.fromiter(s, np.uint64, len(s)) for s in self.sets]))
        self.has = np.zeros((len(self.vocabulary), len(members)), bool)
        for m, s in enumerate(self.sets):
            self.has[np.searchsorted(self.vocabulary, np.fromiter(s, np.uint64, len(s))), m] = True
        self.walks, self.steps = walks, 2 * self.size
        draws = [np.random.default_rng((seed, self.size, walk)) for walk in range(walks)]
        self.moves = [rng.integers(0, 2, (self.steps, 256), dtype=np.int8) for rng in draws]
        self.places = [np.stack([rng.choice(self.steps, SYMBOLS, replace=False) for _ in range(TABLES)]) for rng in draws]
        self.weights = np.random.default_rng(seed).integers(1, 1 << 62, (SYMBOLS,), dtype=np.uint64) | np.uint64(1)
        joined, starts = b"".join(x for _, x in members), np.cumsum([0, *lens[:-1]])
        self.tables = []
        for walk in range(walks):
            for keys in self.keys(np.frombuffer(joined, np.uint8), starts, walk):
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], order))

    def possible(self, grams: np.ndarray) -> np.ndarray:
        """Which members have enough distinct grams among ``grams`` to be within their edits."""
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        return self.has[np.unique(at[self.vocabulary[at] == grams])].sum(0) >= self.needs

    def keys(self, data: np.ndarray, starts: np.ndarray, walk: int) -> list[np.ndarray]:
        """The keys of the windows at ``starts``, one array for each table."""
        wanted = {int(p) for p in self.places[walk].ravel()}
        at, end, seen = starts.astype(np.int64), np.minimum(starts + self.size, len(data)), {}
        for step in range(max(wanted) + 1):
            symbol = np.where(at < end, data[np.minimum(at, len(data) - 1)], 0)
            if step in wanted:
                seen[step] = symbol.astype(np.uint64) + np.uint64(1)
            at += self.moves[walk][step][symbol]
        return [sum(seen[int(p)] * w for p, w in zip(some, self.weights)) * _ODD for some in self.places[walk]]

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (window, member) whose keys agree in some table."""
        found = []
        for t in range(self.walks * TABLES):
            if t % TABLES == 0:
                keys = self.keys(data, starts, t // TABLES)
            mine, (sorted_keys, order) = keys[t % TABLES], self.tables[t]
            low, high = np.searchsorted(sorted_keys, mine), np.searchsorted(sorted_keys, mine, "right")
            rows = np.flatnonzero(high > low)
            n = (high - low)[rows]
            member = order[np.repeat(low[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append(np.stack([np.repeat(rows, n), member], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _edited(item: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """``item`` after random edits: bytes replaced, put in and left out alike."""
    out = bytearray(item)
    for _ in range(edits):
        at, kind, byte = int(rng.integers(len(out))), int(rng.integers(3)), item[int(rng.integers(len(item)))]
        if kind == 0:
            out[at] = byte
        elif kind == 1:
            out.insert(at, byte)
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def planned_walks(members: list[tuple[int, bytes]], rate: float, seed: int, recall: float = RECALL, copies: int = 240) -> int:
    """The least number of walks, ``MOST_WALKS`` at most, under which ``recall`` of edited items share a key with their own, in each third of the class's lengths."""
    rng = np.random.default_rng(seed)
    by_size = sorted((x for _, x in members), key=len)
    some = [by_size[int(i * len(by_size) / copies)] for i in range(copies)]
    trial = _Class([(0, by_size[0])], rate, seed, MOST_WALKS)
    # what follows an item in a text follows the copy here
    data = [x + by_size[-1] for x in some] + [_edited(x, int(rate * len(x)), rng) + by_size[-1] for x in some]
    starts = np.cumsum([0, *[len(x) for x in data[:-1]]])
    met = np.zeros(copies, bool)
    for walk in range(MOST_WALKS):
        for keys in trial.keys(np.frombuffer(b"".join(data), np.uint8), starts, walk):
            met |= keys[:copies] == keys[copies:]
        if min(part.mean() for part in np.array_split(met, 3)) >= recall:
            return walk + 1
    return MOST_WALKS


class Index:
    """Items of one block, ready to be looked for. ``walks``: what :attr:`walks` of an equal index holds, which spares planning again."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, seed: int = 5, walks: list[int] | None = None):
        rows = sorted((len(b), i, b) for i, b in ((i, normalise(t)) for i, t in items) if len(b) >= SHORTEST)
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by length
        for i, t in items:
            if 0 < len(b := normalise(t)) < SHORTEST:
                self.short.setdefault(len(b), {}).setdefault(b, []).append(i)
        self.classes: list[_Class] = []
        self.walks: list[int] = []
        for short in (True, False):
            some = [r for r in rows if (r[0] < 64) == short]
            cuts = CLASSES[0 if short else 1]
            if some:
                # no class is narrower than a tenth of its length, which the edits allowed blur anyway
                ratio = max((some[-1][0] + 1) / some[0][0], 1.1**cuts)
                groups: dict[int, list] = {}
                for n, i, b in some:
                    groups.setdefault(int(cuts * np.log(n / some[0][0]) / np.log(ratio)), []).append((i, b))
                for g in groups.values():
                    self.walks.append(walks[len(self.walks)] if walks else planned_walks(g, rate, seed))
                    self.classes.append(_Class(g, rate, seed, self.walks[-1]))
        self.marks = {}
        for q in {c.q for c in self.classes}:
            grams = sum(len(s) for c in self.classes if c.q == q for s in c.sets)
            bits = min(26, max(20, (64 * grams).bit_length()))
            mark = np.zeros(1 << bits, np.uint16)
            for b, c in enumerate(self.classes):
                if c.q == q:
                    for s in c.sets:
                        mark[self._slot(np.fromiter(s, np.uint64, len(s)), bits)] |= np.uint16(1 << b)
            self.marks[q] = (mark, bits)

    @staticmethod
    def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
        return (grams * _ODD) >> np.uint64(64 - bits)

    def find_short(self, blob: bytes, data: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
        """``{(text's place, item): 0}`` for the items under ``SHORTEST`` bytes."""
        found: dict[tuple[int, int], int] = {}
        if self.short:
            inner = np.pad(_WORDY[data], (1, 1 + SHORTEST))
            bound = ~(inner[:-1] & inner[1:])  # a word neither goes on before this byte nor ends here
            starts = np.flatnonzero(bound[: len(data)])
            for n, some in self.short.items():
                for at in starts[bound[starts + n]].tolist():
                    for i in some.get(blob[at : at + n], ()):
                        found[int(np.searchsorted(ends, at, "right")), i] = 0
        return found

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """Rows (text's place, item, edits) for every item that a text holds."""
        parts = [normalise(t) for t in texts]
        blob = b"\n".join(parts)
        if not blob:
            return []
        ends = np.cumsum([len(p) + 1 for p in parts])
        data = np.frombuffer(blob, np.uint8)
        hits, grams = {}, {}
        for q, (mark, bits) in self.marks.items():
            grams[q] = _grams(blob, q)
            got = mark[self._slot(grams[q], bits)]
            at = np.flatnonzero(got)
            hits[q] = (at, got[at])
        best = self.find_short(blob, data, ends)
        words, opens = np.append(True, (data[:-1] == 32) | (data[:-1] == 10)), np.zeros(len(data), bool)
        for b, c in enumerate(self.classes):
            at, got = hits[c.q]
            at = at[(got >> b) & 1 == 1]
            if len(at) < c.least:
                continue
            low = at[c.least - 1 :] - c.reach + c.q  # a window from here on holds the least count of grams
            high = at[: len(at) - c.least + 1]
            ok = low <= high
            if not ok.any():
                continue
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, np.maximum(low[ok], 0), 1)
            np.add.at(change, high[ok] + 1, -1)
            inside = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
            for first, last in edges.tolist():  # stretches of windows; those that no member can be in are passed over
                if not c.possible(grams[c.q][first : last + c.reach]).any():
                    inside[first:last] = False
            opens[at] = True
            opens[at[np.flatnonzero(np.diff(at, prepend=-2) == 1)]] = False  # of places in a row that share grams, the first
            starts = np.flatnonzero(inside & (opens | words))
            opens[at] = False
            if not len(starts):
                continue
            pairs = c.candidates(data, starts)
            where = starts[pairs[:, 0]]
            doc = np.searchsorted(ends, where, "right")
            new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(where, prepend=-1) > c.reach))
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(where)]):
                d = int(doc[s])
                begin, end = (int(ends[d - 1]) if d else 0), int(ends[d]) - 1
                # a window may have matched a little off the true place: a reach to either side covers what it stands for
                begin, end = max(begin, int(where[s]) - c.reach), min(end, int(where[e - 1]) + 2 * c.reach)
                enough = c.possible(grams[c.q][begin : max(begin, end - c.q + 1)])
                for m in np.unique(pairs[s:e, 1]).tolist():
                    if enough[m]:
                        item, wanted = c.members[m]
                        edits, _ = fuzzy_find(wanted, blob[begin:end])
                        if edits <= c.edits[m]:
                            best[d, item] = min(edits, best.get((d, item), edits))
        return [(d, i, k) for (d, i), k in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, edits)``: every item that a document's text holds, with the least edits.

    Null and empty texts hold nothing; null and empty items are left out, those under ``SHORTEST`` bytes are matched exactly at word bounds; ids may be null or repeat;
    either table may be empty.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((block, Index(block, rate).walks))

        def run(source, shared=shared):
            items, walks = shared.value
            index = Index(items, rate, walks=walks)
            for batch in batches(source):
                ids = batch.column(0).to_pylist()
                found = index.find(batch.column(1).to_pylist())
                yield record(schema, [ids[d] for d, _, _ in found], [i for _, i, _ in found], [k for _, _, k in found])

        part = rows.mapInArrow(run, "doc_id long, item_id long, edits int")
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most about ``ITEM_BYTES``, which is what an executor is sent at once."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // ITEM_BYTES))
    if n == 1:
        return [[(r.i, r.t) for r in rows.collect()]]
    place = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [[(r.i, r.t) for r in rows.where(place == b).collect()] for b in range(n)]


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged."""
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((block, Index(block, rate).walks))

        def run(source, shared=shared):
            items, walks = shared.value
            index = Index(items, rate, walks=walks)
            for batch in batches(source):
                bad = {d for d, _, _ in index.find(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontaminate": query}
ORACLES: dict[str, str] = {}
