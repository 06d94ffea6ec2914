"""Token-ID output: texts to ids, ids to blocks of a static range asymmetric numeral system, and back.

File format. A dataset in the shared store holds one row per block: ``part`` and ``block`` (its place), ``first``
(ids before it in the whole output), ``doc_ids``/``nulls``/``lens`` (little-endian 64-bit ids, a null mask, 32-bit
lengths), ``n_tokens``, ``lanes``, ``payload`` (32-bit words of the interleaved coders), ``states`` and ``at``
(checkpoints: the coders' states and the word position every ``STRIDE`` steps, so a reader may start at any of
them), ``crc_payload`` and ``crc_ids``. A second dataset holds the frequency table that all blocks share. Blocks are independent:
each ends with a document and can be decoded alone, by any task.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.common import batches, record, table
from lexiquarry.session import discard, free_shuffles, materialise, scratch

SCALE = 20  # bits of the frequency table's sum
LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)
LANES = 512
STRIDE = 128  # steps between checkpoints
BLOCK = 1 << 17  # ids after which a block ends at the next document


# ---------------------------------------------------------------- text to ids


class Merger:
    """Byte-pair merges of many short byte strings at once: in each round every string makes its next merge, the one of least rank, the leftmost among equals."""

    NONE = 1 << 30  # above every rank
    WIDTHS = (8, 16, 32, 64)  # strings are worked on beside others of about their length

    def __init__(self, model: dict, letters: dict[int, int]):
        vocab = model["vocab"]
        self.byte = np.array([vocab.get(chr(letters[x]), -1) for x in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = np.uint64(max(vocab.values()) + 1)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.uint64).reshape(-1, 2)
        keys = pairs[:, 0] * self.size + pairs[:, 1] + np.uint64(1)
        # a table with open addressing; 0 marks a free slot
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.zeros(1 << bits, np.uint64), np.full(1 << bits, self.NONE, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] and self.keys[slot] != key:
                slot = slot + 1 & self.mask
            if not self.keys[slot]:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two symbols, ``NONE`` where there is none."""
        keys = a.astype(np.uint64) * self.size + b.astype(np.uint64) + np.uint64(1)
        slot = self._slot(keys)
        out, left = np.full(len(keys), self.NONE, np.int32), None
        while True:
            held = self.keys[slot]
            same = held == keys
            hit = np.flatnonzero(same)
            out[hit if left is None else left[hit]] = self.ranks[slot[hit]]
            on = np.flatnonzero(~same & (held != 0))
            if not len(on):
                return out
            left = on if left is None else left[on]
            keys, slot = keys[on], slot[on] + 1 & self.mask

    def __call__(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at ``starts`` (1 to ``WIDTHS[-1]`` bytes each), end to end, and how many each has."""
        count, parts = np.zeros(len(lens), np.int64), []
        for low, width in zip((0, *self.WIDTHS), self.WIDTHS):
            rows = np.flatnonzero((lens > low) & (lens <= width))
            for at in range(0, len(rows), 1 << 14):
                some = rows[at : at + (1 << 14)]
                ids = self._merged(data, starts[some], lens[some], width)
                count[some] = (ids >= 0).sum(1)
                parts.append((some, ids))
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        for some, ids in parts:
            used = ids >= 0
            flat[(begin[some][:, None] + np.arange(ids.shape[1]))[used]] = ids[used]
        return flat, count

    def _merged(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
        """A row of ids for each string, filled with -1."""
        place = np.arange(width)
        inside = place < lens[:, None]
        ids = np.where(inside, self.byte[data[np.minimum(starts[:, None] + place, len(data) - 1)]], -1).astype(np.int32)
        ranks = np.full(ids.shape, self.NONE, np.int32)
        y, x = np.nonzero(inside[:, 1:])
        ranks[y, x] = self.rank(ids[y, x], ids[y, x + 1])
        out, rows = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == self.NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                on = ~done
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                if not len(rows):
                    break
                if (longest := int((ids >= 0).sum(1).max())) < ids.shape[1]:
                    ids, ranks = ids[:, :longest], ranks[:, :longest]
            each, stay = np.arange(len(rows)), np.arange(ids.shape[1]) <= at[:, None]
            ids = np.where(stay, ids, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1))
            ranks = np.where(stay, ranks, np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=self.NONE))
            ids[each, at] = self.made[best]
            ranks[each, at] = self.NONE
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at + 1 < ids.shape[1])
            right = right[ids[right, at[right] + 1] >= 0]
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out


class Encoder:
    """Whole texts to token ids, exactly as the tokenizers library gives them.

    A text is cut before a space that touches a non-space on either side, and before a line feed between two non-spaces; the byte-level pre-tokenizer always
    starts a new unit there, and after such a line feed, so pieces are encoded independently, each distinct piece of a batch once. Pieces of Latin letters, with a run of marks after them or
    not, are merged here, all at once; others go to the library. So do, whole, texts where three whitespace characters surround a space, or that hold an
    added token's string or a zero, which stands for a line feed that begins a piece. Nothing is kept from batch to batch.
    """

    _unsafe = re.compile(r"\s \s|^ \s|\s $|^ $")
    #: white space besides the space and the line feed; texts without any of it need only cheap tests
    _rare = re.compile("[" + "".join(chr(x) for x in range(0x3001) if chr(x).isspace() and chr(x) not in " \n") + "]")
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # an apostrophe may begin a unit with letters
    RUN = 8  # marks in a run
    _line = re.compile(r"(?<=\S)\n(?=\S)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in set(kept)]
        letters = {x: x for x in kept} | {x: 256 + i for i, x in enumerate(rest)}  # the byte alphabet of byte-level vocabularies
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        #: whether pieces are cut and merged as this class does; another vocabulary's texts all go to the library as they are
        split, kind = told.get("pre_tokenizer") or {}, told["model"]
        self.assumed = told.get("normalizer") is None and told.get("truncation") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and kind.get("type") == "BPE"
        self.assumed = self.assumed and not any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not self.assumed:
            return
        self.merge = Merger(kind, letters)
        self.feed = np.uint32(self.merge.byte[10])
        # bytes that Latin letters up to U+024F are made of; what else those bytes can make is told apart by pairs
        self.other = np.ones(256, np.int64)
        self.other[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 0
        self.is_mark = np.zeros(256, bool)
        self.is_mark[list(self.MARKS)] = True

    def _whole(self, text: str) -> bool:
        """Whether a text must go to the library in one part."""
        odd = "  " in text or "\n \n" in text or text[0] == " " or text[-1] == " " or self._rare.search(text)
        return bool(odd and self._unsafe.search(text)) or "\0" in text or any(a in text for a in self.added)

    def _pieces(self, pieces: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, starts, lengths) of pieces; ``spaced`` says which begin with a space."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"\0", np.uint8)
        bad = self.other[data]
        pair = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC9) & (data[1:] >= 0x90)
        bad[:-1] += pair
        upto = np.concatenate([[0], np.cumsum(bad)])
        start, end = offsets[:-1], offsets[1:]
        fed = (end > start) & (data[np.minimum(start, len(data) - 1)] == 0)
        first, begin = start + (spaced | fed), start + fed
        other = np.maximum.accumulate(np.where(self.is_mark[data], -1, np.arange(len(data))))
        last = np.maximum(np.where(end > start, other[np.maximum(end - 1, 0)] + 1, end), first)
        plain = (last > first) & (upto[last] == upto[np.minimum(first, len(data))]) & (last - begin <= Merger.WIDTHS[-1]) & (end - last <= self.RUN)
        own, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        flat, count = self.merge(data, begin[own], (last - begin)[own])
        run, marks, told = self._runs(data, last[own], (end - last)[own])
        lens = np.zeros(len(pieces), np.int64)
        lens[own] = fed[own] + count + told
        others = [e.ids for e in self.tok.encode_batch_fast([x.replace("\0", "\n") for x in pieces.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
        lens[rest] = [len(x) for x in others]
        starts = np.cumsum(lens) - lens
        ids = np.empty(int(lens.sum()), np.uint32)
        ids[starts[own[fed[own]]]] = self.feed
        at = starts[own] + fed[own]
        ids[np.repeat(at - np.cumsum(count) + count, count) + np.arange(len(flat))] = flat
        ids[np.repeat(at + count - np.cumsum(told) + told, told) + np.arange(int(told.sum()))] = marks[np.repeat(run - np.cumsum(told) + told, told) + np.arange(int(told.sum()))]
        at = np.repeat(starts[rest] - np.cumsum(lens[rest]) + lens[rest], lens[rest]) + np.arange(int(lens[rest].sum()))
        ids[at] = np.fromiter(chain.from_iterable(others), np.uint32, len(at))
        return ids, starts, lens

    def _runs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of marks: where each one's ids begin in the ids of all different ones, these, and how many each has."""
        wide = np.ndarray((len(data) + 1,), "<u8", buffer=data.tobytes() + bytes(9), strides=(1,))
        codes = np.where(size > 0, wide[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.maximum(size, 1)) * 8).astype(np.uint64)), np.uint64(0))
        different, which = np.unique(codes, return_inverse=True)
        lists = [e.ids for e in self.tok.encode_batch_fast([x.to_bytes(8, "little").rstrip(b"\0").decode() for x in different.tolist()], add_special_tokens=False)]
        n = np.array([len(x) for x in lists], np.int64)
        return (np.cumsum(n) - n)[which], np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n[which]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without an end mark; a null text counts as empty."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        if not self.assumed:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        todo = []
        for i, text in enumerate(texts):
            if text and self._whole(text):
                out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            elif text:
                todo.append(i)
        if not todo:
            return out
        lists = pc.split_pattern(pa.array([self._line.sub(" \0", texts[i]) for i in todo], pa.large_string()), " ")
        begin = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        mine = words.indices.to_numpy().astype(np.int64)
        heads, head = np.unique(mine[begin[:-1]], return_inverse=True)  # texts begin without a space
        fed = pc.starts_with(words.dictionary, "\0")
        spaced = pc.if_else(fed, words.dictionary, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.dictionary, pa.scalar(" ", pa.large_string())))
        pieces = pa.concat_arrays([spaced, words.dictionary.take(pa.array(heads))])
        ids, starts, lens = self._pieces(pieces, np.append(~fed.to_numpy(zero_copy_only=False), np.zeros(len(heads), bool)))
        mine[begin[:-1]] = len(words.dictionary) + head
        each = lens[mine]
        ends = np.cumsum(each)
        flat = ids[np.repeat(starts[mine] - ends + each, each) + np.arange(int(ends[-1]))]
        for i, part in zip(todo, np.split(flat, ends[begin[1:-1] - 1])):
            out[i] = part
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- the coder


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts to whole frequencies that sum to ``2**scale``, at least 1 for every symbol that occurs."""
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if not len(used):
        return out
    room = (1 << scale) - len(used)
    if room < 0:
        raise ValueError(f"{len(used)} symbols do not fit in 2**{scale}")
    share = counts[used] / counts.sum() * room
    out[used] = 1 + np.floor(share).astype(np.int64)
    short = (1 << scale) - int(out.sum())
    best = used[np.argsort(-(share - np.floor(share)), kind="stable")[:short]]
    out[best] += 1
    return out


class Coder:
    """Interleaved range asymmetric numeral coders over one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.bound = self.freq << np.uint64(63 - scale)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[bytes, bytes, bytes]:
        """Payload words, checkpoint states and checkpoint word positions. The first checkpoint is the stream's start."""
        if not len(ids):
            return b"", b"", b""
        x = np.full(lanes, LOW, np.uint64)
        words, states, marks = [], [], []
        freq, cum, bound = self.freq[ids], self.cum[ids], self.bound[ids]
        more, high, room = (np.uint64(1) << self.scale) - freq, np.uint64(32), np.empty(lanes, np.uint64)
        for t in range((len(ids) - 1) // lanes, -1, -1):
            here = slice(t * lanes, min(len(ids), (t + 1) * lanes))
            m = here.stop - here.start
            y, q = x[:m], room[:m]
            full = y >= bound[here]
            words.append(y[full].astype(np.uint32))
            np.right_shift(y, high, out=y, where=full)
            # (y // f << scale) + y % f + cum
            np.floor_divide(y, freq[here], out=q)
            q *= more[here]
            y += q
            y += cum[here]
            if t % STRIDE == 0:
                states.append(x.copy())
                marks.append(len(words))
        sizes = np.cumsum([len(w) for w in words])
        total = int(sizes[-1])
        at = np.array([total - int(sizes[m - 1]) for m in reversed(marks)], "<u4")
        return np.concatenate(words[::-1]).astype("<u4").tobytes(), np.concatenate(states[::-1]).astype("<u8").tobytes(), at.tobytes()

    def decode(self, n: int, lanes: int, payload: bytes, states: bytes, at: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (to the end if None)."""
        if not n:
            return np.zeros(0, np.uint32)
        words, marks = np.frombuffer(payload, "<u4").astype(np.uint64), np.frombuffer(at, "<u4")
        x = np.frombuffer(states, "<u8").reshape(-1, lanes)[first].astype(np.uint64)
        p, steps = int(marks[first]), -(-n // lanes)
        stop = steps if last is None else min(steps, last * STRIDE)
        out = np.empty(min(n, stop * lanes) - first * STRIDE * lanes, np.uint32)
        for k, t in enumerate(range(first * STRIDE, stop)):
            m = min(lanes, n - t * lanes)
            y = x[:m]
            slot = y & self.mask
            s = self.symbol.take(slot.view(np.int64))
            out[k * lanes : k * lanes + m] = s
            y >>= self.scale
            y *= self.freq.take(s)
            y += slot
            y -= self.cum.take(s)
            low = np.flatnonzero(y < LOW)
            y[low] = (y[low] << np.uint64(32)) | words[p : p + len(low)]
            p += len(low)
        return out


# ---------------------------------------------------------------- the operator

_RAW = "part int, block long, local long, doc_ids binary, nulls binary, lens binary, n_tokens long, ids binary"
_FILE = "part int, block long, first long, doc_ids binary, nulls binary, lens binary, n_tokens long, lanes int, payload binary, states binary, at binary, crc_payload long, crc_ids long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Blocks of ids in ascending document order: each task holds one range of ids, so parts follow each other."""
    schema = _arrow(_RAW)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width, part, number, before = _width(enc.size), TaskContext.get().partitionId(), 0, 0
        held, ids, size = [], [], 0

        def flush():
            lens = np.array([len(x) for x in held], "<u4")
            null = np.array([i is None for i in ids], np.uint8)
            keys = np.array([0 if i is None else i for i in ids], "<i8")
            return record(schema, [part], [number], [before], [keys.tobytes()], [null.tobytes()], [lens.tobytes()], [size], [np.concatenate(held).astype(width).tobytes()])

        for batch in batches(source, rows=8192, size=12 << 20):
            texts = batch.column(1).to_pylist()
            for i, x in zip(batch.column(0).to_pylist(), enc(texts)):
                held.append(np.append(x, np.uint32(end_id)))
                ids.append(i)
                size += len(x) + 1
                if size >= block:
                    yield flush()
                    number, before, held, ids, size = number + 1, before + size, [], [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    # the beginning of the text parts rows that share an id, or have none; its order is that of whole texts
    return rows.repartitionByRange("i", F.left("t", F.lit(32))).sortWithinPartitions("i", "t").mapInArrow(run, _RAW)


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode ``docs`` and write ``path/blocks`` and ``path/table``.

    Null texts are empty documents (the end id only); null ids come first; rows that share an id are kept, in text
    order; no rows give a file without blocks. Further columns are ignored. The count of ids by part, one number for each task, and the
    vocabulary's counts are all that reaches the driver.
    """
    spark = docs.sparkSession
    free_shuffles(spark)
    size = encoder(vocabulary).size
    width = _width(size)
    raw = materialise(tokenise(docs, vocabulary, id_col, text_col, end_id), "tokens")

    def tally(source):
        total = np.zeros(size, np.int64)
        for batch in source:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=size)
        used = np.flatnonzero(total)
        yield record(pa.schema([("id", pa.int64()), ("n", pa.int64())]), used, total[used])

    counts = np.zeros(size, np.int64)
    for i, n in raw.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    freq = frequencies(counts)
    base, sums = {}, 0
    for part, n in raw.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():
        base[part], sums = sums, sums + n
    shared = spark.sparkContext.broadcast((freq, base))  # the vocabulary's size and a number for each part
    schema = _arrow(_FILE)

    def pack(source):
        freq, base = shared.value
        coder = Coder(freq)
        for batch in source:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], width)
                lanes = min(LANES, max(1, 1 << max(0, len(ids) // 64).bit_length() - 1 if len(ids) >= 64 else 1))
                payload, states, at = coder.encode(ids, lanes)
                yield record(schema, [r["part"]], [r["block"]], [base[r["part"]] + r["local"]], [r["doc_ids"]], [r["nulls"]], [r["lens"]], [len(ids)], [lanes], [payload], [states], [at], [zlib.crc32(payload)], [zlib.crc32(ids.astype("<u4").tobytes())])

    raw.mapInArrow(pack, _FILE).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "freq": pa.array(freq[used], pa.int64())}).to_pandas() if len(used) else [], "id long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    discard(raw)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files and checked."""
    rows = spark.read.parquet(f"{path}/table").collect()  # the vocabulary's size at most
    freq = np.zeros(1 + max((r.id for r in rows), default=0), np.int64)
    for r in rows:
        freq[r.id] = r.freq
    shared, schema = spark.sparkContext.broadcast(freq), _arrow(_ROWS)

    def unpack(source):
        coder = Coder(shared.value)
        for batch in source:
            for r in batch.to_pylist():
                if zlib.crc32(r["payload"]) != r["crc_payload"]:
                    raise OSError(f"block {r['part']}/{r['block']} is damaged")
                ids = coder.decode(r["n_tokens"], r["lanes"], r["payload"], r["states"], r["at"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc_ids"]:
                    raise OSError(f"block {r['part']}/{r['block']} does not decode to its ids")
                lens = np.frombuffer(r["lens"], "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                keys = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["nulls"], np.uint8).astype(bool))
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lens, ends)]
                yield record(schema, keys, r["first"] + ends - lens, lens, crcs)

    return spark.read.schema(_FILE).parquet(f"{path}/blocks").mapInArrow(unpack, _ROWS)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_binary(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh folder of the shared store and give back what its files say."""
    spark = docs.sparkSession
    path = f"{scratch(spark)}/tokenbin-{uuid.uuid4().hex}"
    write(docs, path, vocab or vocabulary())
    return read(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_binary": query}
ORACLES: dict[str, str] = {}
