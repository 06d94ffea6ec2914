"""Byte-level BPE through the tokenizers library: texts to ids with byte and character offsets, and ids back to bytes and text.

A vocabulary of ranks becomes a BPE model of the library over characters that stand for bytes, one for each of the 256. The pair that makes a token is what merging its own
bytes by lower ranks ends in: a pair that meets elsewhere at that rank got there by the same merges, since no merge crossed its ends. A piece that is a token
as a whole is that token. Decoding goes the other way by a table from ids to bytes. Where a character's bytes lie in several tokens, each of these tokens spans that
character in the offsets, and the text is only read from bytes put together again.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.common import batches as cut_batches
from lexiquarry.llm.common import table

BATCH = 2 << 20  # characters of texts whose pieces are told apart together
TEXTS = 1 << 18  # bytes of text handed to the library at once, or one longer piece
KEPT = 1 << 18  # pieces whose ids are remembered
#: A space or line feed after anything but white space: a piece ends before it and one begins at it, whatever else the text holds.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others in turn from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging ``token`` by ranks below its own ends in; None where it ends in more, so that no merge makes it."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model(ranks: dict[bytes, int], pattern: str) -> str:
    """The library's own format of a tokenizer by ``ranks`` that reads each match of ``pattern`` alone; all 256 bytes must be tokens."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte-level vocabulary must hold every single byte")
    letters = byte_letters()
    named = lambda token: "".join(letters[b] for b in token)
    pairs = [p for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (p := last_pair(t, ranks))]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, bytewise]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
                  "ignore_merges": True, "vocab": {named(t): r for t, r in ranks.items()}, "merges": [[named(a), named(b)] for a, b in pairs]},
    })


@lru_cache(maxsize=2)
def _loaded(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


class ByteTable:
    """Every id's bytes, end to end, by reversing the character-for-byte table over a vocabulary in the library's format."""

    def __init__(self, text: str):
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = json.loads(text)["model"]["vocab"]
        held = {i: bytes(byte[c] for c in token) for token, i in vocab.items()}
        size = max(held, default=-1) + 1
        self.lens = np.zeros(size + 1, np.int64)  # the last one stands for ids that are not in the vocabulary
        self.lens[list(held)] = [len(b) for b in held.values()]
        self.known = np.zeros(size + 1, bool)
        self.known[list(held)] = True
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(held[i] for i in sorted(held)) or b"\0", np.uint8)

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(ids.astype(np.int64), len(self.lens) - 1)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 20):
            some = self.place(ids[at : at + (1 << 20)])
            lens = self.lens[some]
            ends = np.cumsum(lens)
            out.append(self.flat[np.repeat(self.starts[some] - ends + lens, lens) + np.arange(int(lens.sum()))].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _bytes(text: str) -> ByteTable:
    return ByteTable(text)


class Pieces:
    """Ids by the library, which sees each piece of the texts once as long as it is remembered.

    Texts are cut at safe places. New pieces go to the library many joined to one text: a piece that begins with a cut and ends in anything but white space is
    tokenised among others as it is alone, so its ids are those up to its last byte, by each id's bytes (``lens``). Other pieces, at the ends of texts, go alone. At
    most ``KEPT`` pieces are remembered, and those of one batch; then all are forgotten.
    """

    def __init__(self, tok, lens: np.ndarray):
        self.tok, self.lens = tok, lens
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def _learn(self, pieces: list[str]) -> None:
        joined, alone = [], []
        for p in pieces:
            (joined if p and p[0] in " \n" and not p[-1].isspace() else alone).append(p)
        upto = np.cumsum(np.array([len(p.encode()) for p in joined], np.int64))
        at = 0
        while at < len(joined):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + TEXTS, "right")))
            ids = np.array(self.tok.encode_batch_fast(["".join(joined[at:to])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.lens[ids]), upto[at:to] - before, "left") + 1
            self.ids.append(ids)
            self.counts.append(np.diff(ends, prepend=0))
            at = to
        for step in range(0, len(alone), 256):
            for e in self.tok.encode_batch_fast(alone[step : step + 256], add_special_tokens=False):
                self.ids.append(np.array(e.ids, np.uint32))
                self.counts.append(np.array([len(e.ids)], np.int64))
        n = len(self.known)
        self.known.update(zip([*joined, *alone], range(n, n + len(pieces))))
        self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        cut = [_SAFE.split(t) for t in texts]
        words = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        pieces = words.dictionary.to_pylist()
        if len(self.known) > KEPT:
            self._forget()
        self._learn([p for p in pieces if p not in self.known])
        counts, flat = self.counts[0], self.ids[0]
        mine = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[words.indices.to_numpy()]
        each, starts = counts[mine], (np.cumsum(counts) - counts)[mine]
        ends = np.cumsum(each)
        out = flat[np.repeat(starts - ends + each, each) + np.arange(int(ends[-1]))]
        return np.split(out, ends[np.cumsum([len(x) for x in cut])[:-1] - 1])


def in_turns(encode: Pieces, texts: Iterator[str]) -> Iterator[list[np.ndarray]]:
    """The ids of as many texts at once as make about ``BATCH`` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= BATCH:
            yield encode(held)
            held, n = [], 0
    yield encode(held)


def offsets(lens: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens of ``lens`` bytes over UTF-8 ``data``: byte ends, the character each begins in, and the end of the character it ends in."""
    heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    ends = np.cumsum(lens)
    return ends, heads[ends - lens] - 1 if len(ends) else ends, heads[ends - 1] if len(ends) else ends


class Codec:
    """Column functions over one vocabulary. The vocabulary (bounded by its size, about 3 MB for 50,000 tokens) is broadcast once."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self._shared = spark.sparkContext.broadcast(model(read_ranks(ranks_path), pattern))

    def ids(self, text: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers. A null text is read as the empty one, which has none. A text is read whole, however long."""
        shared = self._shared

        @F.arrow_udf("binary")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = Pieces(_loaded(shared.value), _bytes(shared.value).lens)
            for batch in batches:
                coded = in_turns(encode, (t.as_py() or "" for t in batch))
                yield pa.array((x.astype("<u4").tobytes() for some in coded for x in some), pa.binary(), size=len(batch))

        return encode(text)

    def spans(self, ids: Column) -> Column:
        """``array<struct<id, byte_start, byte_end, char_start, char_end>>`` of ids as :meth:`ids` gives them: where each token lies in its text.

        A token that holds part of a character spans that character. Null ids give null; ids without bytes of their own span nothing."""
        shared = self._shared
        kind = pa.struct([("id", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64())])

        def of(raw):
            at, known = np.frombuffer(raw, "<u4"), _bytes(shared.value)
            lens = known.lens[known.place(at)]
            some = lens > 0
            ends, first, last = offsets(lens[some], known.decode(at))
            out = np.zeros((len(at), 4), np.int64)
            out[some] = np.stack([ends - lens[some], ends, first, last], 1)
            return [dict(zip(("id", "byte_start", "byte_end", "char_start", "char_end"), r)) for r in np.column_stack([at, out]).tolist()]

        @F.arrow_udf("array<struct<id:bigint,byte_start:bigint,byte_end:bigint,char_start:bigint,char_end:bigint>>")
        def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([None if x is None else of(x) for x in batch.to_pylist()], pa.list_(kind))

        return place(ids)

    def bytes_of(self, ids: Column) -> Column:
        """The bytes of ids; null for null, nothing for an id outside the vocabulary."""
        shared = self._shared

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = _bytes(shared.value)
            for batch in batches:
                yield pa.array([None if x is None else known.decode(np.frombuffer(x, "<u4")) for x in batch.to_pylist()], pa.binary())

        return decode(ids)

    def text_of(self, ids: Column) -> Column:
        """The text of ids, their bytes read together; bytes that make no character, as at the edge of a cut list of ids, become U+FFFD."""
        shared = self._shared

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = _bytes(shared.value)
            for batch in batches:
                yield pa.array([None if x is None else known.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in batch.to_pylist()], pa.string())

        return decode(ids)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)`` for every row: its ids and the bytes they decode to.

    Null texts count as empty; empty texts have no ids and decode to nothing. Rows are read one by one: repeated rows and ids, null ids and further columns of any
    name change nothing, and there are no ties. A very long text goes to the library in parts, cut where no piece is cut. An empty table gives no rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model(read_ranks(ranks_path), pattern))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(source):
        known = _bytes(shared.value)
        encode = Pieces(_loaded(shared.value), known.lens)
        for batch in cut_batches(source, 1024, BATCH):
            coded = encode([t or "" for t in batch.column(1).to_pylist()])
            raw = [x.astype("<u4").tobytes() for x in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in coded], pa.int64()), pa.array(raw, pa.binary()), pa.array(map(known.decode, coded), pa.binary(), size=len(coded))], [id_col, "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    done = round_trip(table(spark, sf_dir, "documents"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": query}
ORACLES: dict = {}
