"""SimHash near-duplicates: fingerprints of word shingles, linked through Burkhard-Keller trees.

Every document gets a 64-bit fingerprint. Equal fingerprints fold into one class before anything is compared, so
copies cost nothing. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks (or, on more
blocks, on several), so distinct fingerprints meet in shards keyed by block values; each shard holds a tree whose children
are keyed by their Hamming distance to the parent, and a search follows only edges within the radius. A shard gives one link from each member to its group, never
all pairs. Shards that would be too large are cut again by blocks of the bits left, which loses no link.

The trees are not broadcast: together they grow with the corpus. Each is built in the task its members are sent to.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.graph import components
from lexiquarry.llm.common import batches, record, table
from lexiquarry.session import free_shuffles, materialise, small

RADIUS = 4
SHINGLE = 4
LEAF = 128  # members of a tree node under which they are compared as one matrix
SHARD = 4096  # distinct fingerprints that a shard holds on average at most
HOT = 20_000  # ... and a single one, before it is cut again

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text: bit i is set where over half the shingles' XXH64 (seed 42) have it set."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        got = np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())), "<u8", to - at)
        total += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(source):
        for batch in batches(source):
            yield record(schema, batch.column(0), np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """``classes (fp, low)`` with ``root``, the least fingerprint reachable."""
    roots = components(links(classes, classes.count(), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return materialise(named, "named")


class Groups:
    """Group labels of one shard's members: always the least index, always flat."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, one: int, many: np.ndarray) -> None:
        labels = self.label[many]
        low = min(int(labels.min()), int(self.label[one]))
        if (labels != low).any() or self.label[one] != low:
            old = np.unique(np.append(labels, self.label[one]))
            self.label[np.isin(self.label, old)] = low


class Tree:
    """A bulk-loaded Burkhard-Keller tree over distinct fingerprints."""

    def __init__(self, values: np.ndarray, members: np.ndarray | None = None):
        self.values = values
        members = np.arange(len(values)) if members is None else members
        self.children: dict[int, Tree] = {}
        self.leaf = members if len(members) <= LEAF else None
        if self.leaf is None:
            self.root, rest = int(members[0]), members[1:]
            apart = np.bitwise_count(values[rest] ^ values[self.root])
            self.children = {int(d): Tree(values, rest[apart == d]) for d in np.unique(apart)}

    def link(self, queries: np.ndarray, radius: int, groups: Groups) -> None:
        """Put each query into one group with all members within the radius."""
        if not len(queries):
            return
        if self.leaf is not None:
            for at in range(0, len(queries), 1024):
                some = queries[at : at + 1024]
                near = np.bitwise_count(self.values[some][:, None] ^ self.values[self.leaf][None, :]) <= radius
                near &= groups.label[some][:, None] != groups.label[self.leaf][None, :]
                for row in np.flatnonzero(near.any(1)):
                    groups.join(int(some[row]), self.leaf[near[row]])
            return
        apart = np.bitwise_count(self.values[queries] ^ self.values[self.root]).astype(np.int64)
        close = queries[apart <= radius]
        if len(close):
            groups.join(self.root, close)
        for d, child in self.children.items():
            child.link(queries[np.abs(apart - d) <= radius], radius, groups)


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member of its group) among a shard's distinct signed fingerprints."""
    values = np.sort(values)
    if len(values) < 2:
        return values[:0], values[:0]
    groups = Groups(len(values))
    tree = Tree(values.view(np.uint64))
    tree.link(np.arange(len(values)), radius, groups)
    out = np.flatnonzero(groups.label != np.arange(len(values)))
    return values[out], values[groups.label[out]]


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` blocks of a ``bits`` wide number: (shift, width)."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(fp, cuts: list[tuple[int, int]], agree: int):
    """An array of shard keys: one for each choice of ``agree`` blocks, of their place and values."""
    block = lambda s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))
    return F.array(*[F.xxhash64(F.lit(i), *[block(*c) for c in some]) for i, some in enumerate(combinations(cuts, agree))])


def links(classes: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect every two of ``n`` distinct ``fp`` values within ``radius`` bits, through few rows: those of one group in a shard name its least member.

    ``classes`` holds each fingerprint once and no null; one fingerprint, or none, gives no links.
    """
    parts = radius + 1
    while parts < 4 * (radius + 1) and n / 2 ** (64 * (parts - radius) / parts) > SHARD and comb(parts + 1, radius) <= 1000:
        parts += 1
    fp = F.col("fp")
    keyed = classes.select("fp", F.explode(_keys(fp, _cuts(64, parts), parts - radius)).alias("key"))
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hotshards")
    if hot.limit(1).count():
        # a second pigeonhole inside these shards: of radius + 2 blocks at least two agree
        fine = keyed.join(small(hot), "key", "left_semi").select("fp", F.explode(_keys(fp, _cuts(64, radius + 2), 2)).alias("k2"), "key").select("fp", F.xxhash64("key", "k2").alias("key"))
        keyed = keyed.join(small(hot), "key", "left_anti").select("fp", "key").unionByName(fine)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        held, key = [], None
        out_a, out_b = [], []
        for batch in source:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if key is not None and keys[s] != key:
                    a, b = shard_links(np.concatenate(held), radius)
                    out_a.append(a)
                    out_b.append(b)
                    held = []
                key = keys[s]
                held.append(fps[s:e])
            if out_a:
                yield record(schema, np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [], []
        if held:
            yield record(schema, *shard_links(np.concatenate(held), radius))

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows that repeat an id each give a row. Null ids
    are kept but never name a component (one of null ids only has a null id). No rows give no rows.
    """
    free_shuffles(docs.sparkSession)
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    named = _rooted(classes, radius)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    member = materialise(named.join(lows, "root").select(F.col("fp").alias("of"), "component_id"), "members")
    return prints.join(member, prints.fp == member.of).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with its columns renamed and ``(f, r)``, which names a row: its file and its number there, or, if ``docs`` is not read straight from files, a number in a copy."""
    renamed = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns)]
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*renamed, F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
        except AnalysisException:
            pass
    return materialise(docs.select(*renamed, F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r")), "placed")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near-duplicates, all columns unchanged: the row of the smallest id.

    Rows count, not ids: different texts of one id are judged apart, copies under one id or without an id leave one row, and a row
    without an id stays only if its group has no row with one. Among rows of the smallest id the least fingerprint, then text hash, stays; of rows equal in
    all that, any one. Null and wordless texts are one group (fingerprint zero). Columns may have any names. No rows give no rows.

    Texts are shuffled once, by the rows' own places, so no key is hot; what stays is joined and never broadcast, since it grows with the corpus.
    """
    free_shuffles(docs.sparkSession)
    columns = [f"c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, columns))
    rows = _placed(docs, columns)
    names = ("f", "r", "i", "h", "fp")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(source):
        for batch in batches(source):
            got = np.array([fingerprint(t, shingle) for t in batch.column(4).to_pylist()], np.uint64).view(np.int64)
            yield record(schema, *batch.columns[:4], got)

    text = F.col(at[text_col]).cast("string")
    prints = rows.select("f", "r", F.col(at[id_col]).cast("long").alias("i"), F.xxhash64(text).alias("h"), text.alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    classes = prints.groupBy("fp").agg(F.min(F.struct(F.col("i").isNull().alias("nameless"), "i", "fp", "h", "f", "r")).alias("low"))
    named = _rooted(materialise(classes, "classes"), radius)
    kept = materialise(named.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.f").alias("f"), F.col("low.r").alias("r")), "kept")
    return rows.join(kept.hint("merge"), ["f", "r"], "left_semi").select(columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": query}
ORACLES: dict[str, str] = {}
