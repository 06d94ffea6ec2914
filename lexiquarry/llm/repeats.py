"""The passes over a corpus that find its repeated windows, on top of :mod:`lexiquarry.llm.anchors`.

1. Every text is parsed into phrases; those whose triggers may be repeated are kept, by counts of the triggers or where the triggers meet (:func:`shared`).
2. Phrases with such triggers are written out, and folded into a dictionary of distinct phrases.
3. Where different phrases share a trigger, one copy of each goes to a shard with the others, and their windows are compared.
4. The verdicts go back to the phrases' places, and from there to the texts.

All groupings combine before they are shuffled, all joins are equi-joins that adaptive execution can split, and the windows of triggers with very many
different phrases are compared as rows of their own, dealt out by the windows' hashes. Nothing is collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm import anchors
from lexiquarry.llm.common import batches, record
from lexiquarry.session import discard, free_shuffles, materialise, small

SHARD = 200  # different phrases of one trigger that are compared in one shard; with more, windows are dealt out one by one


@dataclass(frozen=True)
class Kind:
    """What is compared: ``units`` makes them, ``content`` gives a phrase's windows for comparison, ``compare`` sorts them."""

    window: int
    gram: int
    units: Callable
    content: Callable
    compare: Callable


def _bytes(column) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in column.to_pylist()]


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, th, t)``: id, a hash that tells rows of one id apart (0 where the id is unique), text. Rows alike in both get the same verdicts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc"))
    shared = materialise(ids.groupBy("doc").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc").alias("d1"), F.lit(True).alias("shared")), "sharedids")
    if not shared.limit(1).count():
        return rows.select("doc", F.lit(0).cast("long").alias("th"), "t")
    marked = rows.join(small(shared), F.col("doc").eqNullSafe(F.col("d1")), "left")
    return marked.select("doc", F.when(F.col("shared"), F.xxhash64("t")).otherwise(0).alias("th"), "t")


def phrases(rows: DataFrame, kind: Kind) -> DataFrame:
    """``(key, digest, at, doc, th)`` of every run of windows, where ``at`` is 128 * start + count: one number, beside what varies as much, shuffles in fewer bytes."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("at", pa.int64()), ("doc", pa.int64()), ("th", pa.int64())])

    def run(source):
        for batch in batches(source):
            got = anchors.runs(*kind.units(_bytes(batch.column(2))), kind.window, kind.gram)
            owner = pa.array(got.doc)
            yield record(schema, got.key.view(np.int64), got.digest.view(np.int64), got.start.astype(np.int64) * 128 + got.count.astype(np.int64), batch.column(0).take(owner), batch.column(1).take(owner))

    return rows.select("doc", "th", "t").mapInArrow(run, "key long, digest long, at long, doc long, th long")


_FOUND = "key long, doc long, th long, start int, count int, digest long"
_FIELDS = (("key", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("start", "<u4"), ("count", "u1"))
BUCKET = 16 << 20  # bytes of text for which a bucket more is taken


def packed(*columns: np.ndarray) -> bytes:
    """The columns of ``_FIELDS``, by planes of bytes: those of small numbers compress to next to nothing."""
    return b"".join(np.ascontiguousarray(c.astype(kind).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, (_, kind) in zip(columns, _FIELDS))


def unpacked(entries: bytes) -> list[np.ndarray]:
    wide = [np.dtype(kind).itemsize for _, kind in _FIELDS]
    n, at, out = len(entries) // sum(wide), 0, []
    for size, (_, kind) in zip(wide, _FIELDS):
        out.append(np.ascontiguousarray(np.frombuffer(entries, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def shared(rows: DataFrame, kind: Kind) -> DataFrame:
    """``(key, doc, th, start, count, digest)`` of the phrases whose triggers several documents hold; texts are parsed once and phrases shuffled once.

    Phrases meet by their triggers in buckets, packed as many as a batch has for each. A trigger that two documents of a batch hold is known to be
    shared: its phrases are dealt out evenly, and its bucket is told of it. So a bucket gets one document's phrases of a trigger from each batch at most, however frequent the trigger is.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    block = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("entries", pa.binary())])

    def deal(source):
        for batch in batches(source, rows=8192):
            got = anchors.runs(*kind.units(_bytes(batch.column(2))), kind.window, kind.gram)
            if not len(got.key):
                continue
            doc, th = (batch.column(i).to_numpy()[got.doc] for i in (0, 1))
            order = np.lexsort((doc, got.key))
            key, who = got.key[order], doc[order]
            same = key[1:] == key[:-1]
            marks = np.unique(key[1:][same & (who[1:] != who[:-1])])
            known = np.isin(got.key, marks)
            every = (got.key, got.digest, doc, th, got.start, got.count)
            to = (got.key % np.uint64(blocks)).astype(np.int64)
            out = []
            rest = np.flatnonzero(~known)
            rest = rest[np.argsort(to[rest], kind="stable")]
            edges = np.searchsorted(to[rest], np.arange(blocks + 1)).tolist()
            out += [(i, False, packed(*(c[rest[edges[i] : edges[i + 1]]] for c in every))) for i in range(blocks) if edges[i + 1] > edges[i]]
            # a count of 0 marks a trigger that is known without a phrase of its own
            told = (marks % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(told, kind="stable")
            marks, told = marks[order], told[order]
            edges = np.searchsorted(told, np.arange(blocks + 1)).tolist()
            for i in range(blocks):
                if edges[i + 1] > edges[i]:
                    none = np.zeros(edges[i + 1] - edges[i], np.int64)
                    out.append((i, False, packed(marks[edges[i] : edges[i + 1]], none, none, none, none, none)))
            some = np.flatnonzero(known)
            for at in range(0, len(some), 4096):
                out.append((zlib.crc32(b"%d" % int(some[at]) + got.key[some[at]].tobytes()) % blocks, True, packed(*(c[some[at : at + 4096]] for c in every))))
            yield record(block, *map(list, zip(*out)))

    found = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("digest", pa.int64())])

    def rows_of(key, digest, doc, th, start, count):
        return record(found, key.view(np.int64), doc, th, start.astype(np.int32), count.astype(np.int32), digest.view(np.int64))

    def settle(held):
        key, digest, doc, th, start, count = (np.concatenate(c) for c in zip(*map(unpacked, held)))
        order = np.lexsort((doc, key))
        key, doc, count = key[order], doc[order], count[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        several = np.zeros(int(number[-1]) + 1, bool)
        several[number[count == 0]] = True
        several[number[1:][~new[1:] & (doc[1:] != doc[:-1])]] = True
        keep = np.flatnonzero(several[number] & (count > 0))
        pick = order[keep]
        return rows_of(key[keep], digest[pick], doc[keep], th[pick], start[pick], count[keep])

    def meet(source):
        held, now = [], None
        for batch in source:
            for to, known, entries in zip(*(c.to_pylist() for c in batch.columns)):
                if to != now and held:
                    yield settle(held)
                    held = []
                now = to
                if known:
                    yield rows_of(*unpacked(entries))
                else:
                    held.append(entries)
        if held:
            yield settle(held)

    dealt = rows.select("doc", "th", "t").mapInArrow(deal, "bucket int, known boolean, entries binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, _FOUND)


def verdicts(rows: DataFrame, found: DataFrame, kind: Kind, by_count: bool) -> DataFrame:
    """``(key, digest, lo, n, mask)`` of the dictionary's phrases; ``mask`` flags the windows that other phrases hold too.

    ``by_count``: a window is flagged if any other phrase holds it; else only if one of a smaller document does.
    """
    entries = found.groupBy("key", "digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"), F.min(F.struct("doc", "th", "start", "count")).alias("at"))
    entries = materialise(entries, "dictionary")
    several = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "k")
    contested = entries.join(several, F.col("key") == F.col("k")).select("key", "digest", "lo", "n", "at", F.ceil(F.col("c") / SHARD).cast("int").alias("shards"))
    wanted = contested.groupBy("at.doc", "at.th").agg(F.collect_list(F.struct("key", "digest", "lo", "n", "at.start", "at.count", "shards")).alias("p"))
    wanted = materialise(wanted.withColumnsRenamed({"doc": "d2", "th": "th2"}), "wanted")
    texts = wanted.join(rows, F.col("doc").eqNullSafe(F.col("d2")) & F.col("th").eqNullSafe(F.col("th2"))).select("t", "p")
    out = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("place", pa.int32()), ("digest", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("count", pa.int32()), ("content", pa.binary())])

    def fetch(source):
        for batch in batches(source, rows=64):
            texts, lists = _bytes(batch.column(0)), batch.column(1)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            p = lists.flatten()
            get = {f.name: p.field(i) for i, f in enumerate(p.type)}
            start, count, shards = (get[c].to_numpy().astype(np.int64) for c in ("start", "count", "shards"))
            # each phrase is a row; those of hot triggers are a row for each window
            parts = np.where(shards > 1, count, 1)
            at = np.repeat(np.arange(len(parts)), parts)
            place = anchors.spread(np.zeros(len(parts), np.int64), parts)
            size = np.where(shards > 1, 1, count)[at]
            content = kind.content(texts, owner[at], start[at] + place, size, kind.window)
            shard = [zlib.crc32(c) % n if n > 1 else 0 for c, n in zip(content, shards[at].tolist())]
            pick = lambda c: get[c].take(pa.array(at))
            yield record(out, pick("key"), np.array(shard, np.int32), place.astype(np.int32), pick("digest"), pick("lo"), pick("n"), size.astype(np.int32), pa.array(content, pa.binary()))

    result = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("mask", pa.int64())])

    def compare(source):
        # a partition's shards are sorted together: its size is bounded by the shuffle's
        held = pa.Table.from_batches(list(source), schema=out) if source else None
        if held is None or not held.num_rows:
            return
        held = held.combine_chunks()
        key, first, digest, n, count = (held.column(c).to_numpy() for c in ("key", "place", "digest", "n", "count"))
        lo = held.column("lo").fill_null(np.iinfo(np.int64).max).to_numpy()
        content = held.column("content").chunk(0)
        owner = np.repeat(np.arange(len(key)), count)
        place = anchors.spread(first.astype(np.int64), count.astype(np.int64))
        group = kind.compare(content, key, count.astype(np.int64), kind.window)
        size = int(group.max()) + 1
        # one phrase may hold a window twice: the phrase's count stands for each
        if by_count:
            total = np.zeros(size, np.int64)
            np.add.at(total, group, n[owner])
            flag = total[group] > 1
        else:
            least = np.full(size, np.iinfo(np.int64).max)
            np.minimum.at(least, group, lo[owner])
            flag = least[group] < lo[owner]
        mask = np.zeros(len(key), np.uint64)
        np.bitwise_or.at(mask, owner[flag], np.uint64(1) << place[flag].astype(np.uint64))
        keep = np.flatnonzero(mask)
        yield record(result, key[keep], digest[keep], mask[keep].view(np.int64))

    fetched = texts.mapInArrow(fetch, "key long, shard int, place int, digest long, lo long, n long, count int, content binary")
    flagged = fetched.repartition("key", "shard").mapInArrow(compare, "key long, digest long, mask long").groupBy("key", "digest").agg(F.bit_or("mask").alias("mask")).toDF("k", "g", "mask")
    flagged = materialise(flagged, "flagged")  # with this, the texts and phrases that were shuffled for it go
    settled = entries.join(flagged, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("g")), "left").select("key", "digest", "lo", "n", F.coalesce("mask", F.lit(0)).alias("mask"), "hi")
    settled = materialise(settled.where(((F.col("n") > 1) if by_count else (F.col("hi") > F.col("lo"))) | (F.col("mask") != 0)).drop("hi"), "verdicts")
    for done in (entries, wanted, flagged):
        discard(done)
    return settled


def removals(rows: DataFrame, repeated: Callable[[DataFrame], DataFrame] | None, kind: Kind, by_count: bool) -> DataFrame:
    """``(doc, th, t, starts, masks)`` for every row: where its flagged windows lie. ``repeated`` filters the phrases; without it, those are taken whose triggers several documents hold."""
    spark = rows.sparkSession
    free_shuffles(spark)
    if repeated is None:
        found = shared(rows.where("doc is not null"), kind)
    else:
        places = (F.shiftright("at", 7).cast("int").alias("start"), F.col("at").bitwiseAND(F.lit(127)).cast("int").alias("count"))
        found = repeated(phrases(rows, kind)).select("key", "doc", "th", *places, "digest")
    found = materialise(found, "phrases")
    settled = verdicts(rows, found, kind, by_count).toDF("k", "g", "lo", "n", "mask")
    every = F.col("n") > 1 if by_count else F.col("doc") > F.col("lo")
    windows = F.expr("shiftleft(1L, `count`) - 1")
    hits = found.join(settled, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("g"))).select("doc", "th", "start", F.when(every, windows).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    spans = hits.groupBy("doc", "th").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks")).withColumnsRenamed({"doc": "d2", "th": "th2"})
    spans = materialise(spans, "removals")
    discard(found)
    return rows.join(spans, F.col("doc").eqNullSafe(F.col("d2")) & F.col("th").eqNullSafe(F.col("th2")), "left").select("doc", "t", "starts", "masks")
