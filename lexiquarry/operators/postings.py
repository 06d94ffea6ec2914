"""A kept inverted index: postings written once, in buckets of terms and ranges of chunks, with what bounds a term's weight in each range.

A range is a few hundred chunks in the order they came in; what one term has in one range is a block, so the blocks of all terms line up by range. ``postings`` holds a
row for each block, with its occurrences packed, in folders by bucket of the term and sorted within. A batch of queries opens the folders of the buckets that its
terms fall in, and no others. For each query the bounds of a range's blocks sum to a bound on any BM25 score in that range; a search scores
the ranges of greatest bound first, and then those whose bound reaches the k-th score found, so the rest is passed over without loss. The blocks of a range meet in
one task, which adds up its chunks' scores and passes on each query's best only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiquarry.functions.text import tokens
from lexiquarry.session import delete, exists, free_shuffles, listing, materialise, rename, scratch, small

#: Names how an index is laid out; one of another layout is not opened.
FORMAT = 4
K1 = 1.5
B = 0.75
BUCKET = 20_000  # chunks for each bucket of terms
BUCKETS = 16, 4096  # at least and at most
RANGE = 256  # chunks of a range, 65,536 at most
LITERALS = 2_000  # asked terms up to which they are handed to the scan one by one
ABOUT = "format int, count long, average double, buckets int, filled array<int>, postings string"
#: One occurrence of a block: the chunk's place in its range, how often the term is there, the chunk's terms.
ENTRY = np.dtype([("place", "<u2"), ("tf", "<u4"), ("len", "<u4")])
SIDE = 2_048  # queries whose scores are added up at once


@dataclass
class Index:
    """``count`` chunks of ``average`` terms; ``path`` holds ``chunks``, ``postings``, and ``about``, which is written last."""

    spark: SparkSession
    path: str
    count: int
    average: float
    buckets: int
    filled: list[int]
    kind: StructType

    @property
    def places(self) -> DataFrame:
        """``(range, place, chunk_id, doc_id, position)`` of the chunks, as postings name them."""
        return self.spark.read.parquet(f"{self.path}/chunks").select("range.range", "range.place", "chunk_id", "doc_id", "position")

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks").drop("range")

    def ask(self, queries: DataFrame) -> Asked:
        """What the index has for ``queries (query_id, query)``; only the buckets of their terms are opened."""
        asked = materialise(queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("term")), "asked")
        terms = asked.select("term", _bucket("term", self.buckets).alias("b")).distinct()
        some = terms.limit(LITERALS + 1).collect()
        few = len(some) <= LITERALS
        wanted = {r.b for r in (some if few else terms.select("b").distinct().collect())}  # at most as many numbers as there are buckets
        at = [f"{self.path}/postings/bucket={b}" for b in self.filled if b in wanted]
        held = self.spark.read.schema(self.kind).parquet(*at) if at else self.spark.createDataFrame([], self.kind)
        if at:
            held = held.where(F.col("term").isin([r.term for r in some])) if few else held.join(small(terms), "term", "left_semi")
        df = held.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(float(self.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = small(materialise(asked.join(df, "term").select("query_id", "term", "df", idf.alias("idf")), "asked"))
        return Asked(rows, held, self.places, self.average, self.count)


@dataclass
class Asked:
    """``rows (query_id, term, df, idf)`` of the terms that occur, the asked terms' ``postings (term, range, n, total, ref, weight, entries)`` and the ``places (range, place, chunk_id, doc_id, position)`` of all chunks."""

    rows: DataFrame
    postings: DataFrame
    places: DataFrame
    average: float
    count: int

    @property
    def tops(self) -> DataFrame:
        """``(term, range, n, weight)``: the occurrences of a block, and a weight that none of them exceeds."""
        # w = 1 / (1 + K1 (1 - B + B len / average) / tf), where the part in brackets shrinks by ref / average at most
        most = (K1 + 1) / (1 + F.least(F.lit(1.0), F.col("ref") / F.lit(self.average or 1.0)) * (1 / F.col("weight") - 1))
        return self.postings.select("term", "range", "n", most.alias("weight"))

    def parts(self, hits: DataFrame) -> DataFrame:
        """``(query_id, chunk_id, term, len, part)`` of the asked terms in ``hits (query_id, chunk_id)``; pass materialised hits."""
        at = materialise(self.places.select("range", "place", "chunk_id").join(small(hits.select("chunk_id").distinct()), "chunk_id").join(small(hits.select("query_id", "chunk_id")), "chunk_id"), "at")
        held = self.postings.select("term", "range", "entries").join(small(at.select("range").distinct()), "range", "left_semi").join(self.rows, "term").join(small(at), ["query_id", "range"])
        one = held.select("query_id", "chunk_id", "term", "idf", _entry("entries", "place").alias("e")).where("e is not null").select("query_id", "chunk_id", "term", "idf", "e.tf", "e.len")
        return one.select("query_id", "chunk_id", "term", "len", (F.col("idf") * _weight(self.average)).alias("part"))

    def bounds(self) -> DataFrame:
        """``(query_id, range, most)``: no chunk of the range scores higher."""
        return self.tops.join(self.rows, "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("weight")).alias("most"))

    def best(self, ranges: DataFrame | None, k: int, per_doc: int, digits: int, docs: list | None = None) -> DataFrame:
        """``(query_id, chunk_id, doc_id, position, score)`` of chunks of ``ranges (query_id, range)`` or of all, of ``docs`` only if given: all that are among the ``k`` best of the query with at most ``per_doc`` of a document (0: any number), and few more.

        A task adds up the scores of its ranges one after the other and holds the best so far.
        """
        kept = lambda df: df
        if ranges is not None:
            some = small(ranges.select("range").distinct())
            kept = lambda df: df.join(some, "range", "left_semi")
        queries = self.rows.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list("query_id").alias("queries"))
        blocks = kept(self.postings.select("term", "range", "entries")).join(small(materialise(queries, "asking")), "term")
        places = self.places.where(F.col("doc_id").isin(docs)) if docs else self.places
        kinds = {c: t for c, t in (("place", "int"), ("idf", "double"), ("queries", f"array<{dict(self.rows.dtypes)['query_id']}>"), ("entries", "binary"), *((c, dict(self.places.dtypes)[c]) for c in ("chunk_id", "doc_id", "position")))}
        sides = [kept(places), blocks] + ([ranges.groupBy("range").agg(F.collect_set("query_id").alias("queries"))] if ranges is not None else [])
        shaped = [side.select("range", F.lit(i).alias("side"), *[(F.col(c) if c in side.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for i, side in enumerate(sides)]
        meet = reduce(DataFrame.unionByName, shaped).repartition("range").sortWithinPartitions("range", "side")
        out = StructType([self.rows.schema["query_id"], *(self.places.schema[c] for c in ("chunk_id", "doc_id", "position")), StructField("score", DoubleType())])
        average, whole = self.average, ranges is None
        return meet.mapInArrow(lambda source: _added(source, average, k, per_doc, digits, whole), out)


def _added(source, average: float, k: int, per_doc: int, digits: int, whole: bool):
    """The work of a task of :meth:`Asked.best`, over rows in the order of ranges: chunks, blocks, and the queries that want the range, unless all do (``whole``)."""
    held: list[pa.RecordBatch] = []
    pool: pa.Table | None = None
    fresh: list[pa.Table] = []
    count = 0
    least: pa.Table | None = None  # the k-th score of each query that has one

    def settle():
        nonlocal pool, fresh, count, least
        every = pa.concat_tables(([pool] if pool is not None else []) + fresh)
        every = every.take(pc.sort_indices(every, [("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("position", "ascending")], null_placement="at_start")).combine_chunks()
        code = lambda c: pc.dictionary_encode(every.column(c), null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64)
        query = code("query_id")
        if per_doc:
            keep = _rank(query << np.int64(32) | code("doc_id")) < per_doc
            every, query = every.filter(pa.array(keep)), query[keep]
        rank = _rank(query)
        least = every.filter(pa.array(rank == k - 1)).select(["query_id", "score"])
        pool, fresh, count = every.filter(pa.array(rank < k)), [], 0

    def score(rows: pa.Table):
        nonlocal count
        side = rows.column("side").to_numpy()
        chunks, blocks, wanted = (rows.filter(pa.array(side == i)) for i in range(3))
        if not len(chunks) or not len(blocks):
            return
        queries = pc.unique((blocks if whole else wanted).column("queries").combine_chunks().flatten())
        number = np.full(int(chunks.column("place").to_numpy().max()) + 1, -1)
        number[chunks.column("place").to_numpy()] = np.arange(len(chunks))
        lists, idf = blocks.column("queries").combine_chunks(), blocks.column("idf").to_numpy()
        asking = pc.fill_null(pc.index_in(lists.flatten(), queries), -1).to_numpy()
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        entries = [np.frombuffer(x.as_buffer(), ENTRY) for x in blocks.column("entries").combine_chunks()]
        floor = np.full(len(queries), -1.0)
        if least is not None:
            at = pc.index_in(queries, least.column("query_id"))
            has = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
            floor[has] = least.column("score").to_numpy()[at.take(pa.array(has)).to_numpy()]
        for first in range(0, len(queries), SIDE):
            sums = np.zeros((min(SIDE, len(queries) - first), len(chunks)))
            for i, e in enumerate(entries):
                q = asking[cuts[i] : cuts[i + 1]] - first
                q = q[(q >= 0) & (q < len(sums))] if len(queries) > SIDE else q[q >= 0]
                # a place beyond the chunks is one that ``docs`` leaves out
                e = e[e["place"] < len(number)]
                to = number[e["place"]]
                if (to < 0).any():
                    e, to = e[to >= 0], to[to >= 0]
                sums[q[:, None], to] += idf[i] * (e["tf"] * (K1 + 1) / (e["tf"] + K1 * (1 - B + B * (e["len"] / (average or 1.0)))))
            rounded = np.rint(sums * 10.0**digits) / 10.0**digits
            q, c = np.nonzero((sums > 0) & (rounded >= floor[first : first + SIDE, None]))
            if len(q):
                taken = chunks.take(pa.array(c))
                fresh.append(pa.table([queries.take(pa.array(q + first)), *[taken.column(x) for x in ("chunk_id", "doc_id", "position")], pa.array(rounded[q, c])], ["query_id", "chunk_id", "doc_id", "position", "score"]))
                count += len(q)
        if count > 1 << 16:
            settle()

    def ranges():
        now = None
        for batch in source:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            for s, e in zip(edges, edges[1:]):
                if at[s] != now and held:
                    yield pa.Table.from_batches(held)
                    held.clear()
                now = at[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    for rows in ranges():
        score(rows.combine_chunks())
    if count:
        settle()
    if pool is not None:
        yield from pool.to_batches()


def _rank(group: np.ndarray) -> np.ndarray:
    """How many earlier rows are of a row's group."""
    order = np.argsort(group, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], group[order[1:]] != group[order[:-1]]])[: len(order)])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return out


def _entry(entries: str, place: str) -> Column:
    """How often a block's term is in the chunk at ``place`` and that chunk's terms; null if it isn't there."""

    @F.arrow_udf("struct<tf:bigint,len:bigint>")
    def find(blocks: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for x, p in zip(blocks, places.to_pylist()):
            e = np.frombuffer(x.as_buffer(), ENTRY)
            e = e[e["place"] == p]
            out.append({"tf": int(e["tf"][0]), "len": int(e["len"][0])} if len(e) else None)
        return pa.array(out, pa.struct([("tf", pa.int64()), ("len", pa.int64())]))

    return find(F.col(entries), F.col(place))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weight(average: float) -> Column:
    norm = 1 - B + B * (F.col("len") / F.lit(average or 1.0))
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)


def _blocks(words: DataFrame) -> DataFrame:
    """``(term, range, n, total, ref, weight, entries)`` of ``words (range, place, t)``: a term's occurrences in a range, their number, the sum of their counts, and their greatest weight if ``ref`` were the average length. What a batch holds of a block is a row: chunks that lie apart may give several for one."""

    def run(source):
        for batch in source:
            lists = batch.column(2)
            lens, held = pc.list_value_length(lists).to_numpy(), pc.dictionary_encode(lists.flatten())
            if not len(held):
                continue
            size = max(1, len(held.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(lens)), lens) * size + held.indices.to_numpy(), return_counts=True)
            row, code = pair // size, pair % size
            ranges, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            block = code * len(ranges) + of[row]
            order = np.argsort(block, kind="stable")
            block, row, tf = block[order], row[order], tf[order]
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            entries = np.empty(len(row), ENTRY)
            entries["place"], entries["tf"], entries["len"] = batch.column(1).to_numpy()[row], tf, lens[row]
            ref = float(lens.mean())
            weight = tf / (tf + K1 * (1 - B + B * (lens[row] / ref)))
            offsets = pa.py_buffer((np.append(edge, len(row)) * ENTRY.itemsize).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    held.dictionary.take(pa.array(block[edge] // len(ranges))),
                    pa.array(ranges[block[edge] % len(ranges)], pa.int64()),
                    pa.array(np.diff(np.append(edge, len(row))), pa.int64()),
                    pa.array(np.add.reduceat(tf, edge), pa.int64()),
                    pa.array(np.full(len(edge), ref)),
                    pa.array(np.maximum.reduceat(weight, edge)),
                    pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, offsets, pa.py_buffer(entries)]),
                ],
                ["term", "range", "n", "total", "ref", "weight", "entries"],
            )

    return words.mapInArrow(run, "term string, range long, n long, total long, ref double, weight double, entries binary")


def _by_bucket(df: DataFrame, buckets: int, path: str) -> None:
    """Rows of one bucket side by side, sorted; a bucket that is too large for a task goes to several files."""
    df.withColumn("bucket", _bucket("term", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def write(chunks: DataFrame, path: str) -> Index:
    """Cut and read ``chunks (chunk_id, doc_id, position, text, ...)`` once and write their index to ``path``; an index that is there already stays and is opened."""
    spark = chunks.sparkSession
    free_shuffles(spark)
    made = f"{path}-{uuid.uuid4().hex}"
    number = F.monotonically_increasing_id()
    chunks.withColumn("range", F.struct(F.floor(number / RANGE).alias("range"), (number % RANGE).cast("int").alias("place"))).write.option("compression", "zstd").parquet(f"{made}/chunks")
    held = spark.read.parquet(f"{made}/chunks")
    count = held.count()
    buckets = min(max(BUCKETS[0], count // BUCKET), BUCKETS[1])
    blocks = _blocks(held.select("range.range", "range.place", tokens("text").alias("t")))
    _by_bucket(blocks, buckets, f"{made}/postings")
    filled = [x for x in listing(spark, f"{made}/postings") if "bucket=" in x]
    terms = spark.read.schema(blocks.schema).parquet(*filled).agg(F.sum("total")).first()[0] if filled else 0
    average = terms / count if count else 0.0
    about = (FORMAT, count, float(average), buckets, [int(p.rsplit("=", 1)[1]) for p in filled], blocks.schema.json())
    spark.createDataFrame([about], ABOUT).coalesce(1).write.json(f"{made}/about")
    if not rename(spark, made, path):
        delete(spark, made)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that :func:`write` made."""
    if not exists(spark, f"{path}/about"):
        raise FileNotFoundError(path)
    r = spark.read.schema(ABOUT).json(f"{path}/about").first()
    if r.format != FORMAT:
        raise ValueError(f"{path} is laid out in another way; write it anew")
    return Index(spark, path, r["count"], r["average"], r["buckets"], list(r.filled or []), StructType.fromJson(json.loads(r.postings)))


def keep(spark: SparkSession, path: str, chunks) -> Index:
    """The index at ``path``; if there is none yet, one of ``chunks()`` is written there."""
    return open_index(spark, path) if exists(spark, f"{path}/about") else write(chunks(), path)


def index(chunks: DataFrame) -> Index:
    """An index in the scratch folder, for one use."""
    return write(chunks, f"{scratch(chunks.sparkSession)}/index-{uuid.uuid4().hex}")
