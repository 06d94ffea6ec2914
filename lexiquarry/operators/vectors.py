"""Exact vector search over kept blocks with bounds.

Vectors are dealt to cells around a bounded sample of them and cut into blocks. A block knows its direction (that of its mean), how far its vectors reach along it, and how
far they stray from it; so no inner product with a query exceeds what the query's parts along and across that direction can make of these. A query first
scores the blocks of greatest bound, which gives a score that its k-th hit has at least, and then only blocks whose bound reaches it. Queries are a table: they meet
blocks by a key of shard and part, each side repeated for the other's number of them, and never pass through the driver.
"""

from __future__ import annotations

import uuid
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.session import delete, exists, materialise, rename, scratch

CENTRES = 1024  # vectors that cells are made around, at most
SIZE = 512  # vectors of a block, on average
SHARD = 64 * SIZE  # vectors that meet a part of the queries in one task, on average
PART = 2048  # queries of a part, on average
SEEDS = 2  # blocks that a query scores before it passes over others
ENTRIES = 1 << 21  # scores held before the least are dropped


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat) else 0)


def usable(embedding: str = "embedding"):
    """Neither null nor with a null or non-finite component."""
    return F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def pack(vectors: DataFrame) -> DataFrame:
    """``vectors (chunk_id, doc_id, position, embedding)`` as blocks; all usable ones must have equally many components."""
    rows = vectors.where(usable()).select("chunk_id", "doc_id", "position", F.col("embedding").cast("array<double>").alias("v"))
    n = rows.count()
    some = rows.select("v").orderBy(F.xxhash64("chunk_id", "v")).limit(min(CENTRES, max(1, isqrt(n)))).collect()  # at most CENTRES vectors
    centres = np.array([r.v for r in some], np.float64)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ids = ", ".join(f"{c} {kinds[c]}" for c in ("chunk_id", "doc_id", "position"))

    def place(source):
        for batch in source:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = _matrix(part.column("v"))
                cell = np.argmin((centres**2).sum(1)[None, :] - 2 * (v @ centres.T), axis=1) if v.size else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], [*part.schema.names, "cell"])

    placed = materialise(rows.mapInArrow(place, f"{ids}, v array<double>, cell int"), "placed", "lz4")
    cuts = placed.groupBy("cell").agg(F.ceil(F.count("*") / SIZE).alias("cuts"))  # at most CENTRES rows
    dealt = placed.join(F.broadcast(cuts), "cell").withColumn("cut", F.pmod(F.xxhash64("chunk_id", "doc_id", "position"), F.col("cuts")))

    def block(key, table):
        v = _matrix(table.column("v"))
        mean = v.mean(0)
        length = np.sqrt((mean**2).sum())
        way = mean / length if length > 0 else mean
        along = v @ way
        across = np.sqrt(np.maximum(0.0, (v**2).sum(1) - along**2))
        one = lambda c: pa.array([table.column(c).combine_chunks().to_pylist()], pa.list_(table.schema.field(c).type))
        row = [pa.array([f"{key[0].as_py()}-{key[1].as_py()}"]), pa.array([len(v)], pa.int32()), pa.array([way.tobytes()], pa.binary()), pa.array([along.min()]), pa.array([along.max()]), pa.array([across.max()])]
        return pa.table([*row, *(one(c) for c in ("chunk_id", "doc_id", "position")), pa.array([v.tobytes()], pa.binary())], names=["block", "n", "way", "low", "high", "across", "chunk_ids", "doc_ids", "positions", "vectors"])

    out = f"block string, n int, way binary, low double, high double, across double, chunk_ids array<{kinds['chunk_id']}>, doc_ids array<{kinds['doc_id']}>, positions array<{kinds['position']}>, vectors binary"
    return dealt.select("cell", "cut", "chunk_id", "doc_id", "position", "v").groupBy("cell", "cut").applyInArrow(block, out)


def write(vectors: DataFrame, path: str) -> DataFrame:
    """Blocks of ``vectors`` at ``path``; those that are there already stay."""
    spark = vectors.sparkSession
    made = f"{path}-{uuid.uuid4().hex}"
    pack(vectors).write.parquet(made)
    if not rename(spark, made, path):
        delete(spark, made)
    return spark.read.parquet(path)


def keep(spark: SparkSession, path: str, vectors) -> DataFrame:
    """The blocks at ``path``; if there are none yet, those of ``vectors()`` are written there."""
    return spark.read.parquet(path) if exists(spark, path) else write(vectors(), path)


def blocks(vectors: DataFrame) -> DataFrame:
    """``vectors`` as blocks in the scratch folder, for one use; blocks are taken as they are."""
    return vectors if "way" in vectors.columns else write(vectors, f"{scratch(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}")


def _bounds(table: pa.Table, q: np.ndarray) -> np.ndarray:
    """Blocks x queries: what no inner product exceeds."""
    width = q.shape[1]
    way = np.frombuffer(b"".join(table.column("way").to_pylist()), np.float64).reshape(-1, width)
    low, high, across = (table.column(c).to_numpy()[:, None] for c in ("low", "high", "across"))
    along, length = way @ q.T, (q**2).sum(1)
    return np.maximum(along * low, along * high) + np.sqrt(np.maximum(0.0, length[None, :] - along**2)) * across + 1e-9 * (1 + np.sqrt(length))[None, :]


def _trim(q: np.ndarray, row: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int, per_doc: int) -> np.ndarray:
    """Which entries can be among the k best of their query, at most ``per_doc`` of a document; rows come in the order that breaks ties."""
    order = np.lexsort((row, -score, q))

    def nth(*keys) -> np.ndarray:  # the place of each entry among those with its keys, in order
        by = np.lexsort((np.arange(len(order)), *keys))
        new = np.ones(len(by), bool)
        new[1:] = np.any([k_[by][1:] != k_[by][:-1] for k_ in keys], axis=0)
        at = np.arange(len(by))
        out = np.empty(len(by), np.int64)
        out[by] = at - np.maximum.accumulate(np.where(new, at, 0))
        return out

    if per_doc and len(order):
        order = order[nth(doc[row[order]], q[order]) < per_doc]
    return order[nth(q[order]) < k] if len(order) else order


def _search(table: pa.Table, ids: pa.Array, q: np.ndarray, least: np.ndarray, k: int, per_doc: int, digits: int) -> pa.Table:
    """``(query_id, chunk_id, doc_id, position, score)`` of the blocks' vectors that can be hits of the queries, those under ``least`` left out."""
    flat = lambda c: pa.concat_arrays([x.values for x in table.column(c)]) if table.num_rows else pa.array([])
    chunk, doc, position = flat("chunk_ids"), flat("doc_ids"), flat("positions")
    code = np.unique(doc.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    rank = np.empty(len(code), np.int64)
    rank[np.lexsort((position.to_numpy(zero_copy_only=False), code))] = np.arange(len(code))
    by_rank = np.argsort(rank)
    code = code[by_rank]
    start = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())])
    bound = np.round(_bounds(table, q), digits)
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for b in np.argsort(-bound.max(axis=1), kind="stable").tolist():
        asks = np.flatnonzero(bound[b] >= least)
        if not len(asks):
            continue
        v = np.frombuffer(table.column("vectors")[b].as_buffer(), np.float64).reshape(-1, q.shape[1])
        got = np.round(v @ q[asks].T, digits)
        r, j = np.nonzero(got >= least[asks])
        new = [asks[j], rank[start[b] + r], got[r, j]]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) > ENTRIES:
            some = _trim(*held, code, k, per_doc)
            held = [x[some] for x in held]
    some = _trim(*held, code, k, per_doc)
    rows = pa.array(by_rank[held[1][some]])
    return pa.table([ids.take(pa.array(held[0][some])), chunk.take(rows), doc.take(rows), position.take(rows), pa.array(held[2][some])], names=["query_id", "chunk_id", "doc_id", "position", "score"])


def _meet(blocks_: DataFrame, queries: DataFrame, shards: int, parts: int, run, out: str) -> DataFrame:
    """``run(blocks, queries)`` for every shard of blocks and part of queries; both sides repeat for the other, and meet by key.

    Keys are of one type on both sides: a cogroup deals each side by its own, and equal numbers of two types lie in different partitions.
    """
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard")
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    left = blocks_.select(shard, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "*")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part, "*")
    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, out)


def _sizes(blocks_: DataFrame, queries: DataFrame) -> tuple[int, int]:
    n = blocks_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(1, -(-n // SHARD)), max(1, -(-queries.count() // PART))


def _thresholds(blocks_: DataFrame, queries: DataFrame, k: int, per_doc: int, digits: int, shards: int, parts: int) -> DataFrame:
    """``queries (query_id, q)`` with ``least``: the k-th score within each query's blocks of greatest bound; null where these hold fewer."""
    from lexiquarry.operators.search import capped

    kind = queries.schema["query_id"].dataType.simpleString()

    def seeds(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], right.schema.field("query_id").type), pa.array([], pa.string()), pa.array([], pa.float64())], names=["query_id", "block", "bound"])
        bound = _bounds(left, _matrix(right.column("q"))).T
        top = np.argsort(-bound, axis=1, kind="stable")[:, :SEEDS]
        who = np.repeat(np.arange(len(bound)), top.shape[1])
        return pa.table([right.column("query_id").take(pa.array(who)), left.column("block").take(pa.array(top.ravel())), pa.array(bound[who, top.ravel()])], names=["query_id", "block", "bound"])

    heads = blocks_.select("block", "way", "low", "high", "across")
    found = _meet(heads, queries, shards, parts, seeds, f"query_id {kind}, block string, bound double")
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).where(F.col("_n") <= SEEDS)
    asked = materialise(first.select("query_id", "block").join(queries, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))), "seeds")
    wanted = blocks_.join(asked.select("block", (F.col("part") + 0).alias("part")).distinct(), "block")
    hits = wanted.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_scorer(k, per_doc, digits, _kinds(blocks_)), _out(blocks_, kind))
    reached = capped(hits, k, per_doc).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return materialise(queries.join(reached, "query_id", "left"), "thresholds")


def _kinds(blocks_: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in blocks_.schema}
    return [kinds[c][6:-1] for c in ("chunk_ids", "doc_ids", "positions")]


def _out(blocks_: DataFrame, kind: str) -> str:
    return "query_id {}, chunk_id {}, doc_id {}, position {}, score double".format(kind, *_kinds(blocks_))


def _scorer(k: int, per_doc: int, digits: int, kinds: list[str]):
    def score(left, right):
        if not left.num_rows or not right.num_rows:
            ids = [right.schema.field("query_id").type, *(left.schema.field(c).type.value_type for c in ("chunk_ids", "doc_ids", "positions"))]
            return pa.table([pa.array([], t) for t in [*ids, pa.float64()]], names=["query_id", "chunk_id", "doc_id", "position", "score"])
        least = right.column("least").to_numpy(zero_copy_only=False).astype(np.float64) if "least" in right.schema.names else np.full(right.num_rows, -np.inf)
        least = np.where(np.isnan(least), -np.inf, least)
        return _search(left, right.column("query_id").combine_chunks(), _matrix(right.column("q")), least, k, per_doc, digits)

    return score


def search(blocks_: DataFrame, queries: DataFrame, k: int, per_doc: int, digits: int) -> DataFrame:
    """Candidates ``(query_id, chunk_id, doc_id, position, score)``, the hits of each query among them."""
    asked = materialise(queries.where(usable()).select("query_id", F.col("embedding").cast("array<double>").alias("q")), "asked")
    shards, parts = _sizes(blocks_, asked)
    kind = asked.schema["query_id"].dataType.simpleString()
    # vectors that all meet in one task are ranked there; a threshold is worth its passes where shards would each keep their own k best
    ready = _thresholds(blocks_, asked, k, per_doc, digits, shards, parts) if shards > 1 else asked
    return _meet(blocks_, ready, shards, parts, _scorer(k, per_doc, digits, _kinds(blocks_)), _out(blocks_, kind))


def blocks_read(blocks_: DataFrame, queries: DataFrame, k: int = 5, per_doc: int = 2, digits: int = 5) -> DataFrame:
    """``(query_id, blocks, read)``: how many blocks there are, and how many of them :func:`search` scores for each query."""
    asked = materialise(queries.where(usable()).select("query_id", F.col("embedding").cast("array<double>").alias("q")), "asked")
    shards, parts = _sizes(blocks_, asked)
    ready = _thresholds(blocks_, asked, k, per_doc, digits, shards, parts)
    kind = asked.schema["query_id"].dataType.simpleString()

    def count(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], right.schema.field("query_id").type), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["query_id", "blocks", "read"])
        least = right.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        bound = np.round(_bounds(left, _matrix(right.column("q"))), digits)
        return pa.table([right.column("query_id"), pa.array(np.full(right.num_rows, left.num_rows)), pa.array((bound >= np.where(np.isnan(least), -np.inf, least)).sum(0))], names=["query_id", "blocks", "read"])

    each = _meet(blocks_.select("block", "way", "low", "high", "across"), ready, shards, parts, count, f"query_id {kind}, blocks long, read long")
    return each.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))
