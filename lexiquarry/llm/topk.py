"""Exact top-k inner products through an impact-ordered, score-at-a-time index.

Vectors become whole numbers. Members are indexed once, in blocks, where they lie: a block's postings (dimension, member, component) are cut into
segments by quantised impact, the size of a component, and written in descending order. Queries, a stated set, go out in blocks of bounded bytes. Each
reads the segments from the highest impact down and adds their postings to its scores. What is unread can change a score by at most the
query's length times the length of a member's unread part. The members that lead are scored exactly on the way, which gives a score that the k-th best has at least.
Reading stops only once these prove that few members can still be among a query's k best; those are scored again exactly, in whole numbers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import record, table
from lexiquarry.session import materialise

K = 5
LEVELS = 8
MEMBERS = 8192  # of an index block at most
QUERY_BYTES = 32 << 20  # of queries sent to every executor at once
QUERIES_EACH = 128  # scored together
LEADERS = 4  # times k members that are scored exactly after a segment
RESCORE = 6  # reading stops once at most one member in so many is still possible
_BLOCK = "ids binary, width int, forward binary, ends binary, dims binary, members binary, values binary"


def index_block(ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> tuple:
    """A block's columns: ids and vectors of the members, in order of id, and the postings of all segments with where each segment ends."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    size = np.abs(vectors)
    top = size.max(initial=0)
    level = np.minimum(levels - 1, np.floor(size / (top / levels))) if top > 0 else np.zeros(size.shape)
    member, dim = np.nonzero(size)
    rank = np.lexsort((member, dim, -level[member, dim]))  # impact first, then dimension
    member, dim = member[rank], dim[rank]
    ends = np.searchsorted(-level[member, dim], -np.arange(levels - 1, -1, -1), "right")
    return ids.astype("<i8").tobytes(), vectors.shape[1], vectors.astype("<f8").tobytes(), ends.astype("<i8").tobytes(), dim.astype("<u4").tobytes(), member.astype("<u4").tobytes(), vectors[member, dim].astype("<f8").tobytes()


def search_block(q_ids: np.ndarray, queries: np.ndarray, block: tuple, k: int = K, stats: list | None = None) -> list[tuple[int, int, int]]:
    """``(query, member, score)`` of the k best members of each query, ties to the smaller id; members that share the query's id take no part.

    ``stats`` gains how many postings were read, of how many, and how many members were scored again.
    """
    ids, width, forward, ends, dims, members, values = block
    ids, ends = np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
    dims, members, values = np.frombuffer(dims, "<u4"), np.frombuffer(members, "<u4"), np.frombuffer(values, "<f8")
    vectors = np.frombuffer(forward, "<f8").reshape(len(ids), width)
    if queries.shape[1] < width:
        queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    exact_queries = queries
    # components whose squares would leave a double's range are brought down by a power of two; this moves no rank
    down = [int(np.frexp(x)[1]) if x > 1e100 else 0 for x in (np.abs(vectors).max(initial=0), np.abs(queries).max(initial=0))]
    light, queries, values = np.ldexp(vectors, -down[0]), np.ldexp(queries, -down[1]), np.ldexp(values, -down[0])
    scores = np.zeros((len(ids), len(queries)))
    unread = (light**2).sum(1)
    whole, lengths = np.sqrt(unread), np.sqrt((queries**2).sum(1))
    slack = 1e-12 * whole[:, None] * lengths[None, :] + 1e-9  # over what rounding can add up to
    own = ids[:, None] == q_ids[None, :]
    possible, start, read = ~own, 0, 0
    segment = np.zeros((len(ids), queries.shape[1]))
    for end in ends.tolist():
        # a segment's postings for all queries at once, as a matrix that holds nothing else
        at = members[start:end], dims[start:end]
        segment[at] = values[start:end]
        scores += segment @ queries.T
        segment[at] = 0.0
        np.subtract.at(unread, at[0], values[start:end] ** 2)
        start = read = end
        if len(ids) <= k or end == len(dims) or unread.sum() > (whole**2).sum() / 4:  # too much is left for a proof
            continue
        # what the rest can still change: the lengths of both, or the query's sum times the greatest component that is left
        left = np.sqrt(np.maximum(0.0, unread) + 1e-12 * whole**2)
        bound = np.minimum(left[:, None] * lengths[None, :], np.abs(queries).sum(1)[None, :] * np.abs(values[end:]).max(initial=0)) + slack
        # exact scores of the members that lead so far: the k-th of them is at most the k-th of all
        some = np.argpartition(np.where(own, np.inf, -scores), min(len(ids) - 1, LEADERS * k), axis=0)[: LEADERS * k]
        exact = np.where(np.take_along_axis(own, some, 0), -np.inf, np.einsum("kqd,qd->kq", light[some], queries[:, : light.shape[1]]))
        best = -np.partition(-exact, k - 1, axis=0)[k - 1] if len(exact) >= k else np.full(len(queries), -np.inf)
        possible = ~own & (scores + bound + slack >= best)
        if possible.sum() * RESCORE <= possible.size:
            break
    if stats is not None:
        stats.append((read * len(queries), len(dims) * len(queries), int(possible.sum())))
    out = []
    for j in range(len(queries)):
        some = np.flatnonzero(possible[:, j])
        if not any(down) and whole[some].max(initial=0) * lengths[j] < 2.0**52:
            exact = (vectors[some] @ queries[j, :width]).astype(np.int64).tolist()
        else:
            asked = list(map(int, exact_queries[j, :width].tolist()))
            exact = [sum(map(int.__mul__, asked, map(int, v))) for v in vectors[some].tolist()]
        best = sorted(zip(exact, ids[some].tolist()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(int(q_ids[j]), i, s) for s, i in best]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, shorter ones filled with zeros."""
    lens = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(lens), width))
    out[np.arange(width) < lens[:, None]] = column.flatten().to_numpy()
    return out


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` holds, its k best other rows.

    Rows with a null id or vector, or a null or non-finite component, take no part. Shorter vectors are padded with zeros. Rows that
    repeat an id are all candidates of other rows; none is a candidate of its own id. Ties go to the smaller id. No rows give no rows; other columns
    are ignored. Components may be of any finite size: ranks come from exact scores, and a score beyond 64 bits is given as the nearest 64-bit number.

    Members are read and indexed where they lie and never shuffled; what is shuffled is k rows for each query and index block. The queries
    reach the driver and the executors ``QUERY_BYTES`` at a time.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    schema = pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("forward", pa.binary()), ("ends", pa.binary()), ("dims", pa.binary()), ("members", pa.binary()), ("values", pa.binary())])
    whole = lambda m: np.floor(m.astype(np.float64) * scale)  # noqa: E731  not Spark's floor, which ends at 64 bits

    def build(source):
        held, n = [], 0

        def flush():
            widest = max(m.shape[1] for _, m in held)
            matrix = np.concatenate([np.pad(m, ((0, 0), (0, widest - m.shape[1]))) for _, m in held])
            got = index_block(np.concatenate([i for i, _ in held]), matrix)
            return record(schema, *[[x] for x in got])

        for batch in source:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column(1)
                held.append((part.column(0).to_numpy(), whole(_matrix(lists, int(lists.value_lengths().to_numpy().max(initial=0))))))
                n += part.num_rows
                if n >= MEMBERS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    blocks = materialise(rows.select("id", "v").mapInArrow(build, _BLOCK), "impacts", "lz4")
    asked = materialise(rows.where("q").select("id", "v"), "asked")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(1, -(-n * max(1, width) * 8 // QUERY_BYTES))
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.string())])
    found = None
    for p in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == p).collect()
        matrix = np.zeros((len(some), width))
        for i, r in enumerate(some):
            matrix[i, : len(r.v)] = whole(np.array(r.v, np.float64))
        shared = spark.sparkContext.broadcast((np.array([r.id for r in some], np.int64), matrix))

        def run(source, shared=shared):
            ids, queries = shared.value
            low, high = -(1 << 63), (1 << 63) - 1
            for batch in source:
                for r in batch.to_pylist():
                    block = tuple(r.values())
                    for at in range(0, len(ids), QUERIES_EACH):
                        got = search_block(ids[at : at + QUERIES_EACH], queries[at : at + QUERIES_EACH], block, k)
                        if got:
                            a, b, s = zip(*got)
                            yield record(result, list(a), list(b), [min(max(x, low), high) for x in s], [None if low <= x <= high else str(x) for x in s])

        part = blocks.mapInArrow(run, "query_id long, vec_id long, score long, exact string")
        found = part if found is None else found.unionByName(part)
    # scores beyond 64 bits are put in order by sign, length and digits
    long = F.coalesce(F.length("exact"), F.lit(0)) * F.signum("score")
    digits = F.when(F.col("score") > 0, F.col("exact"))
    order = [F.desc("score"), long.desc(), digits.desc(), F.when(F.col("score") < 0, F.col("exact")).asc(), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) WHERE rank <= 5
"""

QUERIES = {"op5_exact_topk": query}
ORACLES = {"op5_exact_topk": ORACLE}
