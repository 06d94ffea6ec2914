"""Batched top-k retrieval: keywords (BM25), vectors, rank fusion, reranking, and what explains a ranking.

Every retriever takes a table of queries and gives ``(query_id, rank, chunk_id, doc_id, score)``. Scores are rounded before they are
ranked and ties go to the smaller document and position, so results do not depend on the order in which sums were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions.text import tokens
from lexiquarry.operators import vectors as blocked
from lexiquarry.operators.postings import RANGE, Asked, Index, index, keep, open_index  # noqa: F401  part of this module's interface
from lexiquarry.session import materialise, small

PER_DOC = 2
DEPTH = 50
SEEDS = 4  # ranges of greatest bound that are scored before others are passed over
RRF = 60
DIGITS = 6


def capped(hits: DataFrame, k: int, per_doc: int = PER_DOC) -> DataFrame:
    """The k best of each query with at most ``per_doc`` of a document (0: any number), which is what a greedy scan of the ranking picks."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = [F.desc("score"), "doc_id", "position"]
    if per_doc:
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*order))).where(F.col("_n") <= per_doc).drop("_n")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "doc_id", "position", "score")


def _steps(asked: Asked, k: int, per_doc: int, docs: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every range's bound with its place, the best of the first ranges, and the further ranges that may hold one of the k best."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "range"))
    bounds = materialise(asked.bounds().withColumn("place", place), "bounds")
    first = materialise(asked.best(bounds.where(F.col("place") <= SEEDS), k, per_doc, DIGITS, docs), "first")
    reached = capped(first, k, per_doc).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    left = bounds.where(F.col("place") > SEEDS).join(small(reached), "query_id", "left")
    # a score that only equals the k-th may still win by its document; sums differ in their last bits by their order
    return bounds, first, materialise(left.where(F.col("least").isNull() | (F.round(F.col("most") + 1e-9, DIGITS) >= F.col("least"))).select("query_id", "range"), "ranges")


def bm25(idx: Index, queries: DataFrame, k: int = 5, per_doc: int = PER_DOC) -> DataFrame:
    """Keyword search; only chunks that share a term with the query are hits. Ranges of chunks that can't hold one of the k best are passed over."""
    return _best(idx.ask(queries), k, per_doc)


def _best(asked: Asked, k: int, per_doc: int, docs: list | None = None) -> DataFrame:
    if k < 1:
        raise ValueError("k must be at least 1")
    # a batch whose first ranges are most ranges reads all in one pass
    if 2 * SEEDS * asked.rows.select("query_id").distinct().count() > asked.count / RANGE:
        return capped(asked.best(None, k, per_doc, DIGITS, docs), k, per_doc)
    _, first, further = _steps(asked, k, per_doc, docs)
    return capped(first.unionByName(asked.best(further, k, per_doc, DIGITS, docs)), k, per_doc)


def ranges_read(idx: Index, queries: DataFrame, k: int = 5, per_doc: int = PER_DOC) -> DataFrame:
    """``(query_id, ranges, read)``: how many ranges hold a term of the query, and how many of them :func:`bm25` scores."""
    bounds, _, further = _steps(idx.ask(queries), k, per_doc)
    all_ = bounds.groupBy("query_id").agg(F.count("*").alias("ranges"), F.count_if(F.col("place") <= SEEDS).alias("first"))
    return all_.join(further.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left").select("query_id", "ranges", (F.col("first") + F.coalesce("more", F.lit(0))).alias("read"))


def explain(idx: Index, queries: DataFrame, docs: list | None = None, top: int = 10, terms: int = 4) -> DataFrame:
    """For each query its best documents (of ``docs``, if given), each with its best chunk and the terms that made its score."""
    asked = idx.ask(queries)
    hits = materialise(_best(asked, top, 1, docs), "hits")
    parts = asked.parts(hits).groupBy("query_id", "chunk_id").agg(F.max("len").alias("len"), F.array_sort(F.collect_list(F.struct((-F.round("part", DIGITS)).alias("minus"), "term"))).alias("t"))
    parts = materialise(parts, "parts")
    named = F.transform(F.slice("t", 1, terms), lambda x: x["term"])
    return hits.join(small(parts), ["query_id", "chunk_id"]).select("query_id", "rank", "doc_id", "chunk_id", "score", F.array_join(named, " ").alias("top_terms"), (F.col("len") < 0.6 * F.lit(idx.average)).alias("is_short"))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, per_doc: int = PER_DOC, digits: int = 5) -> DataFrame:
    """Inner products of unit vectors; ``vectors (chunk_id, doc_id, position, embedding)`` or their blocks, ``queries (query_id, embedding)``.

    A stated set of queries against all rows, by blocks that bounds pass over (:mod:`lexiquarry.operators.vectors`).
    """
    return capped(blocked.search(blocked.blocks(vectors), queries, k, per_doc, digits), k, per_doc)


def fuse(first: DataFrame, second: DataFrame, k: int = 5, per_doc: int = PER_DOC, rrf: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    both = first.unionByName(second).withColumn("part", 1 / (rrf + F.col("rank")))
    return capped(both.groupBy("query_id", "chunk_id", "doc_id", "position").agg(F.round(F.sum("part"), 9).alias("score")), k, per_doc)


def hybrid(idx: Index, vectors: DataFrame, queries: DataFrame, k: int = 5, per_doc: int = PER_DOC, depth: int = DEPTH, rrf: int = RRF) -> DataFrame:
    """Keyword and vector rankings of ``depth``, without a cap, fused; the cap applies to the result."""
    return fuse(bm25(idx, queries, depth, 0), dense(vectors, queries, depth, 0), k, per_doc, rrf)


def fetched(chunks: DataFrame, hits: DataFrame, *columns: str) -> DataFrame:
    """``(chunk_id, ...)`` of the chunks that ``hits`` name: their ids go to the chunks if they are few, so that texts of others are not shuffled. Pass materialised hits."""
    return chunks.select("chunk_id", *columns).join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, scorer=None, k: int = 5, per_doc: int = PER_DOC) -> DataFrame:
    """Hits of a first stage, scored again as (query, text) pairs; the cap comes after."""
    from lexiquarry.models import overlap_score

    scorer = scorer or overlap_score
    hits = materialise(hits.drop("score", "rank"), "stage")
    pairs = hits.join(small(queries.select("query_id", "query")), "query_id").join(fetched(chunks, hits, "text"), "chunk_id")
    return capped(pairs.select("query_id", "chunk_id", "doc_id", "position", F.round(scorer(F.col("query"), F.col("text")), DIGITS).alias("score")), k, per_doc)


def retriever(kind: str, idx: Index, vectors: DataFrame | None = None, reranked: bool = False, scorer=None, depth: int = DEPTH):
    """A function ``search(queries, k, per_doc)`` over one set of chunks: kind is ``bm25``, ``dense`` or ``hybrid``."""
    base = {
        "bm25": lambda q, k, p: bm25(idx, q, k, p),
        "dense": lambda q, k, p: dense(vectors, q, k, p),
        "hybrid": lambda q, k, p: hybrid(idx, vectors, q, k, p),
    }
    if kind not in base:
        raise ValueError(f"unknown retriever: {kind}")
    if not reranked:
        return lambda queries, k=5, per_doc=PER_DOC: base[kind](queries, k, per_doc)
    return lambda queries, k=5, per_doc=PER_DOC: rerank(base[kind](queries, depth, 0), idx.chunks, queries, scorer, k, per_doc)


def compare(**rankings: DataFrame) -> DataFrame:
    """The hits of several retrievers in one table, by name."""
    out = None
    for name, hits in rankings.items():
        part = hits.withColumn("retriever", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def prompts(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: numbered passages in rank order, then the question."""
    hits = materialise(hits, "hits")
    texts = hits.join(fetched(chunks, hits, "title", "text"), "chunk_id")
    passage = F.format_string("[%d] (%s - %s)\n%s", F.col("rank"), F.col("doc_id").cast("string"), F.col("title"), F.col("text"))
    lists = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n")
    return lists.join(queries, "query_id").select("query_id", F.concat(F.lit("Passages:\n\n"), body, F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:")).alias("prompt"))
