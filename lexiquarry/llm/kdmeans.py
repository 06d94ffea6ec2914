"""Centroid clustering by kd-tree filtering, in whole numbers.

Vectors become whole numbers and are built, where they lie, into kd-trees of bounded size: a node has its box, its count and the sum of its vectors. A round sends the
centroids, a stated few, down every tree. At a node, a centroid goes if another one is strictly nearer to every place of the box; a node left with one centroid is
added to it as a whole, and the vectors of a leaf left with more are settled one by one. Counts and sums, one row for each centroid and tree, combine before they
are shuffled, and make the next centroids exactly. The trees are written once and read in every round, so a lost executor costs a re-read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import record, table
from lexiquarry.session import materialise

MEMBERS = 8192  # vectors of a tree at most
LEAF = 32  # vectors of a leaf at most, unless they are all the same
LIMB = 40  # bits of a part of a sum
_TREE = "rows binary, points binary, wide boolean, starts binary, ends binary, low binary, high binary, left binary, sums binary"
_EXACT = 1 << 20  # components up to this size have exact products and sums in doubles, at up to 4,096 of them


@dataclass
class Tree:
    """``order`` of the vectors, and for each node its first and last place in that order, its box, its first child (the second is next to it; 0: a leaf) and sum."""

    order: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    sums: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Nodes are cut at the middle place of the component that spreads most; parents come before their children."""
    order = np.arange(len(points))
    nodes, todo = [(0, len(points))], 0
    low, high, left, sums = [], [], [], []
    while todo < len(nodes):
        a, b = nodes[todo]
        some = points[order[a:b]]
        low.append(some.min(0))
        high.append(some.max(0))
        sums.append(some.sum(0))
        spread = high[-1] - low[-1]
        if b - a <= leaf or not spread.any():
            left.append(0)
        else:
            by = some[:, int(np.argmax(spread))]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argsort(by, kind="stable")]
            left.append(len(nodes))
            nodes += [(a, a + mid), (a + mid, b)]
        todo += 1
    starts, ends = np.array(nodes).T
    return Tree(order, starts, ends, np.array(low), np.array(high), np.array(left), np.array(sums))


def _as(m: np.ndarray) -> np.ndarray:
    """For products: doubles where these are exact, else whole numbers of any size."""
    small = m.shape[-1] <= 4096 and (m.size == 0 or -_EXACT <= m.min() and m.max() <= _EXACT)
    return m.astype(np.float64) if small else m.astype(object)


def keep_candidates(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``alive`` (nodes x centroids) without those to which, for every place of the node's box, the candidate nearest to its middle is strictly nearer."""
    norms = (centroids * centroids).sum(1)
    twice = low + high
    far = 4 * norms[None, :] - 4 * (twice @ centroids.T)  # from the middle, times four, without what all share
    far = np.where(alive, far, far.max() + 1 if far.size else 0)
    best = np.argmin(far, axis=1)
    out = alive.copy()
    for c in np.unique(best):
        at = np.flatnonzero(best == c)
        toward = centroids - centroids[c]
        # the place of the box that favours another centroid most; there, how much farther it is
        reach = high[at] @ np.maximum(toward, 0).T + low[at] @ np.minimum(toward, 0).T
        out[at] &= ~((norms - norms[c])[None, :] - 2 * reach > 0)
        out[at, c] = True
    return out


def filtered(tree: Tree, points: np.ndarray, centroids: np.ndarray):
    """``(nodes, owners, leaves, alive)``: nodes that belong to one centroid as a whole, and leaves with the candidates left for their vectors."""
    low, high, centres = _as(tree.low), _as(tree.high), _as(centroids)
    if object in (low.dtype, high.dtype, centres.dtype):
        low, high, centres = low.astype(object), high.astype(object), centres.astype(object)
    at, alive = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    nodes, owners, leaves, left = [], [], [], []
    while len(at):
        alive = keep_candidates(low[at], high[at], alive, centres)
        one = alive.sum(1) == 1
        nodes.append(at[one])
        owners.append(np.argmax(alive[one], axis=1))
        at, alive = at[~one], alive[~one]
        end = tree.left[at] == 0
        leaves.append(at[end])
        left.append(alive[end])
        at, alive = at[~end], np.repeat(alive[~end], 2, axis=0)
        at = (tree.left[at][:, None] + np.arange(2)).ravel()
    return np.concatenate(nodes), np.concatenate(owners), np.concatenate(leaves), np.concatenate(left)


def settle(points: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The nearest candidate of each vector, the smaller number among equals."""
    p, c = _as(points), _as(centroids)
    if object in (p.dtype, c.dtype):
        p, c = p.astype(object), c.astype(object)
    far = (c * c).sum(1)[None, :] - 2 * (p @ c.T)
    return np.argmin(np.where(alive, far, far.max() + 1), axis=1)


def owners_of(tree: Tree, points: np.ndarray, centroids: np.ndarray):
    """``(nodes, owners, places, nearest)``: whole nodes and their centroid; places of the order that were settled one by one, and theirs."""
    nodes, owners, leaves, alive = filtered(tree, points, centroids)
    size = tree.ends[leaves] - tree.starts[leaves]
    places = np.repeat(tree.starts[leaves] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    return nodes, owners, places, settle(points[tree.order[places]], centroids, np.repeat(alive, size, axis=0)) if len(places) else places


def sums_of(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """``(cluster, count, sum)`` of one tree's vectors."""
    nodes, owners, places, nearest = owners_of(tree, points, centroids)
    out = []
    for c in np.unique(np.concatenate([owners, nearest])).tolist():
        whole, some = nodes[owners == c], places[nearest == c]
        out.append((c, int((tree.ends[whole] - tree.starts[whole]).sum()) + len(some), tree.sums[whole].sum(0) + points[tree.order[some]].sum(0)))
    return out


def labels_of(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each vector and its squared distance."""
    nodes, owners, places, nearest = owners_of(tree, points, centroids)
    label = np.zeros(len(points), np.int64)
    for n, c in zip(nodes.tolist(), owners.tolist()):
        label[tree.order[tree.starts[n] : tree.ends[n]]] = c
    label[tree.order[places]] = nearest
    gap = _as(points) - _as(centroids)[label]
    return label, (gap * gap).sum(1)


def _pack(m: np.ndarray, wide: bool) -> bytes:
    """Whole numbers of 32 bits, or as decimal text where they are wider."""
    return ",".join(map(str, m.ravel().tolist())).encode() if wide else m.astype("<i4").tobytes()


def _unpack(raw: bytes, wide: bool, width: int) -> np.ndarray:
    flat = np.array([int(x) for x in raw.split(b",") if x], object) if wide else np.frombuffer(raw, "<i4").astype(np.int64)
    return flat.reshape(-1, width)


def _limbs(x: int, n: int) -> list[int]:
    sign = -1 if x < 0 else 1
    return [sign * (abs(x) >> LIMB * i & ((1 << LIMB) - 1)) for i in range(n)]


@dataclass
class Model:
    """Trees over all kept vectors, and the final centroids."""

    trees: DataFrame
    centroids: list[list[int]]
    width: int


def _trees_of(batch, width: int):
    for r in batch.to_pylist():
        read = lambda k: np.frombuffer(r[k], "<i4").astype(np.int64)
        points = _unpack(r["points"], r["wide"], width)
        sums = np.array([int(x) for x in r["sums"].split(b",")], object).reshape(-1, width) if r["wide"] else np.frombuffer(r["sums"], "<i8").reshape(-1, width)
        box = [_unpack(r[k], r["wide"], width) for k in ("low", "high")]
        yield r["rows"], points, Tree(np.arange(len(points)), read("starts"), read("ends"), *box, read("left"), sums)


def plant(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: float) -> DataFrame:
    """The kept vectors as kd-trees of at most ``MEMBERS``, built where they lie."""
    schema = pa.schema([("rows", pa.binary()), ("points", pa.binary()), ("wide", pa.bool_()), *[(k, pa.binary()) for k in ("starts", "ends", "low", "high", "left", "sums")]])

    def whole(rows: pa.Array) -> np.ndarray:
        flat = np.floor(rows.flatten().to_numpy(zero_copy_only=False) * scale)
        if len(flat) and not np.isfinite(flat).all():  # beyond a double once scaled
            flat = np.array([int(x * 2.0**-64 * scale) << 64 if abs(x) > 2.0**900 else int(np.floor(x * scale)) for x in rows.flatten().to_pylist()], object)
        elif len(flat) and np.abs(flat).max() >= 1 << 31:
            flat = np.array([int(x) for x in flat.tolist()], object)
        else:
            flat = flat.astype(np.int64)
        return flat.reshape(-1, width)

    def made(held):
        points = np.concatenate([whole(v) for _, v in held])
        wide = points.dtype == object
        tree = build(points)
        ids = pa.concat_arrays([i for i, _ in held]).take(pa.array(tree.order))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as out:
            out.write(pa.record_batch([ids], ["id"]))
        sums = _pack(tree.sums, True) if wide else tree.sums.astype("<i8").tobytes()
        ints = [x.astype("<i4").tobytes() for x in (tree.starts, tree.ends)]
        return record(schema, [sink.getvalue().to_pybytes()], [_pack(points[tree.order], wide)], [wide], *[[x] for x in ints], [_pack(tree.low, wide)], [_pack(tree.high, wide)], [tree.left.astype("<i4").tobytes()], [sums])

    def grow(source):
        held, n = [], 0
        for batch in source:
            for at in range(0, batch.num_rows, MEMBERS // 8):
                part = batch.slice(at, MEMBERS // 8)
                held.append((part.column(0), part.column(1)))
                n += part.num_rows
                if n >= MEMBERS:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(grow, _TREE)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, salt: str = "1:") -> Model:
    """Centroids after ``rounds``; the first ones are the vectors whose salted ids hash lowest (equal ids: the lesser vector; null ids come last)."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.size(vector_col) == width).where(finite)
    trees = materialise(plant(kept, id_col, vector_col, width, scale), "trees", "lz4")
    hashed = F.sha2(F.concat(F.lit(salt), F.col(id_col).cast("string")), 256)
    wide = F.col(vector_col).cast("array<double>")
    first = kept.select(hashed.alias("h"), wide.alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    centroids = [[_floor(x, scale) for x in r.v] for r in first]
    most = trees.agg(F.max("wide")).first()[0] if first else False
    limbs = 28 if most else 2
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])
    for _ in range(rounds if first else 0):
        at = np.array(centroids, object)
        at = at.astype(np.int64) if not most else at

        def step(source, at=at):
            for batch in source:
                for _, points, tree in _trees_of(batch, width):
                    got = sums_of(tree, points, at)
                    yield record(schema, [c for c, _, _ in got], [n for _, n, _ in got], [[y for x in s.tolist() for y in _limbs(x, limbs)] for _, _, s in got])

        parts = trees.mapInArrow(step, "cluster int, n long, s array<long>")
        sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width * limbs)]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
            total = [sum(r[f"s{i * limbs + j}"] << LIMB * j for j in range(limbs)) for i in range(width)]
            centroids[r.cluster] = [x // r.n for x in total]
    return Model(trees, centroids, width)


def _floor(x: float, scale: float) -> int:
    y = np.floor(np.float64(x) * scale)
    return int(y) if np.isfinite(y) else int(x * 2.0**-64 * scale) << 64


def assign(model: Model, id_type: str = "bigint", id_col: str = "vec_id") -> DataFrame:
    """``(id, cluster, distance)`` of every kept vector."""
    at = np.array(model.centroids, object).reshape(-1, model.width)
    fits = not at.size or max(abs(x) for x in at.ravel().tolist()) < 1 << 62
    top, width = (1 << 63) - 1, model.width

    def label(source):
        for batch in source:
            for rows, points, tree in _trees_of(batch, width):
                ids = pa.ipc.open_stream(rows).read_all().column(0).combine_chunks()
                own, far = labels_of(tree, points, at.astype(np.int64) if fits and points.dtype != object else at)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array([min(int(x), top) for x in far.tolist()], pa.int64())], [id_col, "cluster", "distance"])

    return model.trees.mapInArrow(label, f"`{id_col}` {id_type}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: float = 64.0, salt: str = "1:") -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid)`` for every vector of ``width`` components, none null or not finite.

    Ties go to the smaller centroid; a centroid without vectors stays where it is. Repeated rows and ids are vectors of their own; a null id is kept and is a first
    centroid only where there are too few others. Fewer vectors than ``k`` make as many centroids; none make no rows. Other columns are
    ignored. Components of any finite size are exact; a distance or sum beyond 64 bits is given as the greatest such number. What is shuffled is a row for each centroid
    and task; what is broadcast and collected is bounded by ``k`` and ``width``.
    """
    spark = vectors.sparkSession
    model = fit(vectors, id_col, vector_col, k, rounds, width, scale, salt)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = materialise(assign(model, kind, id_col), "labels", "lz4")
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)").alias("d"))
    clamp = lambda c: F.least(c, top).cast("long")
    each = each.select("cluster", clamp("d").alias("cluster_inertia"), clamp(F.sum("d").over(Window.partitionBy())).alias("inertia"))  # k rows
    named = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(model.centroids)], "cluster int, centroid string")
    return rows.join(F.broadcast(each), "cluster").join(F.broadcast(named), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _oracle(k: int = 16, rounds: int = 3) -> str:
    away = "list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1)::INT AS n, e AS c FROM v QUALIFY n < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, n := n)) AS b FROM (SELECT v.r, c.n, {away}::BIGINT AS d FROM v CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT n, list(floor(s / t)::BIGINT ORDER BY j) AS c FROM
  (SELECT b.n AS n, j, sum(e[j])::DOUBLE AS s, count(*) AS t FROM a{i} JOIN v USING (r), unnest(range(1, 65)) AS u(j) GROUP BY ALL) GROUP BY n) m USING (n))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, b.n AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.n))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.n = b.n"""


QUERIES = {"op13_kd_centroids": query}
ORACLES = {"op13_kd_centroids": _oracle()}
