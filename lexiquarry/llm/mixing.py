"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations. DataFrame functions only.

A source's weight is its token share to the power ``a``, normalised. Entropy falls and repetition of small sources falls as
``a`` grows from 0 to 1, so the least ``a`` under which the weights' entropy is at most the target and no source is read more
often than the limit is found by bisection. The token budget times the weight is a source's budget: so many
whole passes over it and a part of one more. Documents are dealt into blocks by hash, and each pass reads the blocks, and the
documents in them, in an order of its own. The part pass ends inside one block: block totals find it, and only that
block's documents are summed one by one. So no window ever spans a source, however large, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.llm.common import table
from lexiquarry.session import materialise, small

BLOCK_TOKENS = 1 << 16
STEPS = 30
SEED = 17
FLATNESS = 0.9  # target entropy as a share of the way from the corpus's own entropy to the uniform one
REPEATS = 4.0  # passes over any one source at most
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts) -> Column:
    """60 bits of an MD5, which any SQL engine computes alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 15), 16, 10).cast("long")


def _keys(seed: int) -> tuple[Column, Column, Column]:
    i, s = F.coalesce(F.col("i").cast("string"), F.lit("")), F.col("s")
    block = F.pmod(_hash("block", seed, i), F.col("n_blocks"))
    return block, _hash("order", seed, F.col("epoch"), s, block), _hash("doc", seed, F.col("epoch"), i)


def exponent(sources: DataFrame, budget: int | None, flatness: float, repeats: float) -> DataFrame:
    """One row ``(a, z, total, budget)``: the exponent, the sum of powers, all tokens and the token budget."""
    pairs = sources.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("m"))
    one = pairs.agg(F.array_sort(F.collect_list(F.struct("tokens", "m"))).alias("c"))  # a pair for each distinct size of a source
    total = F.aggregate("c", F.lit(0).cast("long"), lambda t, x: t + x["tokens"] * x["m"])
    one = one.select("c", total.alias("total"))
    one = one.select("c", "total", F.lit(budget).cast("long").alias("asked")).select("c", "total", F.coalesce("asked", "total").alias("budget"))
    share = lambda x: x["tokens"].cast("double") / F.col("total")
    sums = lambda f: F.aggregate("c", F.lit(0.0), lambda t, x: t + x["m"] * f(x))
    one = one.select("*", (-sums(lambda x: share(x) * F.log(share(x)))).alias("own"), F.log(F.greatest(F.lit(1.0), sums(lambda x: F.lit(1.0)))).alias("even"))
    one = one.withColumn("target", F.col("own") + flatness * (F.col("even") - F.col("own")))

    def too_flat(a):
        z = sums(lambda x: F.pow(share(x), a))
        entropy = F.log(z) - a * sums(lambda x: F.pow(share(x), a) * F.log(share(x))) / z
        most = F.aggregate("c", F.lit(0.0), lambda t, x: F.greatest(t, F.pow(share(x), a) / z * F.col("budget") / x["tokens"]))
        return (entropy > F.col("target")) | (most > repeats)

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        flat = too_flat(mid)
        return F.struct(F.when(flat, mid).otherwise(acc["lo"]).alias("lo"), F.when(flat, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)["hi"]
    one = one.withColumn("a", found)
    return one.select("a", sums(lambda x: F.pow(share(x), F.col("a"))).alias("z"), "total", "budget")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, flatness: float = FLATNESS, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """A row for each source: tokens, weight, whole passes, and where the part pass ends (block key, document key)."""
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    rows = materialise(rows, "sizes")
    sources = materialise(rows.groupBy("s").agg(F.sum("n").alias("tokens")), "sources")
    one = materialise(exponent(sources, budget, flatness, repeats), "exponent")
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double") / F.col("total"), F.col("a")) / F.col("z")).otherwise(0.0)
    plans = sources.join(F.broadcast(one)).select("s", "tokens", "a", weight.alias("weight"), F.floor(F.col("budget") * weight).cast("long").alias("quota"))  # one is a single row
    safe = F.greatest(F.col("tokens"), F.lit(1))
    plans = plans.select("*", F.expr("quota div greatest(tokens, 1)").cast("int").alias("epoch"), (F.col("quota") % safe).alias("rest"), F.ceil(safe / block_tokens).cast("long").alias("n_blocks"))
    plans = materialise(plans, "plans")
    block, order, doc = _keys(seed)
    keyed = rows.join(small(plans), "s").where("n > 0").select("s", "rest", "n", block.alias("block"), order.alias("o"), doc.alias("d"))
    keyed = materialise(keyed, "keyed")
    blocks = keyed.groupBy("s", "rest", "o").agg(F.sum("n").alias("n")).withColumn("super", F.shiftright("o", 48))
    supers = blocks.groupBy("s", "super").agg(F.sum("n").alias("m"))
    supers = supers.select("s", "super", (F.sum("m").over(Window.partitionBy("s").orderBy("super")) - F.col("m")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("s", "super").orderBy("o")) - F.col("n")
    blocks = blocks.select("*", inner.alias("inner")).join(supers, ["s", "super"]).withColumn("before", F.col("before") + F.col("inner"))
    edge = materialise(blocks.where("before <= rest and rest < before + n").select("s", "o", F.col("rest") - F.col("before").alias("left")).toDF("s", "o", "left"), "edge")  # a row for each source
    last = keyed.join(small(edge), ["s", "o"]).groupBy("s", "o", "left", "d").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("d"))  # one block of each source
    last = last.select("s", "d", "left", upto.alias("upto")).where("upto <= left").groupBy("s").agg(F.max("d").alias("cut_doc"))
    return plans.join(edge.select("s", F.col("o").alias("cut_block")), "s", "left").join(last, "s", "left").select("s", "tokens", "a", "weight", "quota", "epoch", "rest", "n_blocks", "cut_block", F.coalesce("cut_doc", F.lit(-1)).alias("cut_doc"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, places: bool = True, **options) -> DataFrame:
    """``docs`` with a row for each time a document is read, and (``places``) ``_epoch``, ``_block``, ``_order``, ``_rank``: the reading order
    is that of epoch, order, rank. Where ``docs`` has such a column the new one's name gets further underscores in front.

    Null sources count as the source "". Documents without a word carry no tokens and are read once in each whole pass.
    Ties of ids share their keys, so they are read together. An empty table gives no rows.
    """
    plans = small(materialise(plan(docs, id_col, text_col, source_col, seed=seed, **options), "mixplan").select("s", F.col("epoch").alias("whole"), "rest", "n_blocks", "cut_block", "cut_doc"))
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    rows = rows.withColumn("i", F.col(names[id_col])).withColumn("s", F.coalesce(F.col(names[source_col]).cast("string"), F.lit(""))).join(plans, "s")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    block, order, doc = _keys(seed)
    rows = rows.select("*", block.alias("b"), order.alias("o"), doc.alias("d"))
    part = (F.col("o") < F.col("cut_block")) | ((F.col("o") == F.col("cut_block")) & (F.col("d") <= F.col("cut_doc")))
    rows = rows.where((F.col("epoch") < F.col("whole")) | F.coalesce(part & (F.col("rest") > 0), F.lit(False)))
    taken = {c.lower() for c in names}
    free = lambda c: c if c not in taken else free("_" + c)
    new = [F.col(c).alias(free(k)) for c, k in (("epoch", "_epoch"), ("b", "_block"), ("o", "_order"), ("d", "_rank"))]
    return rows.select(*[F.col(v).alias(k) for k, v in names.items()], *new * places)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_order").alias("block_key"), F.col("_rank").alias("doc_key"))


_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '') AS s, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS n FROM documents),
sizes AS (SELECT s, sum(n)::BIGINT AS tokens FROM docs GROUP BY s),
used AS (SELECT s, tokens, tokens::DOUBLE / (SELECT sum(tokens)::BIGINT FROM sizes) AS p, (SELECT sum(tokens)::BIGINT FROM sizes) AS total FROM sizes WHERE tokens > 0),
goal AS (SELECT own + {FLATNESS} * (even - own) AS target FROM (SELECT -sum(p * ln(p)) AS own, ln(count(*)) AS even FROM used)),
steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, mid, ln(z) - mid * e / z > (SELECT target FROM goal) OR m / z > {REPEATS} AS flat FROM (
      SELECT k, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(pow(p, (lo + hi) / 2)) FROM used) AS z,
        (SELECT sum(pow(p, (lo + hi) / 2) * ln(p)) FROM used) AS e, (SELECT max(pow(p, (lo + hi) / 2) * total / tokens) FROM used) AS m
      FROM steps WHERE k < {STEPS}))),
best AS (SELECT hi AS a, (SELECT sum(pow(p, hi)) FROM used) AS z FROM steps WHERE k = {STEPS}),
plans AS (
  SELECT s, tokens, n_blocks, (quota // greatest(tokens, 1))::INT AS whole, quota % greatest(tokens, 1) AS rest FROM (
    SELECT s, tokens, ceil(greatest(tokens, 1) / {BLOCK_TOKENS})::BIGINT AS n_blocks,
      CASE WHEN tokens > 0 THEN floor((SELECT sum(tokens)::BIGINT FROM sizes) * (pow(tokens::DOUBLE / (SELECT sum(tokens)::BIGINT FROM sizes), a) / z))::BIGINT ELSE 0 END AS quota
    FROM sizes, best)),
reads AS (SELECT *, unnest(range(0, whole + 1))::INT AS epoch, {_H.format(f"'block|{SEED}|' || coalesce(doc_id::VARCHAR, '')")} % n_blocks AS block FROM docs JOIN plans USING (s)),
keyed AS (
  SELECT *, {_H.format(f"'order|{SEED}|' || epoch || '|' || s || '|' || block")} AS o, {_H.format(f"'doc|{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '')")} AS d FROM reads),
part AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY o, d) AS upto, sum(n) OVER (PARTITION BY s, o) AS bn FROM keyed WHERE epoch = whole),
blocks AS (SELECT DISTINCT s, o, bn, rest FROM part),
edge AS (SELECT s, o AS cut FROM (SELECT *, sum(bn) OVER (PARTITION BY s ORDER BY o) AS after FROM blocks) WHERE after - bn <= rest AND rest < after),
ends AS (SELECT s, o, max(d) AS cut_doc FROM part JOIN edge USING (s) WHERE o = cut AND n > 0 AND upto <= rest GROUP BY s, o)
SELECT doc_id, source, epoch, block, o AS block_key, d AS doc_key FROM keyed WHERE epoch < whole
UNION ALL
SELECT doc_id, source, epoch, block, o, d FROM part JOIN edge USING (s) LEFT JOIN ends USING (s, o)
WHERE rest > 0 AND (o < cut OR o = cut AND d <= coalesce(cut_doc, -1))
"""

QUERIES = {"op6_mixing": query}
ORACLES = {"op6_mixing": ORACLE}
