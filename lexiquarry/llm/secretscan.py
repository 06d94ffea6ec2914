"""Secret scan: fixed patterns, and a randomness test battery over other token-like strings. DataFrame functions only.

Base spans come from the patterns in ``KINDS``. Further candidates are runs of 20 or more characters of the usual encodings that mix character
classes. For each, the encoding is inferred, symbols are numbered by it, and three tests ask whether a uniform random
source could have made it: chi-squared uniformity over the alphabet, the runs test about the alphabet's middle, and lag-one
serial correlation. The least of the three p-values, times three, is the candidate's. The share of false rejections is
controlled at ``RATE`` in each class of length apart (Benjamini-Hochberg on a histogram of p-values: one row for each class
and bin), since short strings carry less evidence. Candidates whose randomness is not rejected are spans of kind ``random``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.common import table
from lexiquarry.session import materialise

# The patterns of the base kinds, in the order that breaks ties, each with its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
RATE = 0.05
BINS = 1000

# Alphabets of encodings, the narrowest first.
HEXES = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64 = ALNUM + "+/"

_SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Every match as (start, kind, end, hit), in code points: the lengths of the pieces between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    none = F.array().cast(_SPAN)

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("pos"), F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _normal(z: Column) -> Column:
    """The standard normal distribution function, to about four digits."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(-(0.07056 * z * z * z + 1.5976 * z)))


def _two_sided(z: Column) -> Column:
    return 2 * _normal(-F.abs(z))


def _alphabet(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-f]+$"), HEXES).when(s.rlike("^[0-9A-F]+$"), HEXES.upper()).when(s.rlike("^[A-Z2-7]+$"), BASE32).when(s.rlike("^[A-Za-z0-9]+$"), ALNUM).otherwise(BASE64)


def randomness(s: Column) -> Column:
    """The battery's p-value of a string under a uniform source over its inferred alphabet."""
    s = F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/")
    with_all = F.transform(F.array(F.struct(s.alias("s"), _alphabet(s).alias("a"))), lambda x: F.struct(x["s"].alias("s"), x["a"].alias("a"), F.length(x["s"]).cast("double").alias("n"), F.length(x["a"]).cast("double").alias("k"), F.filter(F.split(x["s"], ""), lambda c: c != "").alias("c")))
    numbered = F.transform(with_all, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), x["k"].alias("k"), F.array_distinct(x["c"]).alias("d"), F.transform(x["c"], lambda c: F.instr(x["a"], c).cast("double") - 1).alias("v")))

    def battery(x):
        n, k, v = x["n"], x["k"], x["v"]
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, y: t + y)
        squares = total(F.transform(x["d"], lambda c: F.pow(n - F.length(F.replace(x["s"], c, F.lit(""))), 2)))
        chi = k / n * squares - n
        uniform = _normal(-(chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        high = F.transform(v, lambda y: (y >= k / 2).cast("double"))
        up = total(high)
        pairs = lambda a: F.arrays_zip(F.slice(a, F.lit(1), F.size(a) - 1).alias("x"), F.slice(a, F.lit(2), F.size(a) - 1).alias("y"))
        runs = 1 + total(F.transform(pairs(high), lambda p: (p["x"] != p["y"]).cast("double")))
        mean = 2 * up * (n - up) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        by_runs = F.when(spread > 0, _two_sided((runs - mean) / F.sqrt(spread))).otherwise(0.0)
        mid = total(v) / n
        var = total(F.transform(v, lambda y: (y - mid) * (y - mid)))
        along = total(F.transform(pairs(v), lambda p: (p["x"] - mid) * (p["y"] - mid)))
        serial = F.when(var > 0, _two_sided(along / var * F.sqrt(n))).otherwise(0.0)
        return F.round(F.least(F.lit(1.0), 3 * F.least(uniform, by_runs, serial)), 9)

    return F.when(F.length(s) < 2, 0.0).otherwise(F.transform(numbered, battery)[0])


def _class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 2).cast("int")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``(doc_id, base, found)``: arrays of spans (start, kind, end, hit); ``found`` holds the base and the random ones.

    Null texts count as empty and have no spans; ids may be null or repeat; no rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("x"))
    assign = F.filter(_found(F.col("x"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    access = F.filter(_found(F.col("x"), ACCESS, 1), lambda s: F.length(s["hit"]) >= 20)
    other = F.filter(_found(F.col("x"), CANDIDATE, 3), lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]"))
    rows = rows.select("doc_id", F.array_sort(F.concat(assign, access, _found(F.col("x"), HEX, 2))).alias("base"), F.transform(other, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"), randomness(s["hit"]).alias("p"))).alias("more"))
    rows = materialise(rows, "spans")
    bins = rows.select(F.explode("more").alias("m")).select(_class(F.length("m.hit")).alias("c"), F.floor(F.col("m.p") * BINS).cast("int").alias("b")).groupBy("c", "b").count().collect()  # classes times bins at most
    cuts = {c: _cut({r.b: r["count"] for r in bins if r.c == c}, rate) for c in {r.c for r in bins}}
    cut_of = lambda n: reduce(lambda e, c: F.when(_class(n) == c, F.lit(float(cuts[c]))).otherwise(e), sorted(cuts), F.lit(-1.0))
    drawn = F.filter("more", lambda m: m["p"] > cut_of(F.length(m["hit"])))
    drawn = F.filter(drawn, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    drawn = F.transform(drawn, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["hit"].alias("hit")))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", drawn)).alias("found"))


def _cut(bins: dict[int, int], rate: float) -> float:
    """The greatest bin edge that Benjamini-Hochberg rejects at ``rate`` (-1: none)."""
    total, below, best = sum(bins.values()), 0, -1.0
    for b in sorted(bins):
        below += bins[b]
        if (b + 1) / BINS <= rate * below / total:
            best = (b + 1) / BINS
    return best


def _joined(spans) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select("doc_id", *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op8_secret_scan": query}
ORACLES: dict[str, str] = {}
