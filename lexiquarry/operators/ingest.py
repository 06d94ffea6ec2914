"""Source details to document records, and what a corpus looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry import schemas
from lexiquarry.functions import text as T
from lexiquarry.operators.duplicates import at_positions

LEAST_CHARS = 200


def agency_names(c="agencies"):
    """Distinct names in order, the raw name where there is no other."""
    filled = lambda x: F.nullif(x, F.lit(""))
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<name:string,raw_name:string>>")), lambda a: F.coalesce(filled(a["name"]), filled(a["raw_name"]))), lambda n: n.isNotNull()))


def cfr_references(c="cfr_references"):
    """Distinct labels like "40 CFR 52", in order."""
    refs = F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<title:bigint,part:bigint>>")), lambda r: r["title"].isNotNull())
    return F.array_distinct(F.transform(refs, lambda r: F.concat_ws(" ", r["title"].cast("string"), F.lit("CFR"), r["part"].cast("string"))))


def records(details: DataFrame, text_col: str = "text") -> DataFrame:
    """Document rows from detail rows: empty values become null, counts are added."""
    kinds = dict(details.dtypes)
    kept = []
    for name in schemas.KEPT:
        if name in kinds:
            c = F.col(name)
            kept.append((F.nullif(c, F.lit("")) if kinds[name] == "string" else F.when(F.size(c) > 0, c) if kinds[name].startswith("array") else c).alias(name))
    refs = cfr_references()
    return details.select(*kept, agency_names().alias("agency_names"), F.when(F.size(refs) > 0, refs).alias("cfr_references"), F.col(text_col).alias("text"), F.length(text_col).cast("long").alias("char_count"), F.size(T.words(text_col)).cast("long").alias("word_count"))


def is_correction():
    """A correction of another document, by reference or by its number."""
    return (F.coalesce("correction_of", F.lit("")) != "") | F.coalesce("document_number", F.lit("")).rlike(T.CORRECTION_ID)


def accepted(docs: DataFrame, least_chars: int = LEAST_CHARS, least_words: int = 0) -> DataFrame:
    return docs.where(~is_correction() & (F.length("text") >= least_chars) & (F.coalesce("word_count", F.lit(0)) >= least_words))


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``day``: Mondays to Fridays from ``start`` to ``end``."""
    if start > end:
        raise ValueError("start is after end")
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("day"))
    return days.where(F.weekday("day") < 5)


def recent_days(spark: SparkSession, today: str | None = None, back: int = 30) -> DataFrame:
    """The business days of the ``back`` days up to ``today``, which is what an ingestion that names no dates asks for."""
    from datetime import date, timedelta

    end = date.fromisoformat(today) if today else date.today()
    return business_days(spark, (end - timedelta(days=back)).isoformat(), end.isoformat())


def covered_days(docs: DataFrame, date_col: str = "publication_date", back: int | None = None) -> DataFrame:
    """``(day, n)``: the business days of a table, from its first date to its last, or of the ``back`` days up to the last, with how many rows each has; days without any are there."""
    days = docs.select(F.try_to_date(F.col(date_col).cast("string").substr(1, 10)).alias("day")).where("day is not null")
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    first = F.col("first") if back is None else F.date_sub("last", back)
    open_ = ends.where("last is not null").select(F.explode(F.sequence(first, F.col("last"))).alias("day")).where(F.weekday("day") < 5)
    return open_.join(days.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def new_only(incoming: DataFrame, present: DataFrame, key: str = "document_number") -> DataFrame:
    """Rows whose key is not there yet."""
    return incoming.join(present.select(key).distinct(), key, "left_anti")


def corpus_stats(docs: DataFrame, id_col: str = "document_number", date_col: str | None = "publication_date") -> DataFrame:
    """One row: documents, words, their whole-number mean, the longest document, first and last date."""
    dates = [F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date")] if date_col else []
    return docs.agg(F.count("*").alias("documents"), F.sum("word_count").alias("words"), F.expr("sum(word_count) div count(*)").alias("mean_words"), F.min_by(id_col, F.struct(-F.col("word_count"), id_col)).alias("longest"), *dates)


def type_counts(docs: DataFrame, col: str = "type") -> DataFrame:
    return docs.groupBy(F.coalesce(col, F.lit("?")).alias(col)).agg(F.count("*").alias("n"))


def top_agencies(docs: DataFrame, n: int = 10) -> DataFrame:
    return docs.select(F.explode("agency_names").alias("agency")).groupBy("agency").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agency").limit(n)


def coverage(docs: DataFrame) -> DataFrame:
    """``(field, share)`` of documents in which a field is filled."""
    filled = [F.avg((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("double") if not k.startswith("array") else (F.coalesce(F.size(c), F.lit(0)) > 0).cast("double")).alias(c) for c, k in docs.dtypes]
    one = docs.agg(*filled)
    return one.unpivot([], list(docs.columns), "field", "share")


def length_distribution(docs: DataFrame, words_col: str = "word_count") -> DataFrame:
    """Words at the quartiles and at 95 %, by position; whole-number median and mean; total."""
    spots = at_positions(docs, words_col, {"p25": 0.25, "p75": 0.75, "p95": 0.95, "mid": 0.5})
    half = at_positions(docs.withColumn("_w", -F.col(words_col)), "_w", {"other": 0.5})
    one = docs.agg(F.count("*").alias("documents"), F.min(words_col).alias("least"), F.max(words_col).alias("most"), F.sum(words_col).alias("words"), F.expr(f"sum({words_col}) div count(*)").alias("mean"))
    return one.join(F.broadcast(spots)).join(F.broadcast(half)).select("documents", "words", "least", "p25", F.expr("(mid - other) div 2").alias("median"), "p75", "p95", "most", "mean")  # single rows


def outliers(docs: DataFrame, share: float = 0.05, id_col: str = "document_number", words_col: str = "word_count") -> DataFrame:
    """Documents with over ``share`` of all words."""
    total = docs.agg(F.sum(words_col).alias("_total"))
    return docs.join(F.broadcast(total)).where(F.col(words_col) > share * F.col("_total")).select(F.col(id_col).alias("doc_id"), F.col(words_col).alias("words"))  # a single row


def round_robin(docs: DataFrame, key: str, order: str) -> DataFrame:
    """``turn``: the place of each row among those of its key."""
    return docs.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
