"""Scores of retrieval and answers, metrics over them, and the reviewers' verdicts on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.operators.search import fetched
from lexiquarry.session import materialise

# What a reviewer may say.
VERDICTS = ("correct", "wrong", "refusal", "bad-question")


def scored(questions: DataFrame, hits: DataFrame, chunks: DataFrame, answers: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """A result row for each question; what does not apply to it is null.

    ``hits`` come from a retriever (query_id is the question's id); ``answers (query_id, generated, generation_error)`` are optional.
    Ranks are over distinct documents.
    """
    hits = materialise(hits, "hits")
    places = hits.groupBy("query_id", F.col("doc_id").cast("string").alias("doc")).agg(F.min("rank").alias("r")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("r")))
    gold = questions.select(F.col("id").alias("query_id"), "gold_doc")
    docs = places.join(gold, "query_id", "left").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "doc"))), lambda x: x["doc"]).alias("retrieved"),
        F.max(F.when(F.col("doc") == F.col("gold_doc"), F.col("place"))).alias("rank"),
        F.min_by("doc", "place").alias("first"),
    )
    norm = lambda c: T.plain_scored(c, ascii_only)
    wanted = questions.where("answer is not null and answer <> ''").select(F.col("id").alias("query_id"), F.col("gold_doc").alias("g"), norm("answer").alias("want"))
    have = fetched(chunks, hits, "text").select("chunk_id", norm("text").alias("have"))  # only what was retrieved is decomposed
    texts = hits.join(wanted, "query_id").join(have, "chunk_id")
    held = texts.withColumn("ok", T.holds_answer("have", "want")).groupBy("query_id").agg(F.bool_or("ok").alias("in_any"), F.coalesce(F.bool_or(F.when(F.col("doc_id").cast("string") == F.col("g"), F.col("ok"))), F.lit(False)).alias("in_gold"))
    rows = questions.join(docs.withColumnRenamed("query_id", "_a"), F.col("id") == F.col("_a"), "left").join(held.withColumnRenamed("query_id", "_b"), F.col("id") == F.col("_b"), "left")
    has_gold, has_answer = F.coalesce("gold_doc", F.lit("")) != "", F.coalesce("answer", F.lit("")) != ""
    hit = F.when(has_gold, F.col("rank").isNotNull())
    out = rows.select(
        "id", "type", "question", "gold_doc", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), "corpus_occurrences", F.col("answer").alias("expected"),
        F.when(has_answer, F.coalesce("in_any", F.lit(False))).alias("answer_in_context"), F.when(has_answer & has_gold, F.coalesce("in_gold", F.lit(False))).alias("answer_in_gold_context"),
        hit.alias("hit"), F.when(has_gold, F.col("rank")).alias("rank"), F.when(has_gold & F.col("rank").isNull(), F.col("first")).alias("confused_with"),
    )
    if answers is None:
        return out.select("*", F.lit(None).cast("string").alias("generated"), F.lit(None).cast("boolean").alias("refused"), F.lit(None).cast("boolean").alias("answer_correct"), F.lit(None).cast("string").alias("generation_error"))
    both = out.join(answers.withColumnRenamed("query_id", "_q"), F.col("id") == F.col("_q"), "left")
    said, want = norm("generated"), norm("expected")
    told = F.col("generated").isNotNull()
    refused = F.when(told, T.is_refusal(said))
    right = F.when(told & F.coalesce("expected", F.lit("")).eqNullSafe(""), refused).when(told, T.holds_answer(said, want))
    return both.select(*out.columns, "generated", refused.alias("refused"), right.alias("answer_correct"), "generation_error")


def share_of(part: Column, whole: Column) -> Column:
    """Null where there is nothing to take a share of."""
    return F.when(whole > 0, part / whole)


def rounded(x: Column, digits: int = 6) -> Column:
    """Half away from zero after scaling, as SQL engines round doubles; ``F.round`` goes by the decimal digits that a double prints, so the two part ways where the share lies half-way."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def reciprocals(rank: Column) -> Column:
    """The sum of 1 / rank, in decimals of 24 places: doubles would add up to other last bits in another order of rows, and shares that lie half-way would round either way."""
    return F.coalesce(F.sum((F.lit(1).cast("decimal(25,24)") / rank.cast("decimal(10,0)")).cast("decimal(38,24)")).cast("double"), F.lit(0.0))


def answerable() -> Column:
    return F.coalesce("gold_doc", F.lit("")) != ""


def retrieval_metrics(results: DataFrame, by: str | None = None) -> DataFrame:
    """Questions, hit rate, mean reciprocal rank over all answerable ones, first places; whether the answer was retrieved, and from the right document."""
    rows = results.where(answerable())
    n = F.count("*")
    got = F.count_if("answer_in_context"), F.count_if("answer_in_gold_context")
    known = F.count("answer_in_gold_context")
    hits = F.count_if("hit")
    return (rows.groupBy(by) if by else rows.groupBy()).agg(
        n.alias("questions"), hits.alias("hits"), rounded(share_of(hits, n)).alias("hit_rate"), rounded(share_of(reciprocals(F.col("rank")), n)).alias("mrr"), F.count_if(F.col("rank") == 1).alias("first"),
        got[0].alias("in_context"), got[1].alias("in_gold_context"), rounded(share_of(hits - got[1], known)).alias("gap"),
    )


def scorable(most: int = 5) -> Column:
    """Scored, and the answer is not spread over too many documents."""
    return F.col("answer_correct").isNotNull() & (F.coalesce(F.expr("nullif(corpus_occurrences, 0)"), F.lit(1)) <= most)


def answer_metrics(results: DataFrame, most: int = 5) -> DataFrame:
    asked = answerable()
    counted = scorable(most) & asked
    right, n = F.count_if(counted & F.col("answer_correct")), F.count_if(counted)
    open_, said_no = F.count_if(~asked & F.col("generated").isNotNull()), F.count_if(~asked & F.col("refused"))
    return results.agg(
        n.alias("counted"), right.alias("correct"), rounded(share_of(right, n)).alias("accuracy"), F.count_if(asked & F.col("answer_correct").isNotNull() & ~scorable(most)).alias("excluded"),
        F.count_if(F.coalesce("generation_error", F.lit("")) != "").alias("errors"), open_.alias("unanswerable"), said_no.alias("refused"), rounded(share_of(said_no, open_)).alias("refusal_rate"), F.count_if(asked & F.col("refused")).alias("wrong_refusals"),
    )


def needs_review() -> Column:
    """Scored wrong although an answer came back."""
    return F.coalesce((F.col("answer_correct") == False) & (F.coalesce("generated", F.lit("")) != "") & (F.coalesce("generation_error", F.lit("")) == ""), F.lit(False))  # noqa: E712


def with_keys(results: DataFrame) -> DataFrame:
    return results.withColumn("answer_key", T.answer_key("id", "question", "generated"))


def pending(results: DataFrame, verdicts: DataFrame, everything: bool = False) -> DataFrame:
    """Results that await a verdict."""
    rows = with_keys(results if everything else results.where(needs_review()))
    return rows.join(verdicts.select("answer_key"), "answer_key", "left_anti")


def overlaid(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Results with ``verdict`` and ``effective_correct``: a reviewer's word goes before the automatic score."""
    rows = with_keys(results).join(verdicts.select("answer_key", "verdict"), "answer_key", "left")
    v = F.col("verdict")
    return rows.withColumn("effective_correct", F.when(v == "correct", True).when(v.isin("wrong", "refusal"), False).when(v == "bad-question", F.lit(None)).otherwise(F.col("answer_correct")))


def verdict_report(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Accuracy before and after review; bad questions do not count."""
    rows = overlaid(results, verdicts).where(F.coalesce("gold_doc", F.lit("")) != "")
    v = F.coalesce("verdict", F.lit(""))
    n, auto = F.count("answer_correct"), F.count_if("answer_correct")
    bad, no = F.count_if(v == "bad-question"), F.count_if(v == "refusal")
    right = F.count_if(F.coalesce("effective_correct", F.lit(False)))
    return rows.agg(
        n.alias("answers"), auto.alias("automated"), right.alias("reviewed"), bad.alias("bad_questions"), no.alias("refusals"), F.count_if(needs_review() & (v == "")).alias("unjudged"),
        rounded(share_of(auto, n)).alias("automated_accuracy"), rounded(share_of(right, n - bad)).alias("reviewed_accuracy"), rounded(share_of(right, n - bad - no)).alias("accuracy_without_refusals"),
    )


def drop_bad(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    bad = verdicts.where("verdict = 'bad-question'").select(F.col("id").alias("_id"))
    return questions.join(bad, F.col("id") == F.col("_id"), "left_anti")
