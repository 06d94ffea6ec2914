"""What a person reads after a step: question sets, imports, duplicates, leaks, reviews, development slices. Small tables, made without gathering rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.operators import evaluation
from lexiquarry.operators.duplicates import at_positions
from lexiquarry.operators.evaluation import answerable, share_of

# What a reviewer's key stands for.
CHOICES = {"c": "correct", "w": "wrong", "r": "refusal", "b": "bad-question"}
IDENTIFIERS = ("docket_ids", "regulation_id_numbers")


def preview(c, most: int = 88) -> Column:
    """A text on one line, cut to ``most`` characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.left(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), F.lit(most))


def first_questions(questions: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` questions by id; all of them if ``n`` is not given."""
    return questions.orderBy("id").limit(n) if n else questions


def duplicate_groups(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """One row over the groups of :func:`lexiquarry.operators.questions.duplicate_questions`: answerable questions, groups, questions in them and their share."""
    asked = questions.where(answerable()).agg(F.count("*").alias("questions"))
    found = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("affected"))
    return asked.join(F.broadcast(found)).select("questions", "groups", "affected", F.round(share_of(F.col("affected"), F.col("questions")), 6).alias("share"))  # single rows


def largest_groups(groups: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest groups of equal questions, ties by key."""
    return groups.orderBy(F.desc("size"), "key").limit(n)


def import_report(imported: DataFrame) -> DataFrame:
    """One row over imported records: accepted and rejected ones, refusal tests, answers that reuse title words, answers that other documents hold too."""
    ok = F.col("status") == "accepted"
    asked = ok & answerable()
    return imported.agg(
        F.count("*").alias("records"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(asked).alias("answerable"), F.count_if(ok & ~answerable()).alias("refusal_tests"),
        F.count_if(asked & (F.size("title_words_reused") > 0)).alias("leaky"), F.count_if(asked & (F.coalesce("corpus_occurrences", F.lit(1)) > 1)).alias("shared"),
    )


def questions_by_document(imported: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` documents with the most accepted questions that have an answer, ties by number."""
    rows = imported.where((F.col("status") == "accepted") & answerable())
    return rows.groupBy("gold_doc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_doc").limit(n)


def authored_report(authored: DataFrame) -> DataFrame:
    """One row: hand-written questions, those that stand clear of their title and those that reuse its words."""
    leaky = F.size("title_words_reused") > 0
    return authored.agg(F.count("*").alias("questions"), F.count_if(~leaky).alias("clean"), F.count_if(leaky).alias("leaky"))


def authored(records: DataFrame, docs: DataFrame, id_col: str = "document_number") -> DataFrame:
    """``(gold_doc, question, answer, status, title_words_reused)``: what a session makes of each record typed in.

    ``status``: skipped (no question or no answer), not in the document (the answer is not in its cleaned text, in normal form), or accepted.
    """
    own = docs.select(F.col(id_col).cast("string").alias("gold_doc"), T.plain(T.without_masthead("text")).alias("_t"), F.coalesce("title", F.lit("")).alias("_h"))
    filled = lambda c: T.strip(F.coalesce(c, F.lit(""))) != ""
    stated = F.coalesce(F.contains("_t", T.plain("answer")), F.lit(False))
    status = F.when(~filled("question") | ~filled("answer"), "skipped").when(~stated, "not in the document").otherwise("accepted")
    return records.join(own, "gold_doc", "left").select("gold_doc", "question", "answer", status.alias("status"), T.reused_words("question", F.coalesce("_h", F.lit("")), False).alias("title_words_reused"))


def slice_summary(docs: DataFrame) -> DataFrame:
    """One row: documents, words and agencies of a development slice."""
    agencies = docs.select(F.explode("agency_names").alias("a")).agg(F.countDistinct("a").alias("agencies"))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words")).join(F.broadcast(agencies))  # single rows


def starved(results: DataFrame) -> DataFrame:
    """Answerable questions whose document was retrieved, though not with a passage that holds the answer."""
    return results.where(answerable() & F.col("hit") & ~F.col("answer_in_gold_context"))


def misses(results: DataFrame) -> DataFrame:
    """Answerable questions whose document was not retrieved; ``confused_with`` is what came first."""
    return results.where(answerable() & ~F.col("hit"))


def common_fingerprints(leaks: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` terms that single out the most questions, ties by term."""
    return leaks.select(F.explode("fingerprint_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def question_set_report(questions: DataFrame) -> DataFrame:
    """One row over a question set: counts by type, documents, occurrences of answers (median: the upper one), the leading field, look-alikes, and warnings.

    ``keyword_heavy``: over half the answers are identifiers, which stand at the top of documents word for word. ``one_sided``: otherwise,
    one field gives over 60 % of the answers.
    """
    of = lambda t: F.count_if(F.col("type") == t)
    occ = F.coalesce("corpus_occurrences", F.lit(1))
    asked = answerable()
    base = questions.agg(
        F.count("*").alias("questions"), of("fact").alias("facts"), of("discriminator").alias("discriminators"), of("unanswerable").alias("unanswerable"), F.count_if(asked).alias("answerable"),
        F.countDistinct(F.when(asked, F.col("gold_doc"))).alias("documents"), F.count_if(asked & (occ == 1)).alias("unique_answers"), F.max(F.when(asked, occ)).alias("most_occurrences"),
        F.count_if(F.col("answer_field").isin(*IDENTIFIERS)).alias("by_identifier"), F.round(F.avg(F.when(F.col("type") == "discriminator", F.size("distractors"))), 6).alias("look_alikes"),
    )
    median = at_positions(questions.where(asked).select(occ.alias("o")), "o", {"median_occurrences": 0.5})
    fields = questions.where(F.col("answer_field").isNotNull()).groupBy("answer_field").agg(F.count("*").alias("c"))
    top = fields.agg(F.min_by("answer_field", F.struct(-F.col("c"), "answer_field")).alias("top_field"), F.max("c").alias("_top"))
    heavy = F.col("by_identifier") > 0.5 * F.col("answerable")
    rows = base.join(F.broadcast(median)).join(F.broadcast(top))  # single rows
    return rows.withColumn("keyword_heavy", heavy & (F.col("answerable") > 0)).withColumn("one_sided", ~F.col("keyword_heavy") & F.coalesce(F.col("_top") > 0.6 * F.col("answerable"), F.lit(False))).drop("_top")


def judged(results: DataFrame, choices: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Verdict rows with their context, from keys pressed: ``choices (id, choice)``; keys other than ``CHOICES`` decide nothing.

    With ``present`` verdicts what was judged before stays and is not asked again.
    """
    keys = F.create_map(*[F.lit(x) for pair in CHOICES.items() for x in pair])
    said = choices.select(F.col("id").alias("_id"), F.lower(T.strip("choice")).alias("_c")).where(F.col("_c").isin(*CHOICES))
    rows = evaluation.with_keys(results)
    if present is not None:
        rows = rows.join(present.select("answer_key"), "answer_key", "left_anti")
    new = rows.join(said, F.col("id") == F.col("_id")).select("answer_key", keys[F.col("_c")].alias("verdict"), "id", "question", "expected", "generated")
    return new if present is None else present.select(new.columns).unionByName(new)


def probed(details: DataFrame, kept: list[str], col: str = "detail") -> DataFrame:
    """``(field, n)``: how many of the source's records, JSON objects in ``col``, have each of the fields that are kept; a field that none has shows that the source renamed it."""
    seen = details.select(F.explode(F.json_object_keys(col)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    wanted = details.sparkSession.createDataFrame([(f,) for f in kept], "field string")
    return wanted.join(seen, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("n"))
