"""Question sets: candidate answers, verification against the corpus, builders, import, leakage, ablation, merging."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.functions.needles import SLICE, Needles, keys
from lexiquarry.operators.prefix import running
from lexiquarry.session import materialise, small

#: How questions are worded, by the field that answers them (1: the agency, 2: the subject).
WORDING = {
    "comments_close_on": "When does %1$s stop taking comments about %2$s?",
    "effective_on": "When does what %1$s decided about %2$s come into force?",
    "docket_ids": "Under which docket did %1$s file %2$s?",
    "regulation_id_numbers": "Which RIN did %1$s give to %2$s?",
}
#: Questions that documents leave open, with the reason.
UNANSWERED = (
    ("How large is the fine that %1$s sets for breaking %2$s?", "documents name no fine"),
    ("How many letters did %1$s get about %2$s?", "documents count no letters"),
)
#: A subject made up for a question; the phrase must be in no document.
FABRICATED = "tidal kite mooring permits"
INVENTED = f"When do applications for {FABRICATED} open?"
MOST = 10  # documents that may state an answer


def seeded(c: Column, seed: int = 0) -> Column:
    """A fixed random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def subject(title) -> Column:
    """A short name for a document, from its title: the first part "for" the others, 140 characters at most."""
    title = T.strip(F.coalesce(T._col(title), F.lit("")))
    parts = F.filter(F.transform(F.split(title, ";"), T.strip), lambda p: p != "")
    joined = F.concat(F.try_element_at(parts, F.lit(1)), F.lit(" for "), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), ", "))
    return F.left(F.regexp_replace(F.when(F.size(parts) >= 2, joined).otherwise(title), r"(?U)\s*[;,]\s*\z", ""), F.lit(140))


def _agency() -> Column:
    return F.coalesce(F.try_element_at("agency_names", F.lit(1)), F.lit("the agency"))


def worded(field: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, wording in WORDING.items():
        out = F.when(field == name, F.format_string(wording, _agency(), subject("title"))).otherwise(out)
    return out


def candidates(docs: DataFrame, id_col: str = "document_number") -> DataFrame:
    """``(doc_id, place, field, answer, question)``: dates first, then up to two dockets and one identifier."""
    one = lambda f, a: F.array(F.struct(F.lit(f).alias("field"), a.alias("answer")))
    many = lambda f, n: F.transform(F.slice(F.coalesce(f, F.array().cast("array<string>")), 1, n), lambda a: F.struct(F.lit(f).alias("field"), a.alias("answer")))
    all_ = F.concat(one("comments_close_on", T.spelled_date("comments_close_on")), one("effective_on", T.spelled_date("effective_on")), many("docket_ids", 2), many("regulation_id_numbers", 1))
    rows = docs.withColumn("_c", F.filter(all_, lambda x: x["answer"].isNotNull())).select("*", F.posexplode("_c").alias("place", "_a"))
    return rows.select(F.col(id_col).alias("doc_id"), "place", F.col("_a.field").alias("field"), F.col("_a.answer").alias("answer"), worded(F.col("_a.field")).alias("question"))


def _told(needles: DataFrame) -> DataFrame:
    """``(first, both, size)`` of needles ``(f)``."""
    schema = pa.schema([("first", pa.int64()), ("both", pa.int64()), ("size", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                first, both, size = keys(*T.laid(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(both.view(np.int64)), pa.array(size)], schema=schema)

    return needles.select(F.col("f").cast("binary")).mapInArrow(run, "first long, both long, size long")


def occurrences(docs: DataFrame, needles: DataFrame, id_col: str = "document_number", form=None, most: int = 4_000_000) -> DataFrame:
    """``(needle, doc_id)``: which documents hold which needle, both in ``form`` (lower case if None).

    Needles are a question set's answers. They go out as numbers (:mod:`lexiquarry.functions.needles`), 24 bytes for each and ``most`` at once, and each text is read once for
    all of these; so the work follows the text and not texts times needles. An empty needle is in every document.
    """
    form = form or F.lower
    kind = docs.schema[id_col].dataType.simpleString()
    distinct = materialise(needles.select(form(F.col("needle")).alias("f"), "needle").distinct().where("f is not null"), "needles")
    told = materialise(_told(distinct.select("f").distinct()), "told")
    n = max(1, -(-told.count() // most))
    texts = docs.select(F.col(id_col).alias("doc_id"), form(F.coalesce("text", F.lit(""))).cast("binary").alias("t"))
    out = None
    for block in range(n):
        some = told.where(F.pmod(F.xxhash64("first", "both"), F.lit(n)) == block).toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(some.column(c).to_numpy() for c in ("first", "both", "size")))

        def find(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            first, both, size = shared.value
            known = Needles(first.view(np.uint64), both.view(np.uint64), size)
            for whole in source:
                step = max(1, int(whole.num_rows * SLICE * 8 / max(1, whole.nbytes)))
                for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                    data, offsets = T.laid(batch.column(1))
                    text, start, size = known.find(data, offsets)
                    ends = np.cumsum(size)
                    held = data[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
                    found = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(held)]).cast(pa.binary())
                    if known.empty:
                        found = pa.concat_arrays([found, pa.array([b""] * batch.num_rows, pa.binary())])
                        text = np.append(text, np.arange(batch.num_rows))
                    yield pa.RecordBatch.from_arrays([found, batch.column(0).take(pa.array(text))], ["f", "doc_id"])

        part = texts.mapInArrow(find, f"f binary, doc_id {kind}").select(F.col("f").cast("string").alias("f"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out.join(small(distinct), "f").select("needle", "doc_id")


def verified(cands: DataFrame, docs: DataFrame, most: int = MOST, id_col: str = "document_number") -> DataFrame:
    """Candidates that their own document states, and at most ``most`` documents in all, with ``corpus_occurrences``."""
    cands = materialise(cands, "candidates")
    found = materialise(occurrences(docs, cands.select(F.col("answer").alias("needle")), id_col), "found")
    counts = found.groupBy("needle").agg(F.countDistinct("doc_id").alias("corpus_occurrences")).where(F.col("corpus_occurrences") <= most)
    own = found.select(F.col("needle").alias("answer"), "doc_id").distinct()
    return cands.join(own, ["answer", "doc_id"], "left_semi").join(counts, F.col("answer") == F.col("needle")).drop("needle")


def _shape(df: DataFrame, kind: str, distractors=None, note=None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"), "question", "answer", "answer_field", "gold_doc",
        (F.array().cast("array<string>") if distractors is None else distractors).alias("distractors"),
        "corpus_occurrences", F.lit(note).cast("string").alias("note") if note is None or isinstance(note, str) else note.alias("note"), F.col("_o").alias("_order"),
    )


def fact_questions(checked: DataFrame, limit: int, used: dict[str, int] | None = None, share: float = 0.4, seed: int = 0) -> DataFrame:
    """Up to ``limit`` questions, one for a document; a field has at most ``share`` of them unless too few are left otherwise.

    ``checked`` are verified candidates. Documents come in a seeded order, and each takes its first candidate of a field that isn't full by then. So up to where the next
    field is full, a document's choice depends on the open fields alone: each step finds that place from the first few choices of each field, accepts what lies
    before it, closes the field and goes on behind it. There are no more steps than fields, and nothing but places is collected.
    """
    most = max(1, int(limit * share))
    rows = materialise(checked.select("question", "answer", "field", "doc_id", "place", "corpus_occurrences").withColumn("_k", seeded(F.col("doc_id"), seed)), "checked")
    room = {f: most - (used or {}).get(f, 0) for f in sorted(r.field for r in rows.select("field").distinct().collect() if r.field is not None)}  # the fields that answers come from
    room, left, after, taken = {f: n for f, n in room.items() if n > 0}, limit, None, []
    place = F.struct("_k", "doc_id")

    def choices(of: DataFrame) -> DataFrame:
        """Each document's first candidate."""
        first = of.groupBy("_k", "doc_id").agg(F.min(F.struct("place", "question", "answer", "field", "corpus_occurrences")).alias("x"))
        return first.select("_k", "doc_id", "x.question", "x.answer", "x.field", "x.corpus_occurrences")

    def last(of: DataFrame, n: int, name: str | None) -> DataFrame:
        return of.orderBy("_k", "doc_id").limit(n).agg(F.lit(name).alias("field"), F.count("*").alias("n"), F.max(place).alias("at"))

    while room and left > 0:
        rest = rows.where(F.col("field").isin(list(room)))
        if after is not None:
            rest = rest.where((F.col("_k") > after[0]) | ((F.col("_k") == after[0]) & (F.col("doc_id") > after[1])))
        chosen = choices(rest)
        ends = reduce(DataFrame.unionByName, [last(chosen.where(F.col("field") == f), min(n, left), f) for f, n in room.items()] + [last(chosen, left, None)]).collect()  # a row for each field
        full = [(tuple(r["at"]), r.field) for r in ends if r.n == (left if r.field is None else room[r.field])]
        stop = min((at for at, _ in full), default=None)
        got = chosen.orderBy("_k", "doc_id").limit(left)
        if stop is not None:
            got = got.where((F.col("_k") < stop[0]) | ((F.col("_k") == stop[0]) & (F.col("doc_id") <= stop[1])))
        taken.append(materialise(got.withColumn("_turn", F.lit(len(taken))), "facts"))
        counts = {r.field: r.n for r in taken[-1].groupBy("field").agg(F.count("*").alias("n")).collect()}
        left -= sum(counts.values())
        room = {f: n - counts.get(f, 0) for f, n in room.items() if n > counts.get(f, 0)}
        after = stop
        if stop is None:
            break
    if left > 0:  # too few: whatever documents are left have to say
        rest = rows
        for some in taken:
            rest = rest.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")  # at most limit rows
        taken.append(choices(rest).orderBy("_k", "doc_id").limit(left).withColumn("_turn", F.lit(len(taken))))
    if not taken:
        taken = [choices(rows.where("false")).withColumn("_turn", F.lit(0))]
    ordered = running(reduce(DataFrame.unionByName, taken), [F.col("_turn"), F.col("_k"), F.col("doc_id")], name="_o")
    return _shape(ordered.select("question", "answer", F.col("field").alias("answer_field"), F.col("doc_id").cast("string").alias("gold_doc"), "corpus_occurrences", "_o"), "fact")


def discriminator_questions(checked: DataFrame, clustered: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """One question for each family of near duplicates, larger families first, with up to eight siblings as distractors."""
    member = checked.join(clustered, "doc_id")
    pick = F.row_number().over(Window.partitionBy("cluster_id").orderBy(seeded(F.col("doc_id"), seed), "doc_id", "place"))
    picked = member.withColumn("_n", pick).where("_n = 1").orderBy(F.desc("size"), "cluster_id").limit(limit)
    picked = materialise(picked.withColumn("_o", F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id")).cast("long")), "picked")
    near = clustered.join(F.broadcast(picked.select("cluster_id", F.col("doc_id").alias("gold"))), "cluster_id").where("doc_id <> gold")  # limit rows
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy(seeded(F.col("doc_id"), seed), "doc_id"))).where("_n <= 8")
    near = near.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("doc_id").cast("string").alias("d")))).alias("s"))
    rows = picked.join(near, "cluster_id", "left").select("question", "answer", F.col("field").alias("answer_field"), F.col("doc_id").cast("string").alias("gold_doc"), "corpus_occurrences", F.transform("s", lambda x: x["d"]).alias("d"), "_o")
    return _shape(rows, "discriminator", F.coalesce("d", F.array().cast("array<string>")))


def unanswerable_questions(docs: DataFrame, limit: int, seed: int = 0, id_col: str = "document_number", probe: DataFrame | None = None) -> DataFrame:
    """Questions that no document answers: real documents asked for what they lack, and an invented subject if no text names it."""
    key = seeded(F.col(id_col), seed)
    some = docs.select(id_col, "title", "agency_names", key.alias("_k")).orderBy("_k", id_col).limit(limit)
    some = some.withColumn("_w", F.conv(F.substring("_k", 1, 4), 16, 10).cast("int") % len(UNANSWERED)).withColumn("_o", F.row_number().over(Window.orderBy("_k", id_col)).cast("long"))
    question, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (wording, why) in enumerate(UNANSWERED):
        question = F.when(F.col("_w") == i, F.format_string(wording, _agency(), subject("title"))).otherwise(question)
        note = F.when(F.col("_w") == i, why).otherwise(note)
    null = F.lit(None).cast("string")
    real = some.select(question.alias("question"), null.alias("answer"), null.alias("answer_field"), null.alias("gold_doc"), F.lit(None).cast("long").alias("corpus_occurrences"), F.array(F.col(id_col).cast("string")).alias("d"), note.alias("n"), "_o")
    named = docs.where(F.contains(F.lower("text"), F.lit(FABRICATED))).limit(1)
    fake = docs.sparkSession.range(1).join(named.select(F.lit(1).alias("_hit")), how="left").where("_hit is null").select(F.lit(INVENTED).alias("question"), null.alias("answer"), null.alias("answer_field"), null.alias("gold_doc"), F.lit(None).cast("long").alias("corpus_occurrences"), F.array().cast("array<string>").alias("d"), F.lit("its subject is made up").alias("n"), F.lit(1 << 40).cast("long").alias("_o"))
    return _shape(real.unionByName(fake), "unanswerable", F.col("d"), F.col("n"))


def numbered(df: DataFrame, prefix: str = "q", order=("_order",)) -> DataFrame:
    """``df`` with ids like q001 in ``order``."""
    return running(df, [F.col(c) for c in order], name="_at0").withColumn("id", F.format_string(prefix + "%03d", F.col("_at0") + 1)).drop("_at0")


def question_set(docs: DataFrame, source: DataFrame, clustered: DataFrame, n: int = 60, share_discriminator: float = 0.25, share_unanswerable: float = 0.15, seed: int = 0, id_col: str = "document_number") -> DataFrame:
    """Discriminators, then facts from other documents, then unanswerable ones; distinct by wording, numbered."""
    want_d, want_u = int(n * share_discriminator), int(n * share_unanswerable)
    stated = materialise(verified(candidates(docs, id_col), docs, id_col=id_col), "stated")
    disc = materialise(discriminator_questions(stated, clustered, want_d, seed), "discriminators")
    used = {r.answer_field: r.n for r in disc.groupBy("answer_field").agg(F.count("*").alias("n")).collect()}  # four fields
    checked = (stated if source is docs else verified(candidates(source, id_col), docs, id_col=id_col)).join(small(disc.select(F.col("gold_doc").alias("_g"))), F.col("doc_id").cast("string") == F.col("_g"), "left_anti")
    facts = fact_questions(checked, n - want_d - want_u, used, seed=seed)
    parts = [df.withColumn("_part", F.lit(i)) for i, df in enumerate((disc, facts, unanswerable_questions(source, want_u, seed, id_col)))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("question").orderBy("_part", "_order"))).where("_n = 1")
    return numbered(first, "q", ("_part", "_order")).drop("_part", "_order", "_n")


def duplicate_questions(questions: DataFrame) -> DataFrame:
    """``(key, size, ids)`` of answerable questions that use the same words."""
    asked = questions.where(F.coalesce("gold_doc", F.lit("")) != "")
    return asked.groupBy(T.question_key("question").alias("key")).agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("ids")).where("size > 1")


def drop_duplicates(questions: DataFrame) -> DataFrame:
    gone = duplicate_questions(questions).select(F.explode("ids").alias("_id"))
    return questions.join(gone, F.col("id") == F.col("_id"), "left_anti")


def term_documents(docs: DataFrame, id_col: str = "document_number", terms: DataFrame | None = None) -> DataFrame:
    """``(term, doc_id, df)``: title and text's distinct terms (of ``terms (term)`` only, if given), with the number of documents that have each."""
    title = F.coalesce("title", F.lit("")) if "title" in docs.columns else F.lit("")
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", title, T.without_masthead("text"))))).alias("term"))
    each = materialise(each if terms is None else each.join(small(terms), "term", "left_semi"), "terms")
    return each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term")


def leakage(questions: DataFrame, docs: DataFrame, most: int = 5, id_col: str = "document_number") -> DataFrame:
    """``(id, type, gold_doc, rarest_df, fingerprint_terms, rare_terms)``: words of a question that few documents have, its own among them."""
    asked = materialise(questions.select("id", "type", "gold_doc", F.explode_outer(T.content_terms("question")).alias("term")), "asked")
    rare = term_documents(docs, id_col, asked.select("term").where("term is not null").distinct()).where(F.col("df") <= most)
    hits = asked.join(rare.select("term", F.col("doc_id").cast("string").alias("gold_doc"), "df"), ["term", "gold_doc"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("r"))
    rows = questions.select("id", "type", "gold_doc").join(hits, "id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<df:bigint,term:string>>")))
    return rows.select("id", "type", "gold_doc", F.try_element_at("r", F.lit(1))["df"].alias("rarest_df"), F.transform(F.filter("r", lambda x: x["df"] == 1), lambda x: x["term"]).alias("fingerprint_terms"), F.transform("r", lambda x: x["term"]).alias("rare_terms"))


def leakage_report(rows: DataFrame) -> DataFrame:
    answerable = F.coalesce("gold_doc", F.lit("")) != ""
    finger, rare = F.size("fingerprint_terms") > 0, F.size("rare_terms") > 0
    return rows.where(answerable).groupBy("type").agg(F.count("*").alias("questions"), F.count_if(finger).alias("fingerprinted"), F.count_if(~finger & rare).alias("rare_only"), F.count_if(~rare).alias("clean"))


def ablated(questions: DataFrame, rows: DataFrame, strict: bool = False, least: int = 3) -> DataFrame:
    """Questions without their fingerprint terms (``removed_terms``); those left with too little are dropped, others pass unchanged."""
    terms = rows.select(F.col("id").alias("_id"), F.col("fingerprint_terms").alias("_f"))
    both = questions.join(terms, F.col("id") == F.col("_id"), "left")
    hit = F.coalesce(F.size("_f") > 0, F.lit(False))
    both = both.withColumn("question", F.when(hit, T.ablate("question", F.coalesce("_f", F.array().cast("array<string>")), strict)).otherwise(F.col("question"))).withColumn("removed_terms", F.when(hit, F.col("_f")))
    return both.where(~hit | ~T.is_degenerate("question", least)).drop("_id", "_f")


def imported(records: DataFrame, docs: DataFrame, id_col: str = "document_number") -> DataFrame:
    """Hand-written ``(gold_doc, question, answer)`` held against the corpus: ``status`` is accepted, or what is wrong."""
    records = materialise(records.select(F.monotonically_increasing_id().alias("_r"), "gold_doc", "question", "answer"), "records")
    wanted = records.join(docs.select(F.col(id_col).cast("string").alias("gold_doc"), F.lit(True).alias("known"), F.coalesce("title", F.lit("")).alias("title")), "gold_doc", "left")
    form = lambda c: T.plain_imported(c)
    cleaned = docs.select(F.col(id_col).cast("string").alias("_d"), T.without_masthead("text").alias("text"))
    needles = records.where("answer is not null").select(F.col("answer").alias("needle"))
    found = materialise(occurrences(cleaned, needles, "_d", form).distinct(), "found")
    counts = found.groupBy("needle").agg(F.count("*").alias("n")).withColumnRenamed("needle", "_n1")
    own = found.select(F.col("needle").alias("_n2"), F.col("doc_id").alias("_d2"), F.lit(True).alias("stated"))
    rows = wanted.join(counts, F.col("answer") == F.col("_n1"), "left").join(own, (F.col("answer") == F.col("_n2")) & (F.col("gold_doc") == F.col("_d2")), "left")
    refusal = F.col("answer").isNull()
    status = F.when(F.col("known").isNull(), "document not in corpus").when(refusal, "accepted").when(F.col("stated").isNull(), "answer text not found in that document").otherwise("accepted")
    rows = rows.withColumn("status", status)
    none = F.array().cast("array<string>")
    return rows.select(
        F.when(refusal, "unanswerable").otherwise("manual").alias("type"), "question", "answer", F.when(~refusal, "manual").alias("answer_field"),
        F.when(refusal & (F.col("status") == "accepted"), F.lit(None)).otherwise(F.col("gold_doc")).alias("gold_doc"), F.when(refusal, F.array("gold_doc")).otherwise(none).alias("distractors"),
        F.when(~refusal, F.col("n")).alias("corpus_occurrences"), F.when(~refusal, T.reused_words("question", "title")).alias("title_words_reused"), "status", F.col("_r").alias("_order"),
    )


def merged(manual: DataFrame | None, generated: DataFrame | None, prefix: str = "q") -> DataFrame:
    """Both sets in one, manual first, numbered anew; either may be missing."""
    parts = [df.withColumn("_part", F.lit(i)).withColumn("_at", F.col("id")) for i, df in enumerate((manual, generated)) if df is not None]
    if not parts:
        raise ValueError("there is nothing to merge")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return numbered(both.drop("id"), prefix, ("_part", "_at")).drop("_part", "_at")


def passages(docs: DataFrame, limit: int = 6, id_col: str = "document_number") -> DataFrame:
    """``(doc_id, place, line)``: a document's lines that likely hold a fact: labelled ones first, then ones with a year, time or amount."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("line", T.strip("line")).where("line <> ''")
    lines = lines.withColumn("tier", F.when(F.col("line").rlike(T.FACT_LINE), 0).when(F.col("line").rlike(T.VALUE_LINE), 1)).where("tier is not null")
    again = F.row_number().over(Window.partitionBy("doc_id", "tier", "line").orderBy("at"))
    lines = lines.withColumn("_n", again).where("tier = 0 or _n = 1")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("tier", "at"))
    return lines.withColumn("place", place).where(F.col("place") <= limit).select("doc_id", "place", "line")
