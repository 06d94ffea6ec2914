"""Queries, with SQL, for what the retrieval queries do not show: records, question making, import, matching, scores, reports, files.

``customer`` stands for a register of filings: each row becomes a document with dates or identifiers, an agency, and a text that states them.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import schemas
from lexiquarry.functions import text as T
from lexiquarry.operators import duplicates, evaluation, ingest, questions, reports, search
from lexiquarry.plans import catalogue, tables
from lexiquarry.plans.catalogue import ORACLES, query
from lexiquarry.plans.tables import PLAIN, TOKENS, TRIM, WORDS, cleaned, docs, table
from lexiquarry.session import materialise, scratch
from lexiquarry.sources import files

# ---------------------------------------------------------------- a register of filings

_DAY = "DATE '1997-01-01' + (c_custkey % 700)::INT"
FILINGS = f"""filings AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'C1-' ELSE 'D-' END || c_custkey AS document_number,
  CASE WHEN c_custkey % 5 = 0 THEN ' ' || c_mktsegment || ' ; ' ELSE c_mktsegment || '; ' || c_name || '; Part ' || (c_custkey % 9) || ' ,' END AS title,
  CASE WHEN c_custkey % 6 > 0 THEN 'Agency ' || c_nationkey % 7 END AS agency, c_nationkey AS family,
  CASE WHEN c_custkey % 4 = 0 THEN strftime({_DAY}, '%Y-%m-%d') END AS comments_close_on, CASE WHEN c_custkey % 4 = 1 THEN strftime({_DAY}, '%Y-%m-%d') END AS effective_on,
  CASE WHEN c_custkey % 4 = 2 THEN ['DKT-' || c_custkey || 'x', 'DKT-' || (c_custkey + 4) || 'x', 'DKT-0'] ELSE []::VARCHAR[] END AS docket_ids,
  CASE WHEN c_custkey % 4 = 3 THEN ['RIN-' || c_custkey || 'y', 'RIN-0'] ELSE []::VARCHAR[] END AS rins,
  'SUMMARY: ' || c_name || E'\\nplain words here\\nDATES: ' || strftime({_DAY}, '%B %-d, %Y') || E'\\n  Docket DKT-' || c_custkey || 'x and RIN-' || c_custkey || E'y\\n\\npaid $5 at 9:30 in 1999\\npaid $5 at 9:30 in 1999\\nEffective ' || repeat(c_mktsegment || ' ', (c_custkey % 12)::INT) AS text FROM customer)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    n = k.cast("string")
    day = F.date_add(F.lit("1997-01-01").cast("date"), (k % 700).cast("int"))
    iso = F.date_format(day, "yyyy-MM-dd")
    cat = lambda *a: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in a])
    none = F.array().cast("array<string>")
    return c.select(
        cat(F.when(k % 11 == 0, "C1-").otherwise("D-"), n).alias("document_number"),
        F.when(k % 5 == 0, cat(" ", F.col("c_mktsegment"), " ; ")).otherwise(cat(F.col("c_mktsegment"), "; ", F.col("c_name"), "; Part ", (k % 9).cast("string"), " ,")).alias("title"),
        F.when(k % 6 > 0, F.array(cat("Agency ", (F.col("c_nationkey") % 7).cast("string")))).otherwise(none).alias("agency_names"), F.col("c_nationkey").cast("long").alias("family"),
        F.when(k % 4 == 0, iso).alias("comments_close_on"), F.when(k % 4 == 1, iso).alias("effective_on"),
        F.when(k % 4 == 2, F.array(cat("DKT-", n, "x"), cat("DKT-", (k + 4).cast("string"), "x"), F.lit("DKT-0"))).otherwise(none).alias("docket_ids"),
        F.when(k % 4 == 3, F.array(cat("RIN-", n, "y"), F.lit("RIN-0"))).otherwise(none).alias("regulation_id_numbers"),
        cat("SUMMARY: ", F.col("c_name"), "\nplain words here\nDATES: ", F.date_format(day, "MMMM d, yyyy"), "\n  Docket DKT-", n, "x and RIN-", n, "y\n\npaid $5 at 9:30 in 1999\npaid $5 at 9:30 in 1999\nEffective ", F.expr("repeat(concat(c_mktsegment, ' '), cast(c_custkey % 12 as int))")).alias("text"),
    )


_LINES = rf"""l AS (SELECT document_number, pos, {TRIM.replace('{}', 'line')} AS line FROM (SELECT document_number, unnest(string_split(text, E'\n')) AS line, unnest(range(0, len(string_split(text, E'\n')))) AS pos FROM filings)),
  t AS (SELECT *, CASE WHEN regexp_matches(line, '{T.FACT_LINE}') THEN 0 WHEN regexp_matches(line, '{T.VALUE_LINE}') THEN 1 END AS tier FROM l WHERE line <> ''),
  u AS (SELECT *, row_number() OVER (PARTITION BY document_number, tier, line ORDER BY pos) AS n FROM t WHERE tier IS NOT NULL)"""


@query(f"WITH {FILINGS}, {_LINES} SELECT document_number AS doc_id, place::INT AS place, line FROM (SELECT *, row_number() OVER (PARTITION BY document_number ORDER BY tier, pos) AS place FROM u WHERE tier = 0 OR n = 1) WHERE place <= 6")
def filing_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.passages(filings(spark, sf_dir))


_DETAILS = """details AS (SELECT *, [{'name': CASE WHEN family % 3 = 0 THEN '' ELSE 'Office ' || family END, 'raw_name': 'OFFICE'}, {'name': NULL, 'raw_name': CASE WHEN family % 2 = 0 THEN '' ELSE 'Bureau' END}, {'name': 'Office ' || family, 'raw_name': 'again'}] AS agencies,
  [{'title': family + 1, 'part': CASE WHEN family % 4 = 0 THEN NULL ELSE 52 END}, {'title': NULL, 'part': 1}, {'title': family + 1, 'part': 52}] AS refs, CASE WHEN family % 13 = 5 THEN 'D-1' ELSE '' END AS correction_of, CASE WHEN family % 5 = 0 THEN '' ELSE 'act' END AS action FROM filings)"""


@query(f"""WITH {FILINGS}, {_DETAILS}, r AS (SELECT *, list_filter(list_transform(agencies, lambda a: coalesce(nullif(a.name, ''), nullif(a.raw_name, ''))), lambda n: n IS NOT NULL) AS n,
  list_transform(list_filter(refs, lambda x: x.title IS NOT NULL), lambda x: concat_ws(' ', x.title::VARCHAR, 'CFR', x.part::VARCHAR)) AS c FROM details)
  SELECT document_number, nullif(action, '') AS action, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') AS agencies, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), '|') AS cfr,
  length(text) AS char_count, len({WORDS.format('text')})::BIGINT AS word_count, coalesce(len(nullif(docket_ids, [])), 0)::BIGINT AS dockets, correction_of <> '' OR regexp_matches(document_number, '^C[0-9]+-') AS correction,
  NOT (correction_of <> '' OR regexp_matches(document_number, '^C[0-9]+-')) AND length(text) >= 200 AND len({WORDS.format('text')}) >= 24 AS kept FROM r""")
def filed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = filings(spark, sf_dir), F.col("family")
    text = lambda c: c.cast("string")
    office = F.concat(F.lit("Office "), text(k))
    null = F.lit(None).cast("string")
    agency = lambda n, r: F.struct(n.alias("name"), r.alias("raw_name"))
    ref = lambda t, p: F.struct(t.cast("long").alias("title"), p.cast("long").alias("part"))
    d = f.withColumns({
        "agencies": F.array(agency(F.when(k % 3 == 0, "").otherwise(office), F.lit("OFFICE")), agency(null, F.when(k % 2 == 0, "").otherwise("Bureau")), agency(office, F.lit("again"))),
        "cfr_references": F.array(ref(k + 1, F.when(k % 4 != 0, 52)), ref(F.lit(None), F.lit(1)), ref(k + 1, F.lit(52))),
        "correction_of": F.when(k % 13 == 5, "D-1").otherwise(""), "action": F.when(k % 5 == 0, "").otherwise("act"),
    })
    r = materialise(ingest.records(d), "records")
    kept = ingest.accepted(r, 200, 24).select(F.col("document_number").alias("_k"))
    return r.join(kept, F.col("document_number") == F.col("_k"), "left").select(
        "document_number", "action", F.array_join("agency_names", "|").alias("agencies"), F.array_join("cfr_references", "|").alias("cfr"), "char_count", "word_count",
        F.coalesce(F.size("docket_ids"), F.lit(0)).cast("long").alias("dockets"), ingest.is_correction().alias("correction"), F.col("_k").isNotNull().alias("kept"),
    )


def _worded(template: str, agency: str = "coalesce(agency, 'the agency')", subject: str = "subject") -> str:
    a, b = template.split("%1$s")
    m, z = b.split("%2$s")
    return f"'{a}' || {agency} || '{m}' || {subject} || '{z}'"


_SUBJECT = rf"""subjects AS (SELECT *, left(regexp_replace(CASE WHEN len(ps) >= 2 THEN ps[1] || ' for ' || array_to_string(ps[2:], ', ') ELSE {TRIM.replace('{}', 'title')} END, '\s*[;,]\s*$', ''), 140) AS subject
  FROM (SELECT *, list_filter(list_transform(string_split({TRIM.replace('{}', 'title')}, ';'), lambda p: {TRIM.replace('{}', 'p')}), lambda p: p <> '') AS ps FROM filings))"""
_WORDED = " ".join(f"WHEN '{k}' THEN {_worded(v)}" for k, v in questions.WORDING.items())
_CANDIDATES = f"""{_SUBJECT}, cands AS (SELECT document_number AS doc_id, i::INT AS place, c[i + 1].f AS field, c[i + 1].a AS answer, CASE c[i + 1].f {_WORDED} END AS question, agency, family FROM (SELECT *, unnest(range(0, len(c))) AS i FROM (SELECT *, list_filter(
  [{{'f': 'comments_close_on', 'a': strftime(comments_close_on::DATE, '%B %-d, %Y')}}, {{'f': 'effective_on', 'a': strftime(effective_on::DATE, '%B %-d, %Y')}}]
  || list_transform(docket_ids[1:2], lambda d: {{'f': 'docket_ids', 'a': d}}) || list_transform(rins[1:1], lambda d: {{'f': 'regulation_id_numbers', 'a': d}}), lambda x: x.a IS NOT NULL) AS c FROM subjects)))"""


@query(f"WITH {FILINGS}, {_CANDIDATES} SELECT doc_id, place, field, answer, question FROM cands")
def candidate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.candidates(filings(spark, sf_dir))


_CHECKED = f"""{_CANDIDATES}, found AS (SELECT n.answer, f.document_number AS d FROM (SELECT DISTINCT answer FROM cands) n JOIN filings f ON contains(lower(f.text), lower(n.answer))),
  checked AS (SELECT c.*, o.n AS occurrences, md5('0:' || doc_id) AS k FROM cands c JOIN (SELECT answer, count(*) AS n FROM found GROUP BY answer HAVING count(*) <= 10) o USING (answer) WHERE EXISTS (FROM found x WHERE x.answer = c.answer AND x.d = c.doc_id))"""


@query(f"WITH {FILINGS}, {_CHECKED} SELECT doc_id, field, answer, occurrences AS corpus_occurrences FROM checked")
def verified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir)
    return questions.verified(questions.candidates(f), f).select("doc_id", "field", "answer", "corpus_occurrences")


_MANY, _DISC, _NONE = 60, 15, 9
_UNANSWERED = " ".join(f"WHEN {i} THEN {_worded(w)}" for i, (w, _) in enumerate(questions.UNANSWERED))
_SET = f"""{_CHECKED},
  families AS (SELECT family, count(*) AS size FROM filings GROUP BY family),
  disc AS (SELECT question, answer, field, doc_id, occurrences, family, row_number() OVER (ORDER BY size DESC, family) AS o FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY k, doc_id, place) AS n FROM checked JOIN families USING (family)) WHERE n = 1 ORDER BY o LIMIT {_DISC}),
  near AS (SELECT doc_id, array_to_string(list(d ORDER BY n), ' ') AS s FROM (SELECT x.doc_id, f.document_number AS d, row_number() OVER (PARTITION BY x.doc_id ORDER BY md5('0:' || f.document_number), f.document_number) AS n FROM disc x JOIN filings f ON f.family = x.family AND f.document_number <> x.doc_id) WHERE n <= 8 GROUP BY doc_id),
  rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM checked WHERE doc_id NOT IN (SELECT doc_id FROM disc)) WHERE nth = 1),
  room AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY k, doc_id) <= {int((_MANY - _DISC - _NONE) * 0.4)} - (SELECT count(*) FROM disc d WHERE d.field = rest.field) AS first FROM rest),
  facts AS (SELECT *, row_number() OVER (ORDER BY first DESC, k, doc_id) AS o FROM room ORDER BY o LIMIT {_MANY - _DISC - _NONE}),
  open AS (SELECT CASE ('0x' || left(k, 4))::INT % {len(questions.UNANSWERED)} {_UNANSWERED} END AS question, document_number, row_number() OVER (ORDER BY k, document_number) AS o FROM (SELECT *, md5('0:' || document_number) AS k FROM subjects ORDER BY k, document_number LIMIT {_NONE})),
  every AS (SELECT 0 AS p, o, 'discriminator' AS type, question, answer, field, disc.doc_id AS gold, near.s AS distractors, occurrences FROM disc LEFT JOIN near USING (doc_id)
    UNION ALL SELECT 1, o, 'fact', question, answer, field, doc_id, '', occurrences FROM facts UNION ALL SELECT 2, o, 'unanswerable', question, NULL, NULL, NULL, document_number, NULL FROM open
    UNION ALL SELECT 2, 1000000000, 'unanswerable', '{questions.INVENTED}', NULL, NULL, NULL, '', NULL),
  made AS (SELECT printf('q%03d', row_number() OVER (ORDER BY p, o)) AS id, * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY p, o) AS n FROM every) WHERE n = 1)"""


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir)
    sizes = f.groupBy("family").agg(F.count("*").alias("size"))
    clustered = f.select(F.col("document_number").alias("doc_id"), F.col("family").alias("cluster_id")).join(sizes, F.col("cluster_id") == F.col("family")).select("doc_id", "cluster_id", "size")
    return questions.question_set(f, f, clustered, _MANY)


@query(f"WITH {FILINGS}, {_SET} SELECT id, type, question, answer, field AS answer_field, gold AS gold_doc, coalesce(distractors, '') AS distractors, occurrences AS corpus_occurrences FROM made")
def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discriminators by family, facts under a field cap, unanswerable questions; distinct, numbered."""
    return _made(spark, sf_dir).select("id", "type", "question", "answer", "answer_field", "gold_doc", F.array_join("distractors", " ").alias("distractors"), "corpus_occurrences")


@query(f"""WITH {FILINGS}, {_SET}, f AS (SELECT field, count(*) AS c FROM made WHERE field IS NOT NULL GROUP BY field), s AS (SELECT count(*) AS questions, count_if(type = 'fact')::BIGINT AS facts, count_if(type = 'discriminator')::BIGINT AS discriminators, count_if(type = 'unanswerable')::BIGINT AS unanswerable,
  count(gold) AS answerable, count(DISTINCT gold) AS documents, count_if(gold IS NOT NULL AND occurrences = 1)::BIGINT AS unique_answers, max(occurrences) AS most_occurrences, list_sort(list(occurrences) FILTER (gold IS NOT NULL)) AS l,
  count_if(field IN ('docket_ids', 'regulation_id_numbers'))::BIGINT AS by_identifier, round(avg(len(string_split(distractors, ' '))) FILTER (type = 'discriminator'), 6) AS look_alikes FROM made)
  SELECT questions, facts, discriminators, unanswerable, answerable, documents, unique_answers, most_occurrences, by_identifier, look_alikes, l[len(l) // 2 + 1] AS median_occurrences, (SELECT field FROM f ORDER BY c DESC, field LIMIT 1) AS top_field,
  by_identifier > 0.5 * answerable AS keyword_heavy, NOT by_identifier > 0.5 * answerable AND (SELECT max(c) FROM f) > 0.6 * answerable AS one_sided FROM s""")
def question_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.question_set_report(_made(spark, sf_dir))


# ---------------------------------------------------------------- import and authoring

_TITLE = r"left(string_split(text, E'\n')[1], 80)"
_W = WORDS.format("text")
RECORDS = f"""recs AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'none-' ELSE '' END || doc_id AS gold_doc, array_to_string({_W}[1:9], ' ') AS question,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'these words are absent' ELSE coalesce(nullif(array_to_string({_W}[3:6], ' - '), ''), 'no words left') END AS answer FROM documents WHERE text IS NOT NULL)"""


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, w = table(spark, sf_dir, "documents").where("text is not null"), T.words("text")
    cut = lambda a, n, s: F.array_join(F.slice(w, a, n), s)
    answer = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, "these words are absent").otherwise(F.coalesce(F.nullif(cut(3, 4, " - "), F.lit("")), F.lit("no words left")))
    return d.select(F.concat(F.when(F.col("doc_id") % 11 == 0, "none-").otherwise(""), F.col("doc_id").cast("string")).alias("gold_doc"), cut(1, 9, " ").alias("question"), answer.alias("answer"))


def _stop(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _reused(question: str, title: str, stop, least: int) -> str:
    return f"array_to_string(list_sort(list_intersect(list_distinct(list_filter(string_split({PLAIN.format(question)}, ' '), lambda w: w <> '')), list_filter(string_split({PLAIN.format(title)}, ' '), lambda w: length(w) > {least} AND NOT list_contains({_stop(stop)}, w)))), ' ')"


_IMPORTED = f"""{RECORDS}, hay AS MATERIALIZED (SELECT doc_id::VARCHAR AS d, {_TITLE} AS title, {PLAIN.format(cleaned('text'))} AS t FROM documents),
  needles AS (SELECT answer, {PLAIN.format('answer')} AS f FROM (SELECT DISTINCT answer FROM recs WHERE answer IS NOT NULL)), hits AS MATERIALIZED (SELECT n.answer, h.d FROM needles n JOIN hay h ON contains(h.t, n.f)),
  done AS (SELECT r.gold_doc AS gold, question, answer, CASE WHEN h.d IS NULL THEN 'document not in corpus' WHEN answer IS NULL THEN 'accepted' WHEN NOT EXISTS (FROM hits x WHERE x.answer = r.answer AND x.d = r.gold_doc) THEN 'answer text not found in that document' ELSE 'accepted' END AS status,
    CASE WHEN answer IS NOT NULL THEN (SELECT count(*) FROM hits x WHERE x.answer = r.answer) END AS n, CASE WHEN answer IS NOT NULL THEN {_reused('question', "coalesce(title, '')", T.IMPORT_TITLE_STOP, 3)} END AS reused FROM recs r LEFT JOIN hay h ON h.d = r.gold_doc)"""


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.imported(_recs(spark, sf_dir), docs(spark, sf_dir))


@query(f"WITH {_IMPORTED} SELECT CASE WHEN answer IS NULL THEN 'unanswerable' ELSE 'manual' END AS type, question, answer, CASE WHEN answer IS NULL AND status = 'accepted' THEN NULL ELSE gold END AS gold_doc, CASE WHEN answer IS NULL THEN gold ELSE '' END AS distractors, CASE WHEN n > 0 THEN n END AS corpus_occurrences, CASE WHEN status = 'document not in corpus' THEN NULL ELSE reused END AS reused, status FROM done")
def imported_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("status") != "document not in corpus"
    return _imported(spark, sf_dir).select("type", "question", "answer", "gold_doc", F.array_join("distractors", " ").alias("distractors"), "corpus_occurrences", F.when(known, F.array_join("title_words_reused", " ")).alias("reused"), "status")


@query(f"WITH {_IMPORTED}, ok AS (SELECT *, status = 'accepted' AS ok, answer IS NOT NULL AS asked FROM done) SELECT count(*) AS records, count_if(ok)::BIGINT AS accepted, count_if(NOT ok)::BIGINT AS rejected, count_if(ok AND asked)::BIGINT AS answerable, count_if(ok AND NOT asked)::BIGINT AS refusal_tests, count_if(ok AND asked AND reused <> '')::BIGINT AS leaky, count_if(ok AND asked AND n > 1)::BIGINT AS shared FROM ok")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.import_report(_imported(spark, sf_dir))


@query(f"WITH {_IMPORTED} SELECT gold AS gold_doc, count(*) AS n FROM done WHERE status = 'accepted' AND answer IS NOT NULL GROUP BY gold ORDER BY n DESC, gold LIMIT 5")
def import_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.questions_by_document(_imported(spark, sf_dir))


_AUTHORED = f"""{RECORDS}, own AS (SELECT doc_id::VARCHAR AS d, {_TITLE} AS title, {PLAIN.format(cleaned('text'))} AS t FROM documents),
  written AS (SELECT r.*, CASE WHEN {TRIM.replace('{}', "coalesce(question, '')")} = '' OR {TRIM.replace('{}', "coalesce(answer, '')")} = '' THEN 'skipped' WHEN NOT coalesce(contains(t, {PLAIN.format('answer')}), false) THEN 'not in the document' ELSE 'accepted' END AS status,
    {_reused('question', "coalesce(title, '')", T.AUTHOR_TITLE_STOP, 2)} AS reused FROM recs r LEFT JOIN own ON d = gold_doc)"""


@query(f"WITH {_AUTHORED} SELECT gold_doc, question, answer, status, reused FROM written")
def authored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.authored(_recs(spark, sf_dir), docs(spark, sf_dir)).select("gold_doc", "question", "answer", "status", F.array_join("title_words_reused", " ").alias("reused"))


@query(f"WITH {_AUTHORED} SELECT count(*) AS questions, count_if(reused = '')::BIGINT AS clean, count_if(reused <> '')::BIGINT AS leaky FROM written WHERE status = 'accepted'")
def authored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.authored_report(reports.authored(_recs(spark, sf_dir), docs(spark, sf_dir)).where("status = 'accepted'"))


# ---------------------------------------------------------------- answers

#: Letters whose compatibility decomposition the tables' texts need, from the standard's own tables.
_DECOMPOSED = [(chr(x), d) for x in range(0xA0, 0x180) for d in [unicodedata.normalize("NFKD", chr(x))] if d != chr(x)]


def scored_sql(c: str) -> str:
    """:func:`lexiquarry.functions.text.plain_scored` in SQL, for texts of Latin letters up to U+017F."""
    c = f"coalesce({c}, '')"
    for letter, parts in _DECOMPOSED:
        c = f"replace({c}, '{letter}', '{parts}')"
    return PLAIN.format(c)


_LABELS = _stop(T.LABEL_WORDS)


def holds_sql(found: str, expected: str) -> str:
    """:func:`lexiquarry.functions.text.holds_answer` in SQL."""
    terms = f"string_split({expected}, ' ')"
    at = f"list_filter(range(1, len({terms}) + 1), lambda i: regexp_matches({terms}[i], '[0-9]'))"
    first = f"list_min({at})"
    begin = f"CASE WHEN {first} > 1 AND length({terms}[{first} - 1]) <= 6 THEN {first} - 1 ELSE {first} END"
    core = f"CASE WHEN len({at}) > 0 THEN array_to_string({terms}[({begin}):list_max({at})], ' ') END"
    telling = f"list_filter({terms}, lambda t: NOT list_contains({_LABELS}, t))"
    return f"({expected} <> '' AND (contains({found}, {expected}) OR (len({telling}) > 0 AND list_has_all(string_split({found}, ' '), {telling}) AND coalesce(contains({found}, {core}), false))))"


_CASES = rf"""cases AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN array_to_string({_W}[3:6], ' ') WHEN 1 THEN array_to_string([{_W}[6], {_W}[3], {_W}[5]], ' ') WHEN 2 THEN 'Docket No. ' || coalesce(regexp_extract(text, '[A-Za-z]+ [0-9]+'), '') || ' ' || coalesce({_W}[2], '') WHEN 3 THEN 'case number' ELSE '' END AS expected, text FROM documents),
  formed AS MATERIALIZED (SELECT doc_id, {scored_sql('expected')} AS e, {scored_sql('text')} AS f FROM cases)"""


@query(f"WITH {_CASES} SELECT doc_id, {holds_sql('f', 'e')} AS holds FROM formed")
def holds_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in one piece, out of order, with labels and a number, of labels only, and empty."""
    d, w, k = table(spark, sf_dir, "documents"), T.words("text"), F.col("doc_id") % 5
    at = lambda i: F.try_element_at(w, F.lit(i))
    numbered = F.concat(F.lit("Docket No. "), F.coalesce(F.regexp_extract("text", "[A-Za-z]+ [0-9]+", 0), F.lit("")), F.lit(" "), F.coalesce(at(2), F.lit("")))
    e = F.when(k == 0, F.array_join(F.slice(w, 3, 4), " ")).when(k == 1, F.concat_ws(" ", at(6), at(3), at(5))).when(k == 2, numbered).when(k == 3, "case number").otherwise("")
    rows = d.select("doc_id", T.plain_scored(e).alias("e"), T.plain_scored("text").alias("f"))
    return rows.select("doc_id", T.holds_answer("f", "e").alias("holds"))


_ANSWERED = f"""{catalogue._RESULTS.removeprefix('WITH ')},
  qa AS (SELECT item_id::VARCHAR AS id, 'kind ' || item_id % 3 AS type, b.text AS question, CASE WHEN item_id % 5 = 1 THEN '0' WHEN item_id % 5 > 0 THEN q.gold_doc END AS gold_doc, CASE WHEN item_id % 5 = 2 THEN 'words of no passage' WHEN item_id % 5 > 0 THEN array_to_string(string_split(b.text, ' ')[1:3], ' ') END AS expected, item_id % 8 AS corpus_occurrences,
    CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 4 = 0 THEN 'Not found in the available documents.' WHEN item_id % 4 = 1 THEN 'It is ' || b.text ELSE 'I do not know.' END AS generated, CASE WHEN item_id % 9 = 0 THEN 'no answer' END AS generation_error FROM benchmark b LEFT JOIN qs q ON q.id = b.item_id::VARCHAR),
  texts AS MATERIALIZED (SELECT h.query_id::VARCHAR AS id, h.doc_id::VARCHAR AS d, {scored_sql('c.text')} AS t FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.position = h.position),
  wants AS MATERIALIZED (SELECT id, gold_doc, {scored_sql('expected')} AS e, {scored_sql('generated')} AS s FROM qa),
  held AS (SELECT w.id, bool_or({holds_sql('t', 'e')}) AS in_any, coalesce(bool_or({holds_sql('t', 'e')}) FILTER (d = gold_doc), false) AS in_gold FROM wants w JOIN texts USING (id) GROUP BY w.id),
  scored AS (SELECT qa.id, type, question, qa.gold_doc, expected, corpus_occurrences, generated, generation_error, CASE WHEN expected <> '' THEN coalesce(in_any, false) END AS answer_in_context, CASE WHEN expected <> '' AND qa.gold_doc <> '' THEN coalesce(in_gold, false) END AS answer_in_gold_context,
    CASE WHEN qa.gold_doc <> '' THEN p.place IS NOT NULL END AS hit, p.place AS rank, CASE WHEN qa.gold_doc <> '' AND p.place IS NULL THEN f.doc_id::VARCHAR END AS confused_with,
    CASE WHEN generated IS NOT NULL THEN {catalogue._REFUSES.replace(PLAIN.format('generated'), 's')} END AS refused,
    CASE WHEN generated IS NULL THEN NULL WHEN expected IS NULL OR expected = '' THEN {catalogue._REFUSES.replace(PLAIN.format('generated'), 's')} ELSE {holds_sql('s', 'e')} END AS answer_correct
    FROM qa LEFT JOIN places p ON p.query_id::VARCHAR = qa.id AND p.doc_id::VARCHAR = qa.gold_doc LEFT JOIN (SELECT * FROM places WHERE place = 1) f ON f.query_id::VARCHAR = qa.id LEFT JOIN held USING (id) JOIN wants USING (id))"""


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as questions, some with a wrong document or an answer that no passage holds, and made-up answers."""
    idx, b, k = tables.indexed(spark, sf_dir), table(spark, sf_dir, "benchmark"), F.col("item_id")
    hits = search.bm25(idx, tables.asked(spark, sf_dir)).withColumn("query_id", F.col("query_id").cast("string"))
    gold = catalogue._gold(spark, sf_dir).select("id", "gold_doc")
    asked = k % 5 > 0
    q = b.withColumn("id", k.cast("string")).join(gold, "id", "left").select(
        "id", F.concat(F.lit("kind "), (k % 3).cast("string")).alias("type"), F.col("text").alias("question"), F.when(k % 5 == 1, "0").when(asked, F.col("gold_doc")).alias("gold_doc"),
        F.when(k % 5 == 2, "words of no passage").when(asked, F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("answer"), (k % 8).alias("corpus_occurrences"),
    )
    said = F.when(k % 9 == 0, F.lit(None)).when(k % 4 == 0, T.REFUSAL).when(k % 4 == 1, F.concat(F.lit("It is "), F.col("text"))).otherwise("I do not know.")
    answers = b.select(k.cast("string").alias("query_id"), said.alias("generated"), F.when(k % 9 == 0, "no answer").alias("generation_error"))
    return evaluation.scored(q, hits, idx.chunks, answers)


_ROW = ("id", "gold_doc", "answer_in_context", "answer_in_gold_context", "hit", "rank", "confused_with", "refused", "answer_correct", "generation_error")


@query(f"WITH {_ANSWERED} SELECT {', '.join(_ROW)} FROM scored".replace(", rank,", ", rank::INT AS rank,"))
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select(*_ROW)


_METRICS = "count(*) AS questions, count_if(hit)::BIGINT AS hits, round(count_if(hit) / count(*)::DOUBLE, 6) AS hit_rate, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, count_if(rank = 1)::BIGINT AS first, count_if(answer_in_context)::BIGINT AS in_context, count_if(answer_in_gold_context)::BIGINT AS in_gold_context, round((count_if(hit) - count_if(answer_in_gold_context)) / nullif(count(answer_in_gold_context), 0)::DOUBLE, 6) AS gap"


@query(f"WITH {_ANSWERED} SELECT type, {_METRICS} FROM scored WHERE coalesce(gold_doc, '') <> '' GROUP BY type")
def passage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type of question: hits, and how often the passages held the answer."""
    return evaluation.retrieval_metrics(_answered(spark, sf_dir), "type")


@query(f"""WITH {_ANSWERED}, x AS (SELECT *, coalesce(gold_doc, '') <> '' AS asked, answer_correct IS NOT NULL AND coalesce(nullif(corpus_occurrences, 0), 1) <= 5 AS counts FROM scored)
  SELECT count_if(asked AND counts)::BIGINT AS counted, count_if(asked AND counts AND answer_correct)::BIGINT AS correct, round(count_if(asked AND counts AND answer_correct) / nullif(count_if(asked AND counts), 0)::DOUBLE, 6) AS accuracy, count_if(asked AND answer_correct IS NOT NULL AND NOT counts)::BIGINT AS excluded,
  count_if(coalesce(generation_error, '') <> '')::BIGINT AS errors, count_if(NOT asked AND generated IS NOT NULL)::BIGINT AS unanswerable, count_if(NOT asked AND coalesce(refused, false))::BIGINT AS refused, round(count_if(NOT asked AND coalesce(refused, false)) / nullif(count_if(NOT asked AND generated IS NOT NULL), 0)::DOUBLE, 6) AS refusal_rate, count_if(asked AND coalesce(refused, false))::BIGINT AS wrong_refusals FROM x""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.answer_metrics(_answered(spark, sf_dir))


@query(f"WITH {_ANSWERED} SELECT id, 'starved' AS list, rank::INT AS rank, NULL::VARCHAR AS confused_with FROM scored WHERE coalesce(gold_doc, '') <> '' AND hit AND NOT answer_in_gold_context UNION ALL SELECT id, 'missed', NULL, confused_with FROM scored WHERE coalesce(gold_doc, '') <> '' AND NOT hit")
def starved_and_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = materialise(_answered(spark, sf_dir), "answered")
    cut = lambda rows, name: rows.select("id", F.lit(name).alias("list"), "rank", "confused_with")
    return cut(reports.starved(r), "starved").unionByName(cut(reports.misses(r), "missed"))


_KEYED = "substr(sha256(id || '|' || question || '|' || coalesce(generated, 'None')), 1, 16)"


@query(f"WITH {_ANSWERED} SELECT {_KEYED} AS answer_key, CASE id::BIGINT % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'refusal' ELSE 'bad-question' END AS verdict, id, md5(question) AS question, expected, generated FROM scored WHERE id::BIGINT % 6 < 4")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' keys to verdict rows, through the verdict file and back."""
    r = _answered(spark, sf_dir)
    keys = F.element_at(F.array(*map(F.lit, ("C", " w", "r", "b", "x", ""))), (F.col("id").cast("long") % 6 + 1).cast("int"))
    path = f"{scratch(spark)}/verdicts-{uuid.uuid4().hex}"
    files.write_verdicts(reports.judged(r, r.select("id", keys.alias("choice"))), path)
    return files.read_verdicts(spark, path).select("answer_key", "verdict", "id", F.md5("question").alias("question"), "expected", "generated")


@query(f"WITH {_ANSWERED} SELECT id FROM scored WHERE id::BIGINT % 6 <> 3")
def kept_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no reviewer called bad."""
    r = materialise(_answered(spark, sf_dir), "answered")
    keys = F.element_at(F.array(*map(F.lit, ("c", "w", "r", "b", "x", ""))), (F.col("id").cast("long") % 6 + 1).cast("int"))
    return evaluation.drop_bad(r, reports.judged(r, r.select("id", keys.alias("choice")))).select("id")


@query(f"WITH {_ANSWERED} SELECT id, {_KEYED} AS answer_key FROM scored WHERE id::BIGINT % 6 > 3")
def all_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer without a verdict, not only those that count as wrong."""
    r = materialise(_answered(spark, sf_dir), "answered")
    keys = F.element_at(F.array(*map(F.lit, ("c", "w", "r", "b", "x", ""))), (F.col("id").cast("long") % 6 + 1).cast("int"))
    return evaluation.pending(r, reports.judged(r, r.select("id", keys.alias("choice"))), everything=True).select("id", "answer_key")


@query(catalogue._RESULTS + f", w AS (SELECT id, gold_doc, {scored_sql('array_to_string(string_split(question, chr(32))[1:3], chr(32))')} AS e FROM qs), x AS MATERIALIZED (SELECT h.query_id::VARCHAR AS id, h.doc_id::VARCHAR AS d, {scored_sql('c.text')} AS t FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.position = h.position), held AS (SELECT w.id, bool_or({holds_sql('t', 'e')}) AS a, coalesce(bool_or({holds_sql('t', 'e')}) FILTER (d = gold_doc), false) AS g FROM w JOIN x USING (id) GROUP BY w.id), got AS (SELECT query_id::VARCHAR AS id, array_to_string(list(doc_id ORDER BY place), ' ') AS retrieved, arg_min(doc_id::VARCHAR, place) AS first FROM places GROUP BY query_id) SELECT r.id, gold_doc, coalesce(retrieved, '') AS retrieved, coalesce(a, false) AS answer_in_context, coalesce(g, false) AS answer_in_gold_context, rank IS NOT NULL AS hit, rank::INT AS rank, CASE WHEN rank IS NULL THEN first END AS confused_with FROM results r LEFT JOIN held USING (id) LEFT JOIN got USING (id)")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue._results(spark, sf_dir).select("id", "gold_doc", F.array_join("retrieved", " ").alias("retrieved"), "answer_in_context", "answer_in_gold_context", "hit", "rank", "confused_with")


_WANT = scored_sql(catalogue._want("question"))
_SAID = scored_sql("generated")


@query(f"WITH {tables.TURNS}, x AS MATERIALIZED (SELECT id, {_WANT} AS w, {_SAID} AS s FROM turns) SELECT id, w <> '' AND contains(s, w) AS whole, {catalogue._REFUSES.replace(PLAIN.format('generated'), 's')} AS refused FROM x")
def answer_matching_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer repeats its question's first three words, and whether it refuses: every pair, decomposed."""
    return catalogue._matched(tables.turns(spark, sf_dir), False)


# ---------------------------------------------------------------- questions, duplicates, leaks

_ASKED = "asked AS (SELECT 'q' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Where is the ' || p_name || '?' ELSE upper(p_name) || ' - where, is the' END AS question, CASE WHEN p_partkey % 9 > 0 THEN p_brand || p_size END AS gold_doc, p_type AS type FROM part)"
_GROUPS = f"{_ASKED}, groups AS (SELECT {catalogue._KEY.replace('text', 'question')} AS key, count(*) AS size, array_to_string(list(id ORDER BY id), ' ') AS ids FROM asked WHERE gold_doc <> '' GROUP BY key HAVING count(*) > 1)"


def _part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    asked = F.when(k % 2 == 0, F.concat(F.lit("Where is the "), name, F.lit("?"))).otherwise(F.concat(F.upper(name), F.lit(" - where, is the")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("q"), k.cast("string")).alias("id"), asked.alias("question"), F.when(k % 9 > 0, F.concat("p_brand", F.col("p_size").cast("string"))).alias("gold_doc"), F.col("p_type").alias("type"))


@query(f"WITH {_GROUPS} SELECT key, size, ids FROM groups")
def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.duplicate_questions(_part_questions(spark, sf_dir)).withColumn("ids", F.array_join("ids", " "))


@query(f"WITH {_GROUPS} SELECT (SELECT count(*) FROM asked WHERE gold_doc <> '') AS questions, count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS affected, round(coalesce(sum(size), 0) / (SELECT count(*) FROM asked WHERE gold_doc <> '')::DOUBLE, 6) AS share FROM groups")
def repeated_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _part_questions(spark, sf_dir)
    return reports.duplicate_groups(questions.duplicate_questions(q), q)


@query(f"WITH {_GROUPS} SELECT key, size FROM groups ORDER BY size DESC, key LIMIT 5")
def repeated_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest_groups(questions.duplicate_questions(_part_questions(spark, sf_dir))).select("key", "size")


@query(f"WITH {_GROUPS} SELECT id FROM asked WHERE id NOT IN (SELECT unnest(string_split(ids, ' ')) FROM groups)")
def distinct_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.drop_duplicates(_part_questions(spark, sf_dir)).select("id")


@query(f"WITH {_ASKED} SELECT id FROM asked ORDER BY id LIMIT 25")
def limited_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_questions(_part_questions(spark, sf_dir), 25).select("id")


@query(f"SELECT doc_id, len({catalogue._CONTENT.replace('question', 'q')}) < 3 AS degenerate FROM (SELECT doc_id, array_to_string({_W}[1:3], ' ') AS q FROM documents)")
def degenerate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array_join(F.slice(T.words("text"), 1, 3), " ")
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", T.is_degenerate("q").alias("degenerate"))


@query(catalogue._LEAK + " SELECT term, count(*) AS n FROM (SELECT unnest(string_split(fingerprint_terms, ' ')) AS term FROM leak WHERE fingerprint_terms <> '') GROUP BY term ORDER BY n DESC, term LIMIT 8")
def leakage_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.common_fingerprints(questions.leakage(catalogue._gold(spark, sf_dir), docs(spark, sf_dir)))


_ONE = r"regexp_replace(s, '(?i)(^|[^\pL\pN\pM_])\Q' || t || '\E($|[^\pL\pN\pM_])', '\1\2', 'g')"
_TIDY = TRIM.replace("{}", r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '\s*,\s*,', ',', 'g'), '\s{2,}', ' ', 'g'), '\s+([,.?])', '\1', 'g'), '(?i)(for|on|in)\s*\?', '?', 'g')")


@query(catalogue._LEAK + rf""", cut AS (SELECT id, question, fingerprint_terms <> '' AS hit, string_split(fingerprint_terms, ' ') AS ts, fingerprint_terms FROM leak),
  done AS (SELECT id, hit, fingerprint_terms, CASE WHEN hit THEN list_reduce(list_sort(list_transform(ts, lambda t: {{'n': -length(t), 't': t}})), lambda s, x: {{'n': 0, 't': {_ONE.replace('s,', _ONE.replace('s,', 's.t,') + ',', 1).replace("|| t ||", "|| x.t ||")}}}, {{'n': 0, 't': question}}).t END AS q, question FROM cut),
  tidy AS (SELECT id, CASE WHEN hit THEN {_TIDY} ELSE question END AS question, CASE WHEN hit THEN fingerprint_terms END AS removed_terms, hit FROM done)
  SELECT id, question, removed_terms FROM tidy WHERE NOT hit OR len({catalogue._CONTENT}) >= 3""")
def ablated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalogue._gold(spark, sf_dir)
    return questions.ablated(q, questions.leakage(q, docs(spark, sf_dir))).select("id", "question", F.array_join("removed_terms", " ").alias("removed_terms"))


# ---------------------------------------------------------------- similarity, slices, previews, windows, files

_NEAR = f"WITH {catalogue._PAIRS}, near AS (SELECT d.doc_id, coalesce(max(score), 0.0)::DOUBLE AS nearest FROM documents d LEFT JOIN (SELECT a AS doc_id, score FROM pairs UNION ALL SELECT b, score FROM pairs) p USING (doc_id) GROUP BY d.doc_id)"


@query(_NEAR + " SELECT CASE WHEN nearest < 0.4 THEN '0.00-0.40' WHEN nearest < 0.6 THEN '0.40-0.60' WHEN nearest < 0.75 THEN '0.60-0.75' WHEN nearest < 0.85 THEN '0.75-0.85' WHEN nearest < 0.95 THEN '0.85-0.95' ELSE '0.95-1.00' END AS bucket, count(*) AS n FROM near GROUP BY bucket")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similarity_histogram(duplicates.nearest(catalogue._sketched(spark, sf_dir)))


_FALL = "s[least(floor({} * len(s))::BIGINT, len(s) - 1) + 1]"


@query(_NEAR + f", o AS (SELECT list_reverse_sort(list(nearest)) AS s FROM near) SELECT s[1] AS most, {_FALL.format(0.1)} AS p90, {_FALL.format(0.25)} AS p75, {_FALL.format(0.5)} AS median, {_FALL.format(0.75)} AS p25, s[-1] AS least FROM o")
def similarity_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.similarity_quantiles(duplicates.nearest(catalogue._sketched(spark, sf_dir)))


@query(f"WITH picked AS ({ORACLES['dev_slice']}), d AS (SELECT source, len({_W})::BIGINT AS w FROM documents JOIN picked USING (doc_id)) SELECT count(*) AS documents, coalesce(sum(w), 0)::BIGINT AS words, count(DISTINCT source) AS agencies FROM d")
def slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    picked = catalogue.dev_slice(spark, sf_dir).select("doc_id")
    return reports.slice_summary(d.join(picked, F.col("document_number") == F.col("doc_id"), "left_semi").withColumn("agency_names", F.filter("agency_names", lambda a: a.isNotNull())))


@query(f"SELECT doc_id, left({TRIM.replace('{}', "regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")}, 88) AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reports.preview("text").alias("preview"))


@query(catalogue.DAYS.format("max(d) - 30"))
def recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the thirty days up to the last order: the window of a run that names no dates, which moves with the table."""
    return ingest.covered_days(table(spark, sf_dir, "orders"), "o_orderdate", 30).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


_HELD = {"document_number": "document_number", "title": "title", "comments_close_on": "comments_close_on", "effective_on": "effective_on", "docket_ids": "docket_ids", "regulation_id_numbers": "rins"}


@query(f"WITH {FILINGS} SELECT field, CASE field " + " ".join(f"WHEN '{k}' THEN count({v})" for k, v in _HELD.items()) + " ELSE 0 END AS n FROM filings, (SELECT unnest([" + ", ".join(f"'{f}'" for f in schemas.KEPT) + "]) AS field) GROUP BY field")
def probed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the kept fields the filings have, as JSON records, which leave out what is null."""
    return reports.probed(filings(spark, sf_dir).select(F.to_json(F.struct("*")).alias("detail")), schemas.KEPT)


@query(f"WITH {FILINGS} SELECT document_number, title, comments_close_on, nullif(array_to_string(docket_ids, '|'), '') AS dockets, md5(text) AS digest FROM filings")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings as JSON lines, written in two appends and read back."""
    f, path = filings(spark, sf_dir), f"{scratch(spark)}/corpus-{uuid.uuid4().hex}"
    files.write_jsonl(f.where("family % 2 = 0"), path)
    files.write_jsonl(f.where("family % 2 = 1"), path, append=True)
    return files.read_jsonl(spark, path).select("document_number", "title", "comments_close_on", F.nullif(F.array_join("docket_ids", "|"), F.lit("")).alias("dockets"), F.md5("text").alias("digest"))


@query(f"WITH {FILINGS} SELECT document_number FROM filings WHERE family % 2 = 1")
def resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to write after a run that stopped in the middle of a line."""
    f, path = filings(spark, sf_dir), f"{scratch(spark)}/partial-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("document_number", "title"))
    f.where("family % 2 = 0").select(line.alias("value")).union(f.select(F.left(line, F.lit(9)))).write.text(path)
    return ingest.new_only(f.select("document_number"), files.present_ids(spark, path))


@query(f"WITH {RECORDS} SELECT gold_doc, question, answer FROM recs")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records as three-line text, read back."""
    r, path = _recs(spark, sf_dir), f"{scratch(spark)}/records-{uuid.uuid4().hex}"
    r.select(F.concat(F.lit("DOC: "), "gold_doc", F.lit("\nQ:  "), "question", F.lit("\nA: "), F.coalesce("answer", F.lit("none")), F.lit("\n"))).write.text(path)
    return files.read_records(spark, path).select("gold_doc", "question", "answer")


@query("SELECT doc_id, len({0}) AS terms FROM documents".format(TOKENS.format("text")))
def cached_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector cache: made once, and read again for the same content (the numbers stand for vectors)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text")
    path = f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    make = lambda c: c.select("doc_id", F.size(T.tokens("text")).cast("long").alias("terms"))
    files.cached_vectors(d, path, "sizes", make)
    return files.cached_vectors(d, path, "sizes", lambda c: make(c).where("false"))


@query(f"WITH {tables.chunks_sql()}, {tables.ASKED}, {tables.scores_sql()} SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM ({catalogue._BEST}) WHERE c = 1 AND doc_id <= 50)) WHERE rank <= 10")
def explain_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking explained over named documents only."""
    return search.explain(tables.indexed(spark, sf_dir), tables.asked(spark, sf_dir), docs=list(range(51))).select("query_id", "rank", "doc_id", "score")
