"""The driver's tables in the shapes that the operators read, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import text as T
from lexiquarry.operators import postings
from lexiquarry.operators import vectors as blocked
from lexiquarry.operators.chunking import chunk
from lexiquarry.session import scratch, state

#: These texts have no blank lines: a line is a paragraph.
LINE = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the first line is the title, the source the agency, the language the type."""
    d = table(spark, sf_dir, "documents")
    title = F.left(F.element_at(F.split("text", "\n"), 1), F.lit(80))
    return d.select(F.col("doc_id").alias("document_number"), title.alias("title"), F.array("source").alias("agency_names"), F.col("source").alias("agency"), F.col("lang").alias("type"), "text", F.size(T.words("text")).cast("long").alias("word_count"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(docs(spark, sf_dir), separator=LINE)


def indexed(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The keyword index of the chunks, kept beside the scratch tables for as long as the files of documents stay as they are."""
    now = state(table(spark, sf_dir, "documents"))
    return postings.keep(spark, f"{scratch(spark)}/kept/keywords-{postings.FORMAT}-{now}", lambda: chunks(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark: an item's first eight terms are a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.tokens("text"), 1, 8), " ").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("vec_id").alias("position"), "embedding")


def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as blocks, kept for as long as the files of embeddings stay as they are."""
    now = state(table(spark, sf_dir, "embeddings"))
    return blocked.keep(spark, f"{scratch(spark)}/kept/vectors-{now}", lambda: vectors(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations: a user's turn is a question, the assistant's next one the answer; what is expected is the answer's first three words."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.where("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("generated"))
    return user.join(said, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "question", "generated")


# ---------------------------------------------------------------- SQL

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-/][a-z0-9]+)*')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def cleaned(c: str) -> str:
    """:func:`lexiquarry.functions.text.without_masthead` in SQL, from the same patterns (a flag and a group are spelled differently there)."""
    for p in T.MASTHEAD:
        c = f"regexp_replace({c}, '{p.replace('(?md)', '(?m)').replace('(?U:', '(?:')}', '', 'g')"
    return TRIM.replace("{}", f"regexp_replace({c}, '\\n{{3,}}', E'\\n\\n', 'g')")


def chunks_sql(size: int = 1200, overlap: int = 150) -> str:
    """A common table ``chunks (doc_id, position, text)``."""
    stride = size - overlap
    h = f"(CASE WHEN length(q.b) > {size} THEN ceil((length(q.b) - {size}) / {stride}.0)::BIGINT ELSE 0 END)"
    rest = f"substr(q.b, {h} * {stride} + 1)"
    held = "(CASE WHEN s.b <> '' THEN [s.b] ELSE []::VARCHAR[] END)"
    done = f"(CASE WHEN length(q.b) > {size} THEN s.o || {held} || list_transform(range(0, {h}), lambda i: substr(q.b, i * {stride} + 1, {size})) ELSE s.o END)"
    buffer = f"(CASE WHEN length(q.b) > {size} THEN '' ELSE s.b END)"
    full = f"({buffer} <> '' AND length({buffer}) + length({rest}) + 2 > {size})"
    step = f"{{'o': CASE WHEN {full} THEN {done} || [{buffer}] ELSE {done} END, 'b': CASE WHEN {full} THEN right({buffer}, {overlap}) || E'\\n' || {rest} WHEN {buffer} <> '' THEN {buffer} || E'\\n\\n' || {rest} ELSE {rest} END}}"
    trim = TRIM.replace("{}", "p")
    return rf"""
  paragraphs AS (SELECT doc_id, list_filter(list_transform(string_split({cleaned("text")}, E'\n'), lambda p: {trim}), lambda p: p <> '') AS ps FROM documents),
  packed AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {{'o': []::VARCHAR[], 'b': p}}), lambda s, q: {step}, {{'o': []::VARCHAR[], 'b': ''}}) AS r FROM paragraphs WHERE len(ps) > 0),
  lists AS (SELECT doc_id, r.o || list_filter([{TRIM.replace("{}", "r.b")}], lambda x: x <> '') AS c FROM packed),
  chunks AS (SELECT doc_id, unnest(range(0, len(c)))::INT AS position, unnest(c) AS text FROM lists)"""


DOCS = rf"docs AS (SELECT doc_id, left(string_split(text, E'\n')[1], 80) AS title, source AS agency, lang AS type, text, len({WORDS.format('text')})::BIGINT AS word_count FROM documents)"
ASKED = f"asked AS (SELECT item_id AS query_id, array_to_string({TOKENS.format('text')}[1:8], ' ') AS query FROM benchmark)"
TURNS = "turns AS (SELECT u.conv_id || '-' || u.turn AS id, u.text AS question, a.text AS generated FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def scores_sql() -> str:
    """Common tables from ``chunks`` and ``asked`` to ``parts (query_id, term, doc_id, position, len, part)``."""
    return f"""
  tok AS (SELECT doc_id, position, {TOKENS.format('text')} AS t FROM chunks),
  numbers AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok),
  postings AS (SELECT term, doc_id, position, any_value(l) AS l, count(*) AS tf FROM (SELECT doc_id, position, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
  terms AS (SELECT DISTINCT query_id, unnest({TOKENS.format('query')}) AS term FROM asked),
  parts AS (SELECT query_id, p.term, doc_id, position, l AS len, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * (l / a))) AS part
    FROM terms q JOIN postings p ON p.term = q.term JOIN dfs d ON d.term = p.term, numbers)"""


def capped_sql(scores: str, k: int, per_doc: int) -> str:
    cap = f"WHERE c <= {per_doc}" if per_doc else ""
    return f"""SELECT query_id, rank::INT AS rank, doc_id, position, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, position) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, position) AS c FROM ({scores})) {cap}) WHERE rank <= {k}"""
