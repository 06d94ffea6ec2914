"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry import models
from lexiquarry.functions import text as T
from lexiquarry.operators import duplicates, evaluation, ingest, questions, search
from lexiquarry.plans import tables
from lexiquarry.plans.tables import ASKED, DOCS, PLAIN, TOKENS, TRIM, TURNS, WORDS, capped_sql, chunks_sql, cleaned, docs, scores_sql, table

FLAGSHIP = "search_bm25"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text and chunks


@query(f"WITH {chunks_sql()} SELECT doc_id, position, length(text) AS chars, md5(text) AS digest FROM chunks")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).select("doc_id", "position", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format(cleaned('text'))})) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = questions.term_documents(docs(spark, sf_dir).drop("title"))
    return terms.select("term", F.col("df").cast("long")).distinct()


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


_ENTITIES = "replace(replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' ')"
_PAGE = TRIM.replace("{}", rf"regexp_replace(regexp_replace({_ENTITIES.replace('{}', "regexp_replace(CASE WHEN regexp_matches(html, '(?is)<pre>(.*?)</pre>') THEN regexp_extract(html, '(?is)<pre>(.*?)</pre>', 1) ELSE html END, '<[^>]+>', '', 'g')")}, '[ \t]+\n', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g')")


@query(f"SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, {_PAGE} AS t FROM pages)")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.page_text("html").alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate::DATE, '%B %-d, %Y') AS spelled FROM orders")
def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.spelled_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("spelled"))


DAYS = """WITH o AS (SELECT o_orderdate::DATE AS d FROM orders), e AS (SELECT {} AS a, max(d) AS b FROM o), w AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d FROM e)
  SELECT strftime(w.d, '%Y-%m-%d') AS day, count(o.d) AS n FROM w LEFT JOIN o ON o.d = w.d WHERE isodow(w.d) < 6 GROUP BY w.d"""


@query(DAYS.format("min(d)"))
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The business days from the first order to the last, with the orders of each."""
    return ingest.covered_days(table(spark, sf_dir, "orders"), "o_orderdate").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


# ---------------------------------------------------------------- retrieval


_BM25 = "SELECT query_id, doc_id, position, round(sum(part), 6) AS score FROM parts GROUP BY ALL"


@query(f"WITH {chunks_sql()}, {ASKED}, {scores_sql()} {capped_sql(_BM25, 5, 2)}")
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.bm25(tables.indexed(spark, sf_dir), tables.asked(spark, sf_dir))
    return hits.select("query_id", "rank", "doc_id", "position", "score")


_BEST = "SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, position) AS c FROM (SELECT query_id, doc_id, position, any_value(len) AS len, round(sum(part), 6) AS score, array_to_string(list_transform(list_sort(list({'m': -round(part, 6), 't': term}))[1:4], lambda x: x.t), ' ') AS top_terms FROM parts GROUP BY query_id, doc_id, position)"


@query(f"WITH {chunks_sql()}, {ASKED}, {scores_sql()} SELECT query_id, rank::INT AS rank, doc_id, score, top_terms, is_short FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, len < 0.6 * (SELECT a FROM numbers) AS is_short FROM ({_BEST}) WHERE c = 1) WHERE rank <= 10")
def search_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.explain(tables.indexed(spark, sf_dir), tables.asked(spark, sf_dir))
    return out.select("query_id", "rank", "doc_id", "score", "top_terms", "is_short")


_DENSE = "SELECT q.vec_id AS query_id, v.label AS doc_id, v.vec_id AS position, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query(capped_sql(_DENSE, 5, 2))
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dense(tables.vector_blocks(spark, sf_dir), _probes(spark, sf_dir)).select("query_id", "rank", "doc_id", "position", "score")


@query(capped_sql(_DENSE, 50, 1))
def search_dense_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vector of each document, to the depth that a fusion or a second stage reads."""
    return search.dense(tables.vector_blocks(spark, sf_dir), _probes(spark, sf_dir), search.DEPTH, 1).select("query_id", "rank", "doc_id", "position", "score")


_FUSED = f"SELECT query_id, doc_id, position, round(sum(1 / (60.0 + rank)::DOUBLE), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"


@query(f"WITH a AS ({capped_sql(_DENSE, 50, 0)}), b AS ({capped_sql(_DENSE, 50, 1)}) {capped_sql(_FUSED, 5, 2)}")
def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion of two rankings of one set of chunks: all vectors, and the best of each document."""
    v, q = tables.vector_blocks(spark, sf_dir), _probes(spark, sf_dir)
    return search.fuse(search.dense(v, q, 50, 0), search.dense(v, q, 50, 1)).select("query_id", "rank", "doc_id", "position", "score")


@query(f"WITH a AS ({capped_sql(_DENSE, 50, 0)}), b AS ({capped_sql(_DENSE, 50, 1)}) {capped_sql(_FUSED, 20, 0)}")
def search_fused_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion without a cap on a document's hits."""
    v, q = tables.vector_blocks(spark, sf_dir), _probes(spark, sf_dir)
    return search.fuse(search.dense(v, q, 50, 0), search.dense(v, q, 50, 1), 20, 0).select("query_id", "rank", "doc_id", "position", "score")


_RERANKED = f"SELECT h.query_id, h.doc_id, h.position, round(len(list_intersect(list_distinct({TOKENS.format('query')}), {TOKENS.format('c.text')})) / len(list_distinct({TOKENS.format('query')}))::DOUBLE, 6) AS score FROM h JOIN asked USING (query_id) JOIN chunks c ON c.doc_id = h.doc_id AND c.position = h.position"


@query(f"WITH {chunks_sql()}, {ASKED}, {scores_sql()}, h AS ({capped_sql(_BM25, 50, 0)}) {capped_sql(_RERANKED, 5, 2)}")
def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = tables.indexed(spark, sf_dir)
    return search.retriever("bm25", idx, reranked=True)(tables.asked(spark, sf_dir)).select("query_id", "rank", "doc_id", "position", "score")


@query()
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and stand-in embeddings over the same chunks (the stand-in has no SQL)."""
    idx = tables.indexed(spark, sf_dir)
    q = models.embed(tables.asked(spark, sf_dir), "query")
    hits = search.hybrid(idx, models.embed(idx.chunks), q)
    return search.compare(bm25=search.bm25(idx, q), hybrid=hits).select("retriever", "query_id", "rank", "doc_id", "position", "score")




@query(f"WITH {chunks_sql()}, {ASKED}, {scores_sql()}, h AS ({capped_sql(_BM25, 5, 2)}) SELECT query_id, md5('Passages:' || E'\\n\\n' || string_agg('[' || rank || '] (' || h.doc_id || ' - ' || d.title || ')' || E'\\n' || c.text, E'\\n\\n' ORDER BY rank) || E'\\n\\nQuestion: ' || any_value(query) || E'\\nAnswer:') AS prompt FROM h JOIN asked USING (query_id) JOIN chunks c ON c.doc_id = h.doc_id AND c.position = h.position JOIN (SELECT doc_id, left(string_split(text, E'\\n')[1], 80) AS title FROM documents) d ON d.doc_id = h.doc_id GROUP BY query_id")
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx, q = tables.indexed(spark, sf_dir), tables.asked(spark, sf_dir)
    return search.prompts(search.bm25(idx, q), idx.chunks, q).select("query_id", F.md5("prompt").alias("prompt"))


# ---------------------------------------------------------------- corpus inspection


@query(f"WITH {DOCS} SELECT count(*) AS documents, sum(word_count)::BIGINT AS words, (sum(word_count) // count(*))::BIGINT AS mean_words, (SELECT doc_id FROM docs ORDER BY word_count DESC, doc_id LIMIT 1) AS longest FROM docs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.corpus_stats(docs(spark, sf_dir), date_col=None)


@query("SELECT lang AS type, count(*) AS n FROM documents GROUP BY lang")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.type_counts(docs(spark, sf_dir))


@query("SELECT source AS agency, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.top_agencies(docs(spark, sf_dir))


_AT = "s[least(floor({} * len(s))::BIGINT, len(s) - 1) + 1]"


@query(f"WITH {DOCS}, o AS (SELECT list_sort(list(word_count)) AS s FROM docs) SELECT len(s)::BIGINT AS documents, list_sum(s)::BIGINT AS words, s[1] AS least, {_AT.format(0.25)} AS p25, (({_AT.format(0.5)} + s[len(s) - least(floor(0.5 * len(s))::BIGINT, len(s) - 1)]) // 2)::BIGINT AS median, {_AT.format(0.75)} AS p75, {_AT.format(0.95)} AS p95, s[-1] AS most, (list_sum(s) // len(s))::BIGINT AS mean FROM o")
def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.length_distribution(docs(spark, sf_dir))


@query(f"WITH {DOCS} SELECT doc_id, word_count AS words FROM docs WHERE word_count > 0.005 * (SELECT sum(word_count) FROM docs)")
def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.outliers(docs(spark, sf_dir), share=0.005)


@query("SELECT 'doc_id' AS field, count(doc_id)::DOUBLE / count(*) AS share FROM documents UNION ALL SELECT 'lang', count(nullif(lang, ''))::DOUBLE / count(*) FROM documents UNION ALL SELECT 'source', count(nullif(source, ''))::DOUBLE / count(*) FROM documents")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coverage(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


_COLLAPSED = TRIM.replace("{}", r"regexp_replace(lower(text), '\s+', ' ', 'g')")


@query(f"SELECT sha256({_COLLAPSED}) AS key, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY key HAVING count(*) > 1")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_groups(docs(spark, sf_dir))


_H = "concat('0x', substr(md5({}), 1, 8))::BIGINT"
_SKETCHES = f"""
  w AS (SELECT doc_id, string_split({_COLLAPSED}, ' ') AS w FROM documents),
  h AS (SELECT DISTINCT doc_id, {_H.format("array_to_string(w[i:i + 4], ' ')")} AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
  k AS (SELECT doc_id, h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS n FROM h) WHERE n <= 256),
  s AS (SELECT doc_id, list_sort(list(h)) AS s FROM k GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, list(a.h) AS c FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
  pairs AS (SELECT a, b, len(list_intersect(u, c)) / len(u)::DOUBLE AS score FROM (SELECT p.a, p.b, p.c, list_sort(list_distinct(x.s || y.s))[1:256] AS u FROM shared p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b))"""
_PAIRS = _SKETCHES.replace("GROUP BY ALL)", "GROUP BY a.doc_id, b.doc_id)")
_CLUSTERS = f"""WITH RECURSIVE {_PAIRS},
  e AS (SELECT a, b FROM pairs WHERE score >= {{}} UNION SELECT b, a FROM pairs WHERE score >= {{}}),
  r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
  named AS (SELECT node AS doc_id, min(seen) AS cluster_id FROM r GROUP BY node),
  clusters AS (SELECT doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM named)"""


def _sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.sketches(docs(spark, sf_dir), hashing=T.md5_hash, most=None)


@query(_CLUSTERS.format(0.6, 0.6) + " SELECT * FROM clusters")
def near_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.clusters(_sketched(spark, sf_dir), duplicates.CLI)


@query(f"WITH {_PAIRS} SELECT d.doc_id, coalesce(max(score), 0.0)::DOUBLE AS nearest FROM documents d LEFT JOIN (SELECT a AS doc_id, score FROM pairs UNION ALL SELECT b, score FROM pairs) p USING (doc_id) GROUP BY d.doc_id")
def nearest_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.nearest(_sketched(spark, sf_dir))


@query()
def near_clusters_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters over CRC-32 sketches of whole texts, which SQL lacks."""
    return duplicates.clusters(duplicates.sketches(docs(spark, sf_dir), most=None), duplicates.EXACT)


@query(_CLUSTERS.format(0.6, 0.6) + " SELECT cluster_id, size, agency FROM (SELECT cluster_id, size, source AS agency, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, source) AS n FROM clusters JOIN documents USING (doc_id) GROUP BY cluster_id, size, source) WHERE n = 1")
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return duplicates.cluster_report(duplicates.clusters(_sketched(spark, sf_dir), duplicates.CLI), d)


@query(_CLUSTERS.format(0.6, 0.6) + f""", {DOCS}, ok AS (SELECT * FROM docs WHERE word_count <= 3000),
  inside AS (SELECT c.*, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_id) AS n FROM clusters c JOIN ok USING (doc_id)),
  many AS (SELECT cluster_id, row_number() OVER (ORDER BY size DESC, cluster_id) AS place FROM inside GROUP BY cluster_id, size HAVING count(*) >= 2 ORDER BY size DESC, cluster_id LIMIT 4),
  seeds AS (SELECT doc_id, 0 AS part, place AS x, n AS y, 0 AS z FROM inside JOIN many USING (cluster_id) WHERE n <= 4),
  rest AS (SELECT doc_id, agency, row_number() OVER (PARTITION BY agency ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY agency) AS c, min(doc_id) OVER (PARTITION BY agency) AS f FROM ok WHERE doc_id NOT IN (SELECT doc_id FROM seeds)),
  turn AS (SELECT doc_id, 1 AS part, n AS x, -c AS y, f AS z FROM rest ORDER BY n, c DESC, f LIMIT (SELECT greatest(0, 40 - count(*)) FROM seeds))
  SELECT doc_id, part, row_number() OVER (ORDER BY part, x, y, z)::INT AS place FROM (SELECT * FROM seeds UNION ALL SELECT * FROM turn)""")
def dev_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return duplicates.dev_slice(d, duplicates.clusters(_sketched(spark, sf_dir), duplicates.CLI), 40, 3000)


# ---------------------------------------------------------------- questions


_NEEDLES = "needles AS (SELECT item_id, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) AS needle FROM benchmark)"


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower(F.array_join(F.slice(F.split("text", " "), 1, 6), " ")).alias("needle"))


@query(f"WITH {_NEEDLES} SELECT n.needle, d.doc_id FROM documents d JOIN (SELECT DISTINCT needle FROM needles) n ON contains(lower(d.text), n.needle)")
def answer_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.occurrences(docs(spark, sf_dir), _needles(spark, sf_dir))


@query(f"WITH {_NEEDLES}, f AS (SELECT item_id, needle, d.doc_id, count(*) OVER (PARTITION BY item_id) AS corpus_occurrences FROM documents d JOIN needles n ON contains(lower(d.text), n.needle)) SELECT item_id AS place, doc_id, needle AS answer, corpus_occurrences FROM f WHERE corpus_occurrences <= 10")
def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = _needles(spark, sf_dir), docs(spark, sf_dir)
    cands = questions.occurrences(d, n).join(n, "needle").select(F.col("item_id").alias("place"), "doc_id", F.col("needle").alias("answer"))
    return questions.verified(cands, d)


_STOP = "[" + ", ".join(f"'{w}'" for w in T.QUESTION_STOP) + "]"
_CONTENT = f"list_distinct(list_filter({TOKENS.format('question')}, lambda t: NOT list_contains({_STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$')))"
_ASKED_GOLD = "qs AS (SELECT item_id::VARCHAR AS id, 'fact' AS type, b.text AS question, g.gold_doc::VARCHAR AS gold_doc FROM benchmark b JOIN (SELECT b.item_id AS i, min(d.doc_id) AS gold_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id) g ON g.i = b.item_id)"
_LEAK = f"""WITH {_ASKED_GOLD},
  td AS (SELECT doc_id, unnest(list_distinct({TOKENS.format("concat_ws(' ', left(string_split(text, E'\\n')[1], 80), " + cleaned('text') + ")")})) AS term FROM documents),
  dfs AS (SELECT term, count(*) AS df FROM td GROUP BY term HAVING count(*) <= 5),
  hits AS (SELECT id, list_sort(list({{'df': df, 'term': q.term}})) AS r FROM (SELECT id, gold_doc, unnest({_CONTENT}) AS term FROM qs) q JOIN dfs ON dfs.term = q.term JOIN td ON td.term = q.term AND td.doc_id::VARCHAR = q.gold_doc GROUP BY id),
  leak AS (SELECT qs.id, type, gold_doc, question, r[1].df AS rarest_df, coalesce(array_to_string(list_transform(list_filter(r, lambda x: x.df = 1), lambda x: x.term), ' '), '') AS fingerprint_terms, coalesce(array_to_string(list_transform(r, lambda x: x.term), ' '), '') AS rare_terms FROM qs LEFT JOIN hits USING (id))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), docs(spark, sf_dir)
    found = questions.occurrences(d, b.select(F.col("text").alias("needle")), form=lambda c: F.coalesce(c if not isinstance(c, str) else F.col(c), F.lit("")))
    gold = found.groupBy("needle").agg(F.min("doc_id").cast("string").alias("gold_doc"))
    return b.join(gold, F.col("text") == F.col("needle")).select(F.col("item_id").cast("string").alias("id"), F.lit("fact").alias("type"), F.col("text").alias("question"), "gold_doc")


@query(_LEAK + " SELECT id, type, gold_doc, rarest_df, fingerprint_terms, rare_terms FROM leak")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions.leakage(_gold(spark, sf_dir), docs(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, " ") for c in ("fingerprint_terms", "rare_terms")})


@query(_LEAK + " SELECT type, count(*) AS questions, count_if(fingerprint_terms <> '')::BIGINT AS fingerprinted, count_if(fingerprint_terms = '' AND rare_terms <> '')::BIGINT AS rare_only, count_if(rare_terms = '')::BIGINT AS clean FROM leak GROUP BY type")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.leakage_report(questions.leakage(_gold(spark, sf_dir), docs(spark, sf_dir)))


_KEY = "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ')"


@query(f"SELECT key, count(*) AS size, string_agg(id, ' ' ORDER BY id) AS ids FROM (SELECT {_KEY} AS key, conv_id || '-' || turn AS id FROM conversations WHERE role = 'user') GROUP BY key HAVING count(*) > 1")
def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lit("x").alias("gold_doc"))
    return questions.duplicate_questions(q).withColumn("ids", F.array_join("ids", " "))


@query("SELECT printf('q%03d', row_number() OVER (ORDER BY p, i)) AS id, question FROM (SELECT 0 AS p, printf('%05d', item_id) AS i, text AS question FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 1, printf('%05d', item_id), text FROM benchmark WHERE item_id % 2 = 1)")
def merged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.format_string("%05d", "item_id").alias("id"), F.col("text").alias("question"))
    return questions.merged(b.where("item_id % 2 = 0").drop("item_id"), b.where("item_id % 2 = 1").drop("item_id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ingest.new_only(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")




@query(rf"""WITH l AS (SELECT doc_id, pos, {TRIM.replace('{}', 'line')} AS line FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, unnest(range(0, len(string_split(text, E'\n')))) AS pos FROM documents)),
  t AS (SELECT *, CASE WHEN regexp_matches(line, '{T.FACT_LINE}') THEN 0 WHEN regexp_matches(line, '{T.VALUE_LINE}') THEN 1 END AS tier FROM l WHERE line <> ''),
  u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tier, line ORDER BY pos) AS n FROM t WHERE tier IS NOT NULL)
  SELECT doc_id, place::INT AS place, md5(line) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, pos) AS place FROM u WHERE tier = 0 OR n = 1) WHERE place <= 6""")
def fact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.passages(docs(spark, sf_dir)).select("doc_id", "place", F.md5("line").alias("digest"))


@query()
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole builder over documents that state a docket: the first four words of each text stand for one."""
    d = docs(spark, sf_dir).withColumns({"docket_ids": F.array(F.array_join(F.slice(T.words("text"), 1, 4), " ")), "regulation_id_numbers": F.array().cast("array<string>"), "comments_close_on": F.lit(None).cast("string"), "effective_on": F.lit(None).cast("string")})
    made = questions.question_set(d, d, duplicates.clusters(_sketched(spark, sf_dir), duplicates.MAKER), 40)
    return made.select("id", "type", "question", "answer", "gold_doc", F.array_join("distractors", " ").alias("distractors"))


# ---------------------------------------------------------------- evaluation


def _want(c: str) -> str:
    return f"array_to_string({WORDS.format(c)}[1:3], ' ')"


_ASCII = "regexp_matches(question || generated, '^[[:ascii:]]*$')"


@query(f"WITH {TURNS} SELECT id, substr(sha256(id || '|' || question || '|' || generated), 1, 16) AS answer_key FROM turns")
def answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_keys(tables.turns(spark, sf_dir)).select("id", "answer_key")


_REFUSES = f"(contains({PLAIN.format('generated')}, 'not found in the available documents') OR starts_with({PLAIN.format('generated')}, 'i cannot find') OR starts_with({PLAIN.format('generated')}, 'i could not find'))"


@query(f"WITH {TURNS} SELECT id, {PLAIN.format(_want('question'))} <> '' AND contains({PLAIN.format('generated')}, {PLAIN.format(_want('question'))}) AS whole, {_REFUSES} AS refused FROM turns WHERE {_ASCII}")
def answer_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer repeats its question's first three words, and whether it refuses."""
    return _matched(tables.turns(spark, sf_dir).where(F.concat("question", "generated").rlike(r"^[\x00-\x7F]*$")), True)


def _matched(t: DataFrame, ascii_only: bool) -> DataFrame:
    said, want = T.plain_scored("generated", ascii_only), T.plain_scored(F.array_join(F.slice(T.words("question"), 1, 3), " "), ascii_only)
    return t.select("id", ((want != "") & F.contains(said, want)).alias("whole"), T.is_refusal(said).alias("refused"))


_RESULTS = f"""WITH {chunks_sql()}, {ASKED}, {scores_sql()}, hits AS ({capped_sql(_BM25, 5, 2)}), {_ASKED_GOLD},
  places AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM hits GROUP BY query_id, doc_id),
  results AS (SELECT id, gold_doc, place AS rank FROM qs LEFT JOIN places ON query_id::VARCHAR = id AND doc_id::VARCHAR = gold_doc)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = tables.indexed(spark, sf_dir)
    hits = search.bm25(idx, tables.asked(spark, sf_dir)).withColumn("query_id", F.col("query_id").cast("string"))
    q = _gold(spark, sf_dir).withColumns({"answer": F.array_join(F.slice(F.split("question", " "), 1, 3), " "), "corpus_occurrences": F.lit(1).cast("long")})
    return evaluation.scored(q, hits, idx.chunks)


@query(_RESULTS + " SELECT count(*) AS questions, count(rank) AS hits, round(count(rank) / count(*)::DOUBLE, 6) AS hit_rate, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6) AS mrr, count_if(rank = 1)::BIGINT AS first FROM results")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.retrieval_metrics(_results(spark, sf_dir)).select("questions", "hits", "hit_rate", "mrr", "first")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """labels as results (the quality is the automatic score) and as verdicts (toxic: a bad question, every third otherwise correct)."""
    lab = table(spark, sf_dir, "labels")
    r = lab.select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("g").alias("gold_doc"), F.lit("said").alias("generated"), (F.col("quality") == 1).alias("answer_correct"), F.lit(None).cast("string").alias("generation_error"))
    v = lab.where("toxic = 1 or doc_id % 3 = 0").select(T.answer_key(F.col("doc_id"), F.lit("q"), F.lit("said")).alias("answer_key"), F.when(F.col("toxic") == 1, "bad-question").when(F.col("doc_id") % 2 == 0, "correct").otherwise("refusal").alias("verdict"))
    return r, v


_VERDICTS = "v AS (SELECT doc_id, quality = 1 AS auto, CASE WHEN toxic = 1 THEN 'bad-question' WHEN doc_id % 3 <> 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'correct' ELSE 'refusal' END AS verdict FROM labels), e AS (SELECT *, CASE verdict WHEN 'correct' THEN true WHEN 'refusal' THEN false WHEN 'bad-question' THEN NULL ELSE auto END AS eff FROM v)"


@query(f"WITH {_VERDICTS} SELECT doc_id::VARCHAR AS id, verdict, coalesce(eff::VARCHAR, 'none') AS effective_correct FROM e")
def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overlaid(*_labelled(spark, sf_dir)).select("id", "verdict", F.coalesce(F.col("effective_correct").cast("string"), F.lit("none")).alias("effective_correct"))


@query(f"WITH {_VERDICTS} SELECT count(*) AS answers, count_if(auto)::BIGINT AS automated, count_if(coalesce(eff, false))::BIGINT AS reviewed, count_if(verdict = 'bad-question')::BIGINT AS bad_questions, count_if(verdict = 'refusal')::BIGINT AS refusals, count_if(NOT auto AND verdict IS NULL)::BIGINT AS unjudged FROM e")
def verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.verdict_report(*_labelled(spark, sf_dir)).select("answers", "automated", "reviewed", "bad_questions", "refusals", "unjudged")


@query(f"WITH {_VERDICTS} SELECT doc_id::VARCHAR AS id FROM e WHERE NOT auto AND verdict IS NULL")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pending(*_labelled(spark, sf_dir)).select("id")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS turn FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
