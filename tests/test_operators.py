import collections
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry import graph
from lexiquarry.operators import chunking, duplicates, evaluation, ingest, postings, prefix, questions, reports, search, vectors


def test_chunks_keep_sizes_and_overlap(spark):
    text = "\n\n".join(["a" * 50, "b" * 60, "c" * 250, "d"])
    got = spark.createDataFrame([(text,), ("",), (None,), ("  \n ",)], "t string").select(chunking.chunks_of(F.coalesce("t", F.lit("")), 100, 20).alias("c")).collect()
    assert [r.c for r in got[1:]] == [[], [], []]
    c = got[0].c
    assert c[0] == "a" * 50 and c[1] == "a" * 20 + "\n" + "b" * 60 and c[2] == "c" * 100 and c[-1].endswith("d")
    with pytest.raises(ValueError):
        chunking.chunks_of(F.lit("x"), 10, 10)


def test_packing_is_linear():
    took = []
    for n in (1, 8):
        lines = ["line of some words " * 3] * (60_000 * n) + ["x" * 200_000 * n]
        began = time.process_time()
        done, left = chunking.packed(lines, 1200, 150)
        took.append(time.process_time() - began)
        assert sum(map(len, done)) > 0.9 * sum(map(len, lines)) and max(map(len, done)) <= 1200 and 0 < len(left) <= 1200
    assert took[1] < 20 * max(took[0], 0.01)


def index_of(spark, rows):
    chunks = spark.createDataFrame([(f"{d}#{p}", d, "t", "?", x, p) for d, p, x in rows], "chunk_id string, doc_id string, title string, agency string, text string, position int")
    return search.index(chunks), chunks


def test_search_caps_and_orders(spark):
    idx, chunks = index_of(spark, [("a", 0, "zone lake"), ("a", 1, "zone zone"), ("a", 2, "zone"), ("b", 0, "zone river water long text"), ("c", 0, "other")])
    q = spark.createDataFrame([("1", "zone"), ("2", "absent")], "query_id string, query string")
    hits = search.bm25(idx, q, k=5, per_doc=2).orderBy("rank").collect()
    assert {h.query_id for h in hits} == {"1"} and [h.doc_id for h in hits].count("a") == 2 and len(hits) == 3
    assert len(search.bm25(idx, q, k=5, per_doc=0).collect()) == 4
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
    with pytest.raises(ValueError):
        search.bm25(idx, q, k=0)
    prompt = search.prompts(search.bm25(idx, q, 1), chunks, q).first().prompt
    assert prompt.startswith("Passages:\n\n[1] (a - t)") and prompt.endswith("Question: zone\nAnswer:")


def test_search_on_nothing(spark):
    idx, _ = index_of(spark, [])
    q = spark.createDataFrame([("1", "zone")], "query_id string, query string")
    assert search.bm25(idx, q).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}


def test_clusters_and_nearest(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " x"), (4, " ".join(f"v{i}" for i in range(60)))], "document_number long, text string")
    s = duplicates.sketches(docs)
    assert {(r.doc_id, r.cluster_id, r.size) for r in duplicates.clusters(s, 0.8).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}
    near = {r.doc_id: r.nearest for r in duplicates.nearest(s).collect()}
    assert near[1] == near[2] == 1.0 and 0.9 < near[3] < 1 and near[4] == 0


def test_records_and_corrections(spark):
    d = spark.createDataFrame([("C1-2026-1", "", [("", "Raw"), ("A", None), ("A", "x")], [(40, 52), (40, 52), (None, 1), (3, None)], "w " * 200)], "document_number string, title string, agencies array<struct<name:string,raw_name:string>>, cfr_references array<struct<title:bigint,part:bigint>>, text string")
    r = ingest.records(d).first()
    assert r.title is None and r.agency_names == ["Raw", "A"] and r.cfr_references == ["40 CFR 52", "3 CFR"] and r.word_count == 200
    assert ingest.records(d).withColumn("correction_of", F.lit(None).cast("string")).where(ingest.is_correction()).count() == 1


def test_business_days(spark):
    assert ingest.business_days(spark, "2026-08-01", "2026-08-02").count() == 0
    with pytest.raises(ValueError):
        ingest.business_days(spark, "2026-08-02", "2026-08-01")


DOC = "document_number string, title string, agency_names array<string>, text string, comments_close_on string, effective_on string, docket_ids array<string>, regulation_id_numbers array<string>"


def some_docs(spark):
    rows = [(f"d{i}", f"Safety Zone; Lake {i}, NY", ["Guard"], f"Comments by September {i}, 2026. Docket D-{i}. " + "filler words " * 40, f"2026-09-0{i}", None, [f"D-{i}"], None) for i in range(1, 8)]
    return spark.createDataFrame(rows, DOC)


def test_candidates_are_verified_and_worded(spark):
    docs = some_docs(spark)
    got = questions.verified(questions.candidates(docs), docs).where("doc_id = 'd3'").orderBy("place").collect()
    assert [(r.field, r.answer, r.corpus_occurrences) for r in got] == [("comments_close_on", "September 3, 2026", 1), ("docket_ids", "D-3", 1)]
    assert got[1].question == "Under which docket did Guard file Safety Zone for Lake 3, NY?"


def test_question_set(spark):
    docs = some_docs(spark)
    clusters = spark.createDataFrame([(f"d{i}", "d1", 3) for i in (1, 2, 3)], "doc_id string, cluster_id string, size long")
    rows = questions.question_set(docs, docs, clusters, n=8).collect()
    kinds = [r.type for r in sorted(rows, key=lambda r: r.id)]
    assert kinds == sorted(kinds, key=["discriminator", "fact", "unanswerable"].index) and kinds[0] == "discriminator"
    assert len({r.question for r in rows}) == len(rows) and sorted(r.id for r in rows)[0] == "q001"
    disc = next(r for r in rows if r.type == "discriminator")
    assert disc.gold_doc not in disc.distractors and len(disc.distractors) == 2
    assert disc.gold_doc not in {r.gold_doc for r in rows if r.type == "fact"}


def test_imported_records(spark):
    docs = some_docs(spark)
    recs = spark.createDataFrame([("d1", "Which lake zone?", "Docket D–1"), ("d9", "q", "a"), ("d2", "q", "absent words"), ("d3", "q", None)], "gold_doc string, question string, answer string")
    got = {r.question + str(r._order): r for r in questions.imported(recs, docs).collect()}
    by = sorted(got.values(), key=lambda r: r._order)
    assert [r.status for r in by] == ["accepted", "document not in corpus", "answer text not found in that document", "accepted"]
    assert by[0].title_words_reused == ["lake", "zone"] and by[3].distractors == ["d3"] and by[3].gold_doc is None


def test_leakage_and_duplicates(spark):
    docs = spark.createDataFrame([("a", "T", "olcott pier lake"), ("b", "U", "lake pier"), ("c", "V", "lake")], "document_number string, title string, text string")
    q = spark.createDataFrame([("1", "fact", "Where is Olcott pier on the lake shore side?", "a"), ("2", "fact", "the Pier, OLCOTT: where is on lake shore side", "a"), ("3", "unanswerable", "x", None)], "id string, type string, question string, gold_doc string")
    r = {x.id: x for x in questions.leakage(q, docs, 2).collect()}
    assert r["1"].rarest_df == 1 and r["1"].fingerprint_terms == ["olcott"] and r["1"].rare_terms == ["olcott", "pier"] and r["3"].rarest_df is None
    assert [x.ids for x in questions.duplicate_questions(q).collect()] == [["1", "2"]] and questions.drop_duplicates(q).count() == 1
    done = {x.id: x for x in questions.ablated(q, questions.leakage(q, docs, 2)).collect()}
    assert "Olcott" not in done["1"].question and done["1"].removed_terms == ["olcott"] and "3" in done


def test_scores_and_verdicts(spark):
    idx, chunks = index_of(spark, [("a", 0, "docket 12 zone"), ("b", 0, "zone river")])
    q = spark.createDataFrame([("1", "fact", "zone river", "docket 12", "a", 1), ("2", "fact", "zzz", "x", "b", 1), ("3", "unanswerable", "zone", None, None, None)], "id string, type string, question string, answer string, gold_doc string, corpus_occurrences long")
    hits = search.bm25(idx, q.select(F.col("id").alias("query_id"), F.col("question").alias("query")))
    said = spark.createDataFrame([("1", "It is docket 12", None), ("2", "no idea", None), ("3", "Not found in the available documents.", None)], "query_id string, generated string, generation_error string")
    res = evaluation.scored(q, hits, chunks, said)
    r = {x.id: x for x in res.collect()}
    assert r["1"].rank == 2 and r["1"].hit and r["1"].answer_in_gold_context and r["1"].answer_correct
    assert r["2"].hit is False and r["2"].confused_with is None and r["3"].hit is None and r["3"].refused and r["3"].answer_correct
    m = evaluation.retrieval_metrics(res).first()
    assert (m.questions, m.hits, m.mrr) == (2, 1, 0.25)
    a = evaluation.answer_metrics(res).first()
    assert (a.counted, a.correct, a.refused) == (2, 1, 1)
    key = evaluation.pending(res, spark.createDataFrame([], "answer_key string")).collect()
    assert [x.id for x in key] == ["2"]
    v = spark.createDataFrame([(key[0].answer_key, "correct", "2")], "answer_key string, verdict string, id string")
    rep = evaluation.verdict_report(res, v).first()
    assert (rep.automated, rep.reviewed) == (1, 2)


def plain_bm25(rows, queries, k, per_doc):
    """(query, rank, doc, position, score) by scoring every chunk."""
    toks = {(d, p): re.findall(r"[a-z0-9]+(?:[-/][a-z0-9]+)*", x.lower()) for d, p, x in rows}
    n, avg = len(rows), sum(map(len, toks.values())) / len(rows)
    df = collections.Counter(t for x in toks.values() for t in set(x))
    out = set()
    for q, text in queries:
        scores = []
        for (d, p), x in toks.items():
            tf = collections.Counter(x)
            s = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in set(text.split()) if tf[t]]
            if s:
                scores.append((-round(sum(s), 6), d, p))
        kept, seen = [], collections.Counter()
        for s, d, p in sorted(scores):
            seen[d] += 1
            if not per_doc or seen[d] <= per_doc:
                kept.append((s, d, p))
        out |= {(q, i, d, p, -s) for i, (s, d, p) in enumerate(kept[:k], 1)}
    return out


def test_kept_index_opens_asked_buckets_and_passes_over_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 4)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(vocab[min(399, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(1, 40)))
    rows = [(f"d{rng.randrange(150)}", p, text()) for p in range(600)]
    chunks = spark.createDataFrame([(f"{d}#{p}", d, "t", "?", x, p) for d, p, x in rows], "chunk_id string, doc_id string, title string, agency string, text string, position int").repartition(3)
    path = f"file://{tmp_path}/kept"
    idx = postings.write(chunks, path)
    asked = [(i, " ".join(rng.sample(vocab[:120], 2) + [vocab[200 + i]])) for i in range(20)] + [(98, "nothing here"), (99, "")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    for k, per_doc in ((3, 2), (7, 0), (1, 1)):
        got = {(r.query_id, r["rank"], r.doc_id, r.position, r.score) for r in search.bm25(idx, queries, k, per_doc).collect()}
        assert got == plain_bm25(rows, asked, k, per_doc)
    read = search.ranges_read(idx, queries, 3, 2).agg(F.sum("read"), F.sum("ranges")).first()
    assert read[0] < 0.7 * read[1]
    # an index that is there is opened again, without its chunks, and a query's files are those of its terms' buckets
    again = postings.keep(spark, path, lambda: 1 / 0)
    one = again.ask(queries.where("query_id = 3"))
    folders = {re.search(r"bucket=(\d+)", f)[1] for f in one.postings.inputFiles() + one.tops.inputFiles()}
    want = {str(r.b) for r in spark.createDataFrame([(w,) for w in asked[3][1].split()], "term string").select(postings._bucket("term", again.buckets).alias("b")).collect()}
    assert folders == want and len(again.filled) == 16
    assert not spark.read.parquet(f"{path}/chunks").drop("range").exceptAll(chunks).count() and postings.write(chunks.limit(1), path).count == 600
    named = search.explain(idx, queries, docs=["d1", "d2", "d3"]).collect()
    assert named and {r.doc_id for r in named} <= {"d1", "d2", "d3"}
    with pytest.raises(FileNotFoundError):
        postings.open_index(spark, f"{path}-none")


def test_texts_of_retrieved_chunks_only_are_fetched(spark):
    chunks = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"), F.lit("t").alias("title"), F.lit("some text").alias("text"))
    hits = spark.createDataFrame([(1, "c5"), (2, "c5"), (2, "c7")], "query_id int, chunk_id string")
    got = search.fetched(chunks, hits, "text")
    assert sorted(r.chunk_id for r in got.collect()) == ["c5", "c7"] and got.columns == ["chunk_id", "text"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan


def plain_dense(rows, queries, k, per_doc):
    out = set()
    for q, v in queries:
        kept, seen = [], collections.Counter()
        for s, d, p, c in sorted((-round(float(np.dot(v, w)), 5), d, p, c) for c, d, p, w in rows):
            seen[d] += 1
            if not per_doc or seen[d] <= per_doc:
                kept.append((q, len(kept) + 1, c, d, p, -s))
        out |= set(kept[:k])
    return out


@pytest.mark.parametrize("shard", [vectors.SHARD, 64])
def test_vector_blocks(spark, tmp_path, shard, monkeypatch):
    monkeypatch.setattr(vectors, "SIZE", 16)
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "PART", 8)
    monkeypatch.setattr(vectors, "ENTRIES", 500)
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(12, 8))
    near = lambda i: (lambda v: (v / np.linalg.norm(v)).tolist())(mids[i % 12] + 0.1 * rng.normal(size=8))
    rows = [(f"c{i}", f"d{i % 90}", i, near(i)) for i in range(500)] + [(f"s{i}", f"d{i % 5}", 1000 + i, near(0)) for i in range(3)]
    rows += [(f"t{i}", "same", 2000 + i, rows[7][3]) for i in range(60)]  # one vector many times
    queries = [(i, near(i)) for i in range(20)] + [(77, [0.0] * 8)]
    kind = "chunk_id string, doc_id string, position int, embedding array<double>"
    bad = [("n", "d", 1, None), ("m", "d", 2, [None] * 8), ("i", "d", 3, [float("inf")] * 8)]
    kept = vectors.write(spark.createDataFrame(rows + bad, kind), f"file://{tmp_path}/{shard}")
    asked = spark.createDataFrame([*queries, (78, None)], "query_id long, embedding array<double>")
    for k, per_doc in ((5, 2), (3, 0), (1000, 1)):
        got = {(r.query_id, r["rank"], r.chunk_id, r.doc_id, r.position, r.score) for r in search.dense(kept, asked, k, per_doc).collect()}
        assert got == plain_dense(rows, queries, k, per_doc)
    read = vectors.blocks_read(kept, asked.where("query_id < 20"), 3, 0).agg(F.sum("read"), F.sum("blocks")).first()
    assert read[0] < 0.4 * read[1]
    plan = search.dense(kept, asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert vectors.keep(spark, f"file://{tmp_path}/{shard}", lambda: 1 / 0).count() == kept.count()
    assert search.dense(spark.createDataFrame([], kind), asked).count() == 0 and search.dense(kept, asked.limit(0)).count() == 0


def test_vector_shards_meet_wherever_they_lie(spark, tmp_path, monkeypatch):
    """Partitions of a cogroup stay apart: both sides must be dealt by equal keys of one type."""
    monkeypatch.setattr(vectors, "SIZE", 16)
    monkeypatch.setattr(vectors, "SHARD", 64)
    monkeypatch.setattr(vectors, "PART", 8)
    rng = np.random.default_rng(5)
    rows = [(i, i % 10, i, rng.normal(size=8).tolist()) for i in range(300)]
    asked = spark.createDataFrame([(i, v) for i, _, _, v in rows[::20]], "query_id long, embedding array<double>")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        kept = vectors.write(spark.createDataFrame(rows, "chunk_id long, doc_id int, position long, embedding array<double>"), f"file://{tmp_path}/blocks")
        got = {(r.query_id, r["rank"], r.chunk_id, r.doc_id, r.position, r.score) for r in search.dense(kept, asked).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == plain_dense(rows, [(i, v) for i, _, _, v in rows[::20]], 5, 2)


def test_running_sums_of_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, rng.randrange(50)]), rng.randrange(1000), rng.randrange(5)) for _ in range(700)]
    data = spark.createDataFrame(rows, "a int, b int, w int").repartition(5)
    got = prefix.running(data, [F.col("a"), F.col("b")], F.col("w"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "SinglePartition" not in plan
    total = 0
    for (a, b), some in itertools.groupby(sorted(got.collect(), key=lambda r: (r.a is not None, r.a or 0, r.b, r.before)), key=lambda r: (r.a, r.b)):
        for r in some:
            assert r.before == total
            total += r.w
    values = [r[1] for r in rows]
    spots = duplicates.at_positions(data, "b", {"low": 0.0, "mid": 0.5, "top": 1.0}).first()
    assert (spots.low, spots.mid, spots.top) == (min(values), sorted(values)[350], max(values))
    assert duplicates.at_positions(data.limit(0), "b", {"mid": 0.5}).first().mid is None and prefix.running(data.limit(0), [F.col("a")]).count() == 0
    ids = questions.numbered(data.select(F.col("b").alias("_order")), "q").orderBy("_order", "id").collect()
    assert sorted(r.id for r in ids) == sorted(f"q{i:03d}" for i in range(1, 701)) and [r.id for r in ids if r["_order"] == max(values)][-1] == "q700"


def jaccard(a, b, k=256):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_links_connect_what_pairs_would(spark, monkeypatch):
    rng = random.Random(12)
    sets = []
    for _ in range(25):  # families whose members drift, sharing one passage with everything
        s = set(rng.sample(range(10**6), 30))
        for _ in range(rng.randrange(1, 9)):
            s = set(s) - set(rng.sample(sorted(s), rng.randrange(0, 7))) | {rng.randrange(10**6) for _ in range(5)}
            sets.append(sorted(s | {1, 2, 3}))
    data = spark.createDataFrame(list(enumerate(sets)), "doc_id int, s array<int>")
    names = [0.3, 0.6, 0.8]
    for pairs in (duplicates.PAIRS, 0):
        monkeypatch.setattr(duplicates, "PAIRS", pairs)
        for t in names[: 3 if pairs else 2]:
            root = list(range(len(sets)))
            find = lambda x: x if root[x] == x else find(root[x])
            for i, j in itertools.combinations(range(len(sets)), 2):
                if jaccard(sets[i], sets[j]) >= t:
                    root[max(find(i), find(j))] = min(find(i), find(j))
            got = {r.doc_id: r.cluster_id for r in duplicates.clusters(data, t).collect()}
            size = collections.Counter(map(find, range(len(sets))))
            assert got == {i: find(i) for i in range(len(sets)) if size[find(i)] > 1}
    best = {i: max(jaccard(sets[i], sets[j]) for j in range(len(sets)) if j != i) for i in range(len(sets))}
    got = {r.doc_id: r.nearest for r in duplicates.nearest(data).collect()}
    assert got.keys() == best.keys() and all(abs(got[i] - best[i]) < 1e-12 for i in best)


def test_nearest_by_common_hashes_is_scored_in_proportion(spark, monkeypatch):
    rng, n, scored = random.Random(4), 900, []
    monkeypatch.setattr(duplicates, "COMMON", 20, raising=False)
    inner = duplicates._scored
    monkeypatch.setattr(duplicates, "_scored", lambda pairs, classes, k: (scored.append(pairs.count()), inner(pairs, classes, k))[1])
    sets = []
    for i in range(n):  # hashes of their own, some common ones, and rare ones that two or three share
        own = rng.sample(range(10**6), rng.choice((3, 30, 60)))
        sets.append(sorted(set(own) | {10**7 * x for x in rng.sample(range(8), rng.randrange(6))} | ({10**8 + i // 3} if i % 5 == 0 else set())))
    data = spark.createDataFrame(list(enumerate(sets)), "doc_id int, s array<int>").repartition(4)
    k = 48
    got = {r.doc_id: r.nearest for r in duplicates.nearest(data, k).collect()}

    def score(a, b):
        least = sorted(set(a) | set(b))[:k]
        return len(set(a) & set(b) & set(least)) / len(least)

    for i in range(0, n, 9):
        assert abs(got[i] - max(score(sets[i], sets[j]) for j in range(n) if j != i)) < 1e-12
    assert sum(scored) < 5 * n  # all pairs that share a common hash would be over 200 for each


def test_a_family_of_near_copies_is_scored_in_proportion(spark, monkeypatch):
    n, met = 3000, []
    rows = [(i, sorted(set(range(1, 101)) - {1 + i % 100, 1 + i // 100 % 100} | {1000 + 2 * i, 1001 + 2 * i})) for i in range(n)]
    data = spark.createDataFrame(rows, "doc_id int, s array<int>").repartition(4)
    plain = duplicates._scored
    monkeypatch.setattr(duplicates, "_scored", lambda pairs, *a: met.append(pairs.count()) or plain(pairs, *a))
    assert {(r.cluster_id, r.size) for r in duplicates.clusters(data, 0.8).collect()} == {(0, n)}
    assert sum(met) < 5 * n


def plain_facts(rows, limit, used, share, key):
    """The rule in turn: rows in seeded order, one for a document, no field over its share; then, if there are too few, without shares."""
    most, counts, done, out = max(1, int(limit * share)), dict(used), set(), []
    for capped in (True, False):
        for r in sorted(rows, key=lambda r: (key[r["doc_id"]], r["doc_id"], r["place"])):
            if len(out) < limit and r["doc_id"] not in done and not (capped and counts.get(r["field"], 0) >= most):
                done.add(r["doc_id"])
                counts[r["field"]] = counts.get(r["field"], 0) + 1
                out.append((r["question"], r["field"], str(r["doc_id"])))
    return out


def test_facts_are_chosen_as_in_turn(spark):
    rng = random.Random(9)
    for case in range(5):
        rows = []
        for d in range(40):
            fields = rng.sample(["a", "b", "c", "d"], rng.randrange(0, 4)) if case else ["a"]
            rows += [{"question": f"q{d}{f}", "answer": "x", "field": f, "doc_id": f"d{d}", "place": i, "corpus_occurrences": 1} for i, f in enumerate(fields)]
        limit, share = [(12, 0.4), (12, 0.25), (30, 0.3), (60, 0.4), (1, 0.4)][case]
        used = {"a": 2, "z": 5} if case == 1 else {}
        data = spark.createDataFrame(rows, "question string, answer string, field string, doc_id string, place int, corpus_occurrences long").repartition(3)
        key = {r.doc_id: r.k for r in data.select("doc_id", questions.seeded(F.col("doc_id"), 0).alias("k")).collect()}
        got = [(r.question, r.answer_field, r.gold_doc) for r in questions.fact_questions(data, limit, used, share).orderBy("_order").collect()]
        assert got == plain_facts(rows, limit, used, share, key)
    assert questions.fact_questions(data.limit(0), 5).count() == 0


def test_days_and_fields_of_a_table(spark):
    rows = [("2026-08-03",), ("2026-08-03",), ("2026-08-06T10:00:00",), ("2026-08-08",), ("soon",), (None,)]
    data = spark.createDataFrame(rows, "publication_date string")
    days = lambda back=None: [(str(r.day), r.n) for r in ingest.covered_days(data, back=back).orderBy("day").collect()]
    assert days() == [("2026-08-03", 2), ("2026-08-04", 0), ("2026-08-05", 0), ("2026-08-06", 1), ("2026-08-07", 0)] and days(3) == days()[2:]
    assert ingest.covered_days(data.limit(0)).count() == 0
    details = spark.createDataFrame([('{"title": "a", "type": null}',), ('{"title": "b"}',), ("broken",), (None,)], "detail string")
    assert {(r.field, r.n) for r in reports.probed(details, ["title", "type", "gone"]).collect()} == {("title", 2), ("type", 1), ("gone", 0)}


def test_shares_of_nothing(spark):
    row = spark.createDataFrame([(3, 4), (0, 0)], "a long, b long").select(evaluation.share_of(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in row] == [0.75, None]
    none = spark.createDataFrame([], "id string, gold_doc string, hit boolean, rank int, answer_in_context boolean, answer_in_gold_context boolean")
    assert evaluation.retrieval_metrics(none).first().hit_rate is None


def test_needles_are_found_like_plain_search(spark, monkeypatch):
    from lexiquarry.functions import needles

    rng = random.Random(7)
    lay = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.cumsum([0, *map(len, xs)]))
    for size in (60, 1 << 20):
        monkeypatch.setattr(needles, "SLICE", size)
        for letters in (b"ab", b"abcdefg "):
            some = lambda n: bytes(rng.choice(letters) for _ in range(n))
            texts = [some(rng.choice([0, 1, 5, 40, 200])) for _ in range(40)]
            known = list({some(rng.randrange(12)) for _ in range(40)} | {t[3 : 3 + rng.randrange(1, 90)] for t in texts})
            text, start, n = needles.Needles(*needles.keys(*lay(known))).find(*lay(texts))
            data = b"".join(texts)
            assert sorted((t, data[a : a + b]) for t, a, b in zip(text.tolist(), start.tolist(), n.tolist())) == sorted((i, x) for i, t in enumerate(texts) for x in known if x and x in t)
    # numbers stand for needles: a worker's memory follows their count, not their letters
    held = needles.Needles(*needles.keys(*lay([b"%08d" % i * 12 for i in range(50_000)])))
    assert held.both.nbytes + sum(x.nbytes for part in held.parts for x in part if isinstance(x, np.ndarray)) < 64 * 50_000
    docs = spark.createDataFrame([(1, "Grüße an alle Wörter"), (2, None), (3, "an ALLE")], "document_number long, text string")
    asked = spark.createDataFrame([("grüße an",), ("alle",), ("ALLE",), ("",), (None,), ("r w",)], "needle string")
    want = {("grüße an", 1), ("alle", 1), ("ALLE", 1), ("alle", 3), ("ALLE", 3)} | {("", i) for i in (1, 2, 3)}
    for most in (1, 4_000_000):
        assert collections.Counter(map(tuple, questions.occurrences(docs, asked, most=most).collect())) == collections.Counter(want)
    assert questions.occurrences(docs, asked.where("false")).count() == 0


def test_masthead_is_told_by_its_beginnings():
    from lexiquarry.functions import text as T

    lines = ("[Federal Register Volume 1]", "[Rules and Regulations]", "[Proposed Rules]", "[Notices]", "[Page 12]", "[Pages 1-3]", "From the Federal Register Online x", "[FR Doc No: 2-1]", "a [[Page 3]] b", "===", "-----")
    assert all(any(x in line for x in T.MASTHEAD_BEGINS) for line in lines)
    assert len(T.MASTHEAD) == 8


def test_hashes_of_one_class_are_not_ranked(spark):
    """Only what classes share goes on to be ranked; places still count the hashes that one class alone has, which come first."""
    classes = spark.createDataFrame([(1, [1, 2, 9]), (2, [3, 9]), (3, [2, 9])], "rep long, s array<long>")
    got = {(r.rep, r["size"], r.place, r.h, r.n) for r in duplicates._rarest_first(classes).collect()}
    assert got == {(1, 3, 1, 2, 2), (1, 3, 2, 9, 3), (2, 2, 1, 9, 3), (3, 2, 0, 2, 2), (3, 2, 1, 9, 3)}


def test_candidates_of_one_table_are_verified_once(spark, monkeypatch):
    asked, plain = [], questions.verified
    monkeypatch.setattr(questions, "verified", lambda *a, **k: asked.append(1) or plain(*a, **k))
    text = "DKT-{0} is the docket of this notice number {0}"
    docs = spark.createDataFrame([(str(i), f"Title {i}", ["Office"], text.format(i), [f"DKT-{i}"], [], None, None) for i in range(6)], "document_number string, title string, agency_names array<string>, text string, docket_ids array<string>, regulation_id_numbers array<string>, comments_close_on string, effective_on string")
    clustered = docs.select(F.col("document_number").alias("doc_id"), F.lit("0").alias("cluster_id"), F.lit(6).alias("size"))
    assert questions.question_set(docs, docs, clustered, 8).count() > 0 and len(asked) == 1


@pytest.mark.parametrize("seeds", [1, 10**6])
def test_scores_are_added_up_where_a_range_lies(spark, monkeypatch, seeds):
    monkeypatch.setattr(postings, "RANGE", 8)
    monkeypatch.setattr(search, "RANGE", 8)
    monkeypatch.setattr(search, "SEEDS", seeds)
    rng = random.Random(21)
    rows = [(f"d{rng.randrange(60)}", p, " ".join(rng.choices("abcdefghij", [9, 8, 7, 6, 5, 4, 3, 2, 1, 1], k=rng.randrange(1, 30)))) for p in range(500)]
    rows += [(f"d{p}", p, "a b same text") for p in range(500, 560)]
    chunks = spark.createDataFrame([(f"{d}#{p}", d, x, p) for d, p, x in rows], "chunk_id string, doc_id string, text string, position int").repartition(3)
    asked = [(i, " ".join(rng.sample("abcdefghij", 3))) for i in range(5)] + [(7, "same text"), (8, "zzz")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    idx = postings.index(chunks)
    for k, per_doc in ((3, 1), (20, 2), (9, 0)):
        assert {(r.query_id, r["rank"], r.doc_id, r.position, r.score) for r in search.bm25(idx, queries, k, per_doc).collect()} == plain_bm25(rows, asked, k, per_doc)
    # a task passes on each query's best, not a row for each chunk that shares a term
    held = idx.ask(queries)
    got = held.best(None, 3, 1, 6)
    assert got.count() <= 6 * 3 * int(spark.conf.get("spark.sql.shuffle.partitions")) < held.postings.join(held.rows, "term").agg(F.sum("n")).first()[0]


def test_shares_half_way_round_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    ranks = {"a": [4, 10] + [None] * 158, "b": [1] * 41 + [None] * 599, "c": [3] * 999 + [4] + [None] * 2200}
    rows = [(t, "g", r is not None, r) for t, rs in ranks.items() for r in rs]
    frame = spark.createDataFrame(rows, "type string, gold_doc string, hit boolean, rank int").withColumns({"answer_in_context": F.col("hit"), "answer_in_gold_context": F.lit(False)})
    got = {r["type"]: (r["hit_rate"], r["mrr"]) for r in evaluation.retrieval_metrics(frame.repartition(3), "type").collect()}
    asked = "SELECT round({} / {}::DOUBLE, 6), round({}::DOUBLE / {}, 6)"
    # the sums of 1 / rank as they are: 0.35, 41 and 333.25
    for t, total in (("a", "0.35"), ("b", "41.0"), ("c", "333.25")):
        n, hits = len(ranks[t]), sum(r is not None for r in ranks[t])
        assert got[t] == duckdb.sql(asked.format(hits, n, total, n)).fetchall()[0]


def test_nearest_sends_no_side_by_guesses_of_its_size(spark):
    texts = [(i, f"alpha beta gamma delta epsilon {'zeta eta' if i % 2 else 'theta iota'} kappa {i % 5}") for i in range(20)]
    sketched = duplicates.sketches(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", most=None)
    classes = duplicates._classes(duplicates._named(sketched))
    for df in (duplicates._placed(classes), duplicates.nearest(sketched)):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
