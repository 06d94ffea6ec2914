import random
import re
import unicodedata

from lexiquarry.plans import catalogue, evidence  # noqa: F401  evidence adds its queries to the catalogue


def plain(s):
    return re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", s).lower()).strip()


def test_answers_match_in_every_pair(spark, tmp_path):
    pairs = [("Où est né Zoé", "On sait ou est ne Zoe."), ("Où est né Zoé", "Ailleurs."), ("who was it", "Who was it? I know."), ("ﬁn du débat", "FIN DU DÉBAT"), ("a b c", "I cannot find it, señor")]
    rows = [(i, k, role, text) for i, both in enumerate(pairs) for k, (role, text) in enumerate(zip(("user", "assistant"), both))]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    got = {r.id: (r.whole, r.refused) for r in catalogue.QUERIES["answer_matching_all"](spark, at).collect()}
    want = {f"{i}-0": (plain(" ".join(q.split()[:3])) in plain(a), plain(a).startswith("i cannot find")) for i, (q, a) in enumerate(pairs)}
    assert got == want and sum(w for w, _ in want.values()) == 3


def test_result_rows_decompose_answers(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, "Où est né le peintre célèbre", "fr", "s", 1), (2, "unrelated words of another text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, "Où est né le peintre célèbre")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    seen = []
    old = catalogue.evaluation.scored
    catalogue.evaluation.scored = lambda *a, **k: seen.append(k.get("ascii_only", False)) or old(*a, **k)
    try:
        (row,) = catalogue.QUERIES["result_rows"](spark, at).collect()
    finally:
        catalogue.evaluation.scored = old
    assert row.answer_in_context and row.answer_in_gold_context and seen == [False]


def test_every_twentieth_vector_is_asked(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, i % 7, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(130)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")

    def ranked(scores, k, per_doc):  # (score, doc, position), as capped_sql orders them
        kept, seen = [], {}
        for s, d, p in sorted(scores, key=lambda x: (-x[0], x[2])):
            seen[d] = seen.get(d, 0) + 1
            if not per_doc or seen[d] <= per_doc:
                kept.append((s, d, p))
        return sorted(kept, key=lambda x: (-x[0], x[1], x[2]))[:k]

    dense, fused = set(), set()
    for i, _, v in rows:
        if i % 20 == 0:
            scores = [(round(sum(a * b for a, b in zip(v, w)), 5), d, j) for j, d, w in rows]
            dense |= {(i, r, d, p) for r, (_, d, p) in enumerate(ranked(scores, 5, 2), 1)}
            total = {}
            for per_doc in (0, 1):
                for r, (_, d, p) in enumerate(ranked(scores, 50, per_doc), 1):
                    total[d, p] = total.get((d, p), 0) + 1 / (60 + r)
            fused |= {(i, r, d, p) for r, (_, d, p) in enumerate(ranked([(round(s, 9), *dp) for dp, s in total.items()], 5, 2), 1)}
    for name, want in (("search_dense", dense), ("search_fused", fused)):
        assert {(r.query_id, r["rank"], r.doc_id, r.position) for r in catalogue.QUERIES[name](spark, at).collect()} == want and len({q for q, *_ in want}) == 7


def test_clusters_read_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    head, tail = text(20_000), text(40_000)
    rows = [(1, f"{head} {text(40_000)}"), (2, f"{head} {text(40_000)}"), (3, f"{text(500)} {tail}"), (4, f"{text(500)} {tail}")]
    at = f"file://{tmp_path}"
    spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    assert {(r.doc_id, r.cluster_id) for r in catalogue.QUERIES["near_clusters_crc"](spark, at).collect()} == {(3, 3), (4, 3)}
