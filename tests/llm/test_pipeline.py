import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexiquarry.llm import decontam, langid, mixing, simhash, tokenbin


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    vocab = {"en": ["the", "thing", "with", "house", "water", "pier"], "de": ["der", "und", "nicht", "wasser", "schön", "haus"]}
    word = lambda y: rng.choice(vocab[y]) + str(rng.randrange(99))
    item = " ".join(word("en") for _ in range(20))
    rows = [(i, " ".join(word(y) for _ in range(rng.randrange(30, 90))), y, rng.choice(["a", "a", "b"]), 1) for i in range(150) for y in [rng.choice(["en", "de"])]]
    rows += [(200 + k, rows[k][1], rows[k][2], "a", 1) for k in range(20)] + [(300, "tail " + item + " end", "en", "b", 1), (301, None, "en", "b", 1), (302, "123", "en", "b", 1)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, at).collect())

    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = langid.fit(docs)
    left = [r for r in rows if not model.predict(r[1])[2]]
    prints = {r[0]: simhash.fingerprint(r[1]) for r in left}
    label = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    left = [r for r in left if label[r[0]] == r[0]]
    norm = decontam.normalise(item)
    left = [r for r in left if decontam.fuzzy_find(norm, decontam.normalise(r[1]))[0] > int(decontam.RATE * len(norm))]
    assert 300 not in {r[0] for r in left} and not {r[0] for r in left} & set(range(200, 220)) and len(left) >= 140
    mixed = mixing.mix(spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    tok = Tokenizer.from_file(tokenbin.vocabulary())
    want = []
    for r in mixed:
        ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == sorted(want)


def test_stages_on_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["the", "thing", "with", "house", "water", "pier"]) + str(rng.randrange(99)) for _ in range(40))
    rows = [(i, text(), "en", "a", 1, i) for i in range(60)]
    item = rows[5][1]
    rows += [(7, text(), "en", "a", 1, 100), (7, text(), "en", None, 1, 101), (None, text(), "en", "b", 1, 102), (None, rows[3][1], "en", "b", 1, 103), (61, rows[3][1], "en", "b", 1, 104), (61, rows[3][1], "en", "b", 1, 105), (62, None, "en", "b", 1, 106), (63, "", "en", "b", 1, 107), (64, " ".join([text()] * 800), "en", "b", 1, 108)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept long"
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("tag", "_first", "_epoch", "s", "i", "t", "fp")})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, at)
    assert known.columns == docs.columns and {r.kept for r in known.collect()} == {k for *_, k in rows if k not in (106, 107)}
    one = stages["near_dedup"](spark, known, at)
    assert one.columns == docs.columns and {r.kept for r in one.collect()} == set(range(60)) | {100, 101, 102, 108}
    clean = stages["decontaminate"](spark, one, at)
    assert clean.columns == docs.columns and {r.kept for r in clean.collect()} == (set(range(60)) | {100, 101, 102, 108}) - {5}
    mixed = stages["mix_sources"](spark, clean, at)
    assert mixed.columns == docs.columns and {r.kept for r in mixed.collect()} <= {r.kept for r in clean.collect()}
    out = sorted(stages["token_output"](spark, clean, at).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in clean.collect()), key=lambda i: (i is not None, i or 0))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0, name
