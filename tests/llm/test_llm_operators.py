"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import anchors, bytesdedup, decontam, fuzzylines, langid, mixing, repeats, secretscan, simhash, tokenbin, topk, windows

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = ["lake", "pier", "öl", "the", "of", "zone", "a", "river", "ñandú", "x9"]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) + rng.choice(["", "", ".", str(rng.randrange(50))]) for _ in range(rng.randrange(0, 120))]
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n" + passage + "  \t" + text[:30]
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(n, rows[0][1], "en", "s0", 0), (n + 1, None, None, None, None), (n + 2, "", "en", "s1", 0), (n + 3, "long " * 30_000, "en", "s0", 1), (n + 4, rows[4][1], "de", "s0", 0), (n + 4, rows[4][1], "de", "s0", 0), (None, passage, "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), ROWS).withColumns({"key": F.lit(1), "t": F.lit("t"), "doc": F.lit(9), "s": F.lit("s"), "i": F.lit(3)})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ROWS)


def texts():
    return [(i, (t or "").encode()) for i, t, *_ in corpus()]


@pytest.mark.parametrize("shard", [repeats.SHARD, 1])
def test_word_windows(docs, nothing, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in windows.dedup(docs).collect())
    count = collections.Counter(tuple(w[p : p + 35]) for _, t in texts() for w in [t.split()] for p in range(len(w) - 34))
    want = collections.Counter()
    for i, t in texts():
        w = t.split()
        out = set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                out |= set(range(p, p + 35))
        want[i, len(w), len(out), b" ".join(x for k, x in enumerate(w) if k not in out)] += 1
    assert got == want
    assert windows.dedup(nothing).count() == 0


@pytest.mark.parametrize("shard", [repeats.SHARD, 1])
def test_byte_strings(docs, nothing, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bytesdedup.dedup(docs).collect())
    first = {}
    for i, t in texts():
        for p in range(len(t) - 49):
            if i is not None:
                first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    want = collections.Counter()
    for i, t in texts():
        cut = bytearray(len(t))
        for p in range(len(t) - 49):
            if i is not None and first[t[p : p + 50]] < i:
                cut[p : p + 50] = b"\1" * 50
        spans = sum(c and (not k or not cut[k - 1]) for k, c in enumerate(cut))
        want[i, len(t), sum(cut), spans, bytes(x for x, c in zip(t, cut) if not c)] += 1
    assert got == want
    assert bytesdedup.dedup(nothing).count() == 0


def test_words_built_to_collide_stay_apart(spark):
    bit = lambda i: i.bit_count() & 1
    for n in (1024, 2048, 4096):
        word, other = (bytes(b"ab"[bit(i) ^ x] for i in range(n)) for x in (0, 1))
        units, lens = anchors.word_units([word + b" " + other])
        assert units[0] != units[1] and lens.tolist() == [2]
    a, b = (" ".join("ab"[bit(i) ^ x] * 3 for i in range(64)) for x in (0, 1))
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(34)) + " " + word.decode()), (2, " ".join(f"w{i}" for i in range(34)) + " " + other.decode())], "doc_id long, text string")
    assert [r.n_removed for r in windows.dedup(docs).collect()] == [0, 0] and a != b


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(50):
        ts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        want = sorted(((k, o) for k, t in enumerate(ts) for o in range(len(t) + 1)), key=lambda x: ([y + len(ts) for y in ts[x[0]][x[1] :]] + [x[0]]))
        assert bytesdedup.suffix_order(ts, 2, 3) == want


def test_long_texts_are_cut_in_pieces(monkeypatch):
    data = [bytes(random.Random(2).choice(b"abcd") for _ in range(5000))]
    whole = anchors.runs(*anchors.byte_units(data), 50, 20)
    monkeypatch.setattr(anchors, "PIECE", 700)
    monkeypatch.setattr(anchors, "pieces", lambda lens, window, most=700: _pieces(lens, window, most))
    cut = anchors.runs(*anchors.byte_units(data), 50, 20)
    at = lambda r: {(int(s) + i, int(k)) for s, c, k in zip(r.start, r.count, r.key) for i in range(c)}
    assert at(whole) == at(cut)


def _pieces(lens, window, most):
    for doc in np.flatnonzero(lens >= window):
        for at in range(0, int(lens[doc]) - window + 1, most - window + 1):
            yield int(doc), at, min(most, int(lens[doc]) - at)


def test_simhash(docs, nothing, monkeypatch):
    from xxhash import xxh64_intdigest as h

    monkeypatch.setattr(simhash, "HOT", 3)  # also the second cut
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = []
    for i, t in texts():
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.translate(simhash._LOWER))
        each = [h(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in each) > len(each))))
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    low = {}
    for (i, _), g in zip(prints, label):
        if i is not None:
            low[g] = min(i, low.get(g, i))
    want = sorted((i is None, i, f"{p:016x}", low.get(g)) for (i, p), g in zip(prints, label))
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("files", [False, True])
def test_one_row_of_each_group_stays(spark, nothing, files, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (None, a), (None, c), (None, c), (9, b), (9, b), (2, None), (5, ""), (None, None), (11, "x " * 50_000), (12, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(4) for k in ("kept", "tag", "_first", "low", "fp", "c0")})
    if files:
        docs.repartition(3).write.parquet(f"file://{tmp_path}/docs")
        docs = spark.read.parquet(f"file://{tmp_path}/docs")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:2], r.kept, r.tag) for r in got.collect()) == [(0, "c0", 4, 4), (2, "", 4, 4), (3, "a0", 4, 4), (7, "b0", 4, 4), (11, "x ", 4, 4)]
    assert simhash.keep_one(nothing).count() == 0


def test_trees_lose_no_link():
    rng = np.random.default_rng(3)
    v = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)))
    groups = simhash.Groups(len(v))
    simhash.Tree(v).link(np.arange(len(v)), 4, groups)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(1)
        if (new == label).all():
            break
        label = new
    assert (label == groups.label).all()


def test_token_file(docs, nothing, spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenbin.vocabulary())
    got = sorted(tokenbin.token_binary(docs).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, (i, t, *_) in zip(got, order):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(order) and tokenbin.token_binary(nothing).count() == 0


def test_another_vocabulary_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    told = json.loads(open(tokenbin.vocabulary()).read()) | {"normalizer": {"type": "Lowercase"}}
    at = tmp_path / "lower.json"
    at.write_text(json.dumps(told))
    texts = ["One Two THREE, four.", "", "Émile  and\nÖL", "a" * 500]
    got = tokenbin.Encoder(str(at))([*texts, None])
    assert [x.tolist() for x in got] == [*(Tokenizer.from_file(str(at)).encode(t, add_special_tokens=False).ids for t in texts), []]
    assert got[0].tolist() != tokenbin.Encoder(tokenbin.vocabulary())(texts)[0].tolist()


def test_pieces_are_encoded_like_whole_texts():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(tokenbin.vocabulary()), tokenbin.Encoder(tokenbin.vocabulary()), random.Random(5)
    parts = ["abc", " ", "  ", "\n", " \n", "\n ", "a.", "é", "ß.", "I'm", "12", "\t", "　", "<|endoftext|>", "日本", "!!", "\xa0", "", "\x85", "\x1c", "😀"]
    for _ in range(300):
        some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        assert [g.tolist() for g in enc(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 700, 200_000):
        ids = rng.zipf(1.3, n).clip(1, 3000).astype(np.uint32)
        coder = tokenbin.Coder(tokenbin.frequencies(np.bincount(ids, minlength=3001)))
        lanes = 512 if n > 1000 else 4
        packed = coder.encode(ids, lanes)
        assert (coder.decode(n, lanes, *packed) == ids).all()
        if n > 100_000:
            step = tokenbin.STRIDE * lanes
            assert (coder.decode(n, lanes, *packed, first=1, last=2) == ids[step : 2 * step]).all() and (coder.decode(n, lanes, *packed, first=2) == ids[2 * step :]).all()


def test_damage_is_found(docs, spark, tmp_path):
    path = f"file://{tmp_path}/f"
    tokenbin.write(docs.limit(5), path, tokenbin.vocabulary())
    bad = spark.read.parquet(f"{path}/blocks").withColumn("payload", F.concat(F.lit(b"\0\0\0\0"), F.expr("substring(payload, 5)")))
    bad.write.parquet(f"{path}2/blocks")
    spark.read.parquet(f"{path}/table").write.parquet(f"{path}2/table")
    with pytest.raises(Exception, match="damaged"):
        tokenbin.read(spark, f"{path}2").collect()


def test_language_id(spark, nothing):
    rng = random.Random(2)
    vocab = {"en": ["the", "thing", "with", "house", "water"], "de": ["der", "und", "nicht", "wasser", "schön"], "fr": ["le", "eau", "maison", "être", "où"]}
    rows = [(i, " ".join(rng.choice(vocab[y]) for _ in range(30)), y, "s", 1) for i in range(240) for y in [rng.choice(list(vocab))]]
    rows += [(900, None, "en", "s", 1), (901, "123 !!", "en", "s", 1), (902, "wasser und", None, "s", 1), (None, "the house", "en", "s", 1)]
    docs = spark.createDataFrame(rows, ROWS).withColumns({"i": F.lit(0), "t": F.lit("z")})
    model = langid.fit(docs)
    got = langid.classify(docs, model).collect()
    lang = {i: y for i, _, y, *_ in rows}
    held = [(r, lang[r.doc_id]) for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id < 900]
    assert len(held) > 40 and sum(r.lang_pred == y for r, y in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0 and by[902].lang_pred == "de" and len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {900, 901} & {r.doc_id for r in kept.collect()} == set()
    assert sum(r.rejected for r in got if r.doc_id is not None and r.doc_id < 900) <= 2
    empty = langid.fit(nothing)
    assert langid.classify(docs.limit(1), empty).first().lang_pred == "und" and langid.classify(nothing, model).count() == 0


def brute_topk(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_language_id_rejects_what_it_never_learned():
    rng = random.Random(4)
    vocab = {"en": ["the", "thing", "with", "house", "water"], "de": ["der", "und", "nicht", "wasser", "schön"], "fr": ["le", "eau", "maison", "être", "où"]}
    rows = [(" ".join(rng.choice(vocab[y]) for _ in range(30)), y) for y in rng.choices(list(vocab), k=400)]
    model = langid.train(*zip(*rows[:300]))
    assert 0.06 < model.temperature < 15
    assert sum(model.predict(t)[2] for t, _ in rows[300:]) <= 1 and all(model.predict(t)[0] == y for t, y in rows[300:])
    for text in ("我们今天去北京看朋友，天气很好", "Сегодня мы поехали в Москву, чтобы увидеть друзей", "ذهبنا اليوم إلى المدينة لرؤية الأصدقاء", "xkcd qwrt zpfg hjklm vbnq wrtp zxcvb", "4f3a9bc0de12ff7718a0c3d5e6b79f01"):
        assert model.predict(text)[2], text


def test_topk_stops_before_the_last_segment():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(2000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1)[:, None])
    ids, asked, stats = np.arange(2000), np.arange(0, 2000, 50), []
    got = topk.search_block(asked, vectors[asked], topk.index_block(ids, vectors), 5, stats)
    scores = (vectors[asked] @ vectors.T).astype(int)
    want = [(q, *x) for q, row in zip(asked.tolist(), scores.tolist()) for x in sorted(((i, s) for i, s in enumerate(row) if i != q), key=lambda x: (-x[1], x[0]))[:5]]
    assert got == want
    read, of, again = stats[0]
    assert read < 0.6 * of and again < 0.2 * 2000 * len(asked)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "MEMBERS", 60)
    monkeypatch.setattr(topk, "QUERIES_EACH", 2)
    monkeypatch.setattr(topk, "QUERY_BYTES", 300)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows[3] = (3, rows[2][1])
    rows += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [0.1]), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "x": F.lit(0), "q": F.lit(1)})
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_topk(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    large = [(i, [float(x) for x in rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 7)]) for i in range(120)] + [(200, [3e300] + [0.0] * 63), (201, [4e300] + [1.0] * 63), (202, [-4e300] + [0.0] * 63)]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    fit = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    assert got == {(a, b, c, fit(d)) for a, b, c, d in brute_topk(large)}


def test_mixing(spark, nothing):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", rng.choice(["big"] * 8 + ["mid", None]), 1) for i in range(400)] + [(500, None, "en", "big", 1), (501, "", "en", "empty", 1), (None, "w w", "en", "big", 1)]
    docs = spark.createDataFrame(rows, ROWS).withColumns({"s": F.lit("clash"), "epoch": F.lit(1), "n": F.lit(1), "block": F.lit(2)})
    plan = {r.s: r for r in mixing.plan(docs, block_tokens=64).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
    got = mixing.mix(docs, block_tokens=64).collect()
    tokens = collections.Counter()
    reads = collections.defaultdict(collections.Counter)
    for r in got:
        tokens[r.source or ""] += len((r.text or "").split())
        reads[r.source or ""][r.doc_id] += 1
    longest = 60
    for s, p in plan.items():
        assert p.quota - longest <= tokens[s] <= p.quota
        assert not reads[s] or max(reads[s].values()) - min(reads[s].values()) <= 1 or p.epoch == 0
        assert p.quota <= mixing.REPEATS * max(1, p.tokens) + 1
    assert plan["big"].weight < plan["big"].tokens / sum(p.tokens for p in plan.values())
    assert mixing.mix(docs, block_tokens=64).columns[: len(docs.columns)] == docs.columns
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(mixing.mix(docs, block_tokens=64), block_tokens=64)
    assert again.columns[-8:] == ["_epoch", "_block", "_order", "_rank", "__epoch", "__block", "__order", "__rank"] and mixing.mix(docs, places=False).columns == docs.columns


def test_secrets(spark, nothing):
    rng = random.Random(4)
    secret = "".join(rng.choice(secretscan.ALNUM) for _ in range(48))
    rows = [
        (1, 'x password = "hunter2x" Token:abc API-KEY=nothere api_key=\'abcdef\' é' + "AKIA" + "A1" * 9 + " " + "ab12" * 7, None, None, 1),
        (2, None, None, None, 1), (3, "", None, None, 1), (4, f"blob {secret} and {chr(122) * 62}1111111111", None, None, 1), (5, "secret=token: abcdefgh", None, None, 1), (5, "AKIA123", None, None, 1), (None, "secret:abcdefg", None, None, 1), (6, "deadbeef" * 4000, None, None, 1),
    ]
    docs = spark.createDataFrame(rows, ROWS).withColumns({"x": F.lit(1), "base": F.lit(2)})
    got = secretscan.scan(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        want[i, tuple(sorted(spans))] += 1
    assert collections.Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in got) == want
    assert [s.hit for r in got if r.doc_id == 4 for s in r.found] == [secret]
    assert secretscan.scan(nothing).count() == 0


def test_randomness_tells_text_from_noise(spark):
    rng = random.Random(6)
    noise = ["".join(rng.choice(secretscan.ALNUM) for _ in range(40)) for _ in range(50)]
    text = ["thelongwordofsomekind" * 2 + "2" for _ in range(5)] + ["a1" * 20]
    p = [r.p for r in spark.createDataFrame([(x,) for x in noise + text], "s string").select(secretscan.randomness(F.col("s")).alias("p")).collect()]
    assert sum(x > 0.05 for x in p[:50]) >= 40 and max(p[50:]) < 0.01


def edited(rng, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcdefgh")
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, rng.choice("abcdefgh"))
    return "".join(out)


def test_decontamination(spark, nothing):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 12, 15, 18, 25, 40, 60, 80] * 3)] + [(90, None), (91, "tiny")]
    rows, want = [], set()
    for i in range(200):
        text = " ".join(word() for _ in range(80))
        if i % 2:
            k, item = items[rng.randrange(24)]
            text += " " + edited(rng, item, rng.choice([0, 0, 0.03, 0.06])).upper() + " " + word()
        rows.append((i, text, "en", "s", 1))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (None, items[7][1], "en", "s", 1)]
    for i, t, *_ in rows:
        for k, item in items:
            n = decontam.normalise(item)
            if len(n) >= decontam.SHORTEST and decontam.fuzzy_find(n, decontam.normalise(t))[0] <= int(decontam.RATE * len(n)):
                want.add((i, k))
    docs, bench = spark.createDataFrame(rows, ROWS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 90
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({i for i, _ in got})
    assert decontam.contaminated(nothing, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_recall_at_the_full_rate_by_length():
    """Items with all the edits that the rate allows, in bands of length; each band reaches 0.95."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = []
    for i in range(200):
        size, text = int(17 * (300 / 17) ** rng.random()), word()
        while len(text) < size:
            text += " " + word()
        items.append((i, text))
    index, found = decontam.Index(items), collections.defaultdict(list)
    assert all(1 <= w <= decontam.MOST_WALKS for w in index.walks) and decontam.Index(items, walks=index.walks).walks == index.walks
    for i, item in items:
        most = int(decontam.RATE * len(item))
        for _ in range(3):
            out = list(item)
            for _ in range(most):
                k, kind = rng.randrange(len(out)), rng.randrange(3)
                out[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdefgh")]
            text = " ".join(word() for _ in range(15)) + " " + "".join(out) + " " + " ".join(word() for _ in range(15))
            if decontam.fuzzy_find(item.encode(), decontam.normalise(text))[0] <= most:
                found[sum(len(item) >= x for x in (32, 64, 128, 220))].append(any(x == i for _, x, _ in index.find([text])))
    assert len(found) == 5 and all(len(v) > 60 and sum(v) >= 0.95 * len(v) for v in found.values()), {k: sum(v) / len(v) for k, v in found.items()}


def test_short_items_are_found_at_word_bounds():
    index = decontam.Index([(1, "Tiny"), (2, "a  b"), (3, ""), (4, "tiny"), (5, "a long item of many bytes")])
    got = index.find(["destiny", "a TINY, thing", None, "x a b", "a bc", "tiny", "here a long item of many bytes"])
    assert [g[:2] for g in got] == [(1, 1), (1, 4), (3, 2), (5, 1), (5, 4), (6, 5)]
    assert decontam.Index([(1, "tiny")]).find(["", "tiny"]) == [(1, 1, 0)]


def test_fuzzy_find_is_exact():
    rng = random.Random(9)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, 30))) for lo in (1, 0))
        assert decontam.fuzzy_find(a, b)[0] == slow(a, b) and fuzzylines.distance(a, b) == whole(a, b)


def test_fuzzy_lines(spark, nothing):
    rng = random.Random(11)
    base = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12)) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.02])) if rng.random() < 0.6 else " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(9)) for _ in range(5)]
        rows.append((i, "\n".join([*lines, "short", ""]), "en", "s", 1))
    rows += [(100, None, "en", "s", 1), (101, "", "en", "s", 1), (None, base[0].upper(), "en", "s", 1), (102, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, ROWS).withColumns({"h": F.lit(1), "no": F.lit(2), "first": F.lit(0)})
    got = {r.doc_id: r for r in fuzzylines.dedup(docs).collect()}
    places = collections.defaultdict(list)
    for i, t, *_ in rows:
        for k, line in enumerate(fuzzylines.normalised(t)):
            if line:
                places[line].append((i is not None, i or 0, k))
    lines = list(places)
    label = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if min(len(lines[a]), len(lines[b])) >= fuzzylines.SHORTEST and fuzzylines.alike(lines[a], lines[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    best = {}
    for g, line in zip(label, lines):
        best[g] = min(([best[g]] if g in best else []) + places[line])
    gone = collections.Counter(p[1] if p[0] else None for g, line in zip(label, lines) for p in places[line] if p != best[g])
    assert {i: r.n_removed for i, r in got.items()} == {i: gone[i] for i, *_ in rows} and sum(gone.values()) > 50
    assert got[100].kept is None and got[101].kept == b"" and got[100].n_lines == 0
    assert fuzzylines.dedup(nothing).count() == 0


def test_fuzzy_lines_against_edit_similarity(spark):
    """Recall against every pair of an edit similarity of 0.8 and more; short lines fold if equal."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows, want = [], 0
    for i in range(240):
        line = " ".join(word() for _ in range(rng.choice([8, 12, 20, 40])))
        other = edited(rng, line, rng.choice([0.01, 0.05, 0.1, 0.15, 0.18]))
        want += fuzzylines.alike(line.encode(), " ".join(other.split()).encode())
        rows.append((i, f"{line}\n{other}", "en", "s", 1))
    lines = [x for _, t, *_ in rows for x in fuzzylines.normalised(t)]
    apart = [(a, b) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if i // 2 != j // 2 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b))]
    assert not any(fuzzylines.alike(a, b) for a, b in apart)  # so what is removed is one line of each pair that is alike
    got = sum(r.n_removed for r in fuzzylines.dedup(spark.createDataFrame(rows, ROWS)).collect())
    assert want > 200 and 0.9 * want <= got <= want
    short = spark.createDataFrame([(1, "Yes\n\nno", "en", "s", 1), (2, "yes \n\nyet", "en", "s", 1)], ROWS)
    assert {r.doc_id: r.kept for r in fuzzylines.dedup(short).collect()} == {1: b"Yes\n\nno", 2: b"\nyet"}


def test_fuzzy_lines_of_one_language_do_not_meet(spark):
    """Lines made of the same syllables share many grams, but not in one order: only edited copies are worth fetching."""
    rng = random.Random(14)
    syllables = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    lines = [" ".join(word() for _ in range(rng.randint(50, 70))) for _ in range(600)]
    rows = [(i, line, "en", "s", 1) for i, line in enumerate(lines)] + [(1000 + i, edited(rng, line, 0.1), "en", "s", 1) for i, line in enumerate(lines[:40])]
    docs = spark.createDataFrame(rows, ROWS)
    held = fuzzylines.occurrences(repeats.identified(docs, "doc_id", "text"))
    assert 70 <= fuzzylines.met(held, fuzzylines.SIMILARITY).count() <= 200
    gone = [r.doc_id for r in fuzzylines.dedup(docs).collect() if r.n_removed]
    assert len(gone) >= 38 and all(i >= 1000 for i in gone)


def test_queries_are_registered():
    from lexiquarry.llm import catalogue

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(catalogue.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 11))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_fuzzy_lines_are_verified_once():
    """Copies that many buckets find go to the verification as one group, links of lines that are few as pairs."""
    h = np.array([5, 3, 9, 7, 1], np.int64)
    pair = fuzzylines.named(h, np.array([0, 0, 2, 3, 4]), np.array([0]), np.array([1])).to_pydict()
    assert pair["h"] == [3, 5] and pair["dense"] == [False, False] and len(set(pair["gid"])) == 1
    group = fuzzylines.named(h, np.array([0, 0, 0, 3, 4]), np.zeros(0, np.int64), np.zeros(0, np.int64)).to_pydict()
    assert group == {"gid": [3, 3, 3], "h": [3, 5, 9], "dense": [True] * 3}


def test_fuzzy_lines_take_sketches_only_where_a_partner_may_be():
    """Entries alone in their bucket, or too far from all others by place or length, are not sent again; no pair that fits is lost."""
    rng = np.random.default_rng(16)
    every = np.empty(4000, fuzzylines._PLACE)
    every["key"], every["h"], every["size"], every["at"] = rng.integers(0, 1500, 4000), np.arange(4000), rng.integers(64, 600, 4000), rng.integers(0, 256, 4000)
    a, b = np.triu_indices(4000, 1)
    fit = (every["key"][a] == every["key"][b]) & (np.abs(every["at"][a].astype(int) - every["at"][b]) <= fuzzylines._drift(0.8))
    fit &= np.minimum(every["size"][a], every["size"][b]) >= 0.8 * np.maximum(every["size"][a], every["size"][b]) - 1e-6
    wanted = set(a[fit].tolist()) | set(b[fit].tolist())
    kept = set(fuzzylines.partnered(every, 0.8)["h"].tolist())
    assert wanted <= kept and len(kept) < 0.5 * len(every)
    assert len(fuzzylines.partnered(every[:0], 0.8)) == 0


def test_long_fuzzy_lines_meet_in_longer_grams(spark):
    """Lines of few syllables share bands of short grams, and rarely landmarks, which edited copies share."""
    rng = random.Random(15)
    syllables = ["the", "an", "er", "on", "re", "in", "th", "ed"]
    lines = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(50)).encode() for _ in range(400)]
    copies = [edited(rng, x.decode(), 0.1).encode() for x in lines]
    sketch = lambda x: np.where(fuzzylines.landmarks(x)[0] > 0, fuzzylines.landmarks(x)[0], -1)
    a, b = sketch(lines), sketch(copies)
    assert ((a == b) & (a > 0)).any(1).mean() > 0.99
    met = np.mean([((a[i] == a[j]) & (a[i] > 0)).any() for i in range(0, 400, 9) for j in range(i)])
    values = fuzzylines.bands(fuzzylines.minhashes(lines)[0])
    assert met < 0.5 * np.mean([(values[i] == values[j]).any() for i in range(0, 400, 9) for j in range(i)])


def test_shared_phrases_are_those_of_triggers_that_several_documents_hold(spark):
    rng = random.Random(5)
    word = lambda: bytes(rng.randrange(97, 123) for _ in range(rng.randrange(2, 9)))
    line, passage = b" ".join(word() for _ in range(20)), b" ".join(word() for _ in range(40))
    docs = []
    for i in range(60):
        own = b" ".join(word() for _ in range(60))
        # one line everywhere, passages of documents far apart and of one document, rows that share an id
        docs.append((i % 55, i, own + line + (passage if i in (3, 58) else b"") + (own if i % 7 == 0 else b"")))
    rows = spark.createDataFrame(docs, "doc long, th long, t binary").repartition(3)
    got = anchors.runs(*anchors.byte_units([t for _, _, t in docs]), bytesdedup.WINDOW, bytesdedup.GRAM)
    every = [(k, docs[d][0], docs[d][1], s, c, g) for k, d, s, c, g in zip(got.key.view(np.int64).tolist(), got.doc.tolist(), got.start.tolist(), got.count.tolist(), got.digest.view(np.int64).tolist())]
    holders = collections.defaultdict(set)
    for key, doc, *_ in every:
        holders[key].add(doc)
    want = collections.Counter(x for x in every if len(holders[x[0]]) > 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # triggers meet within batches and across them
    try:
        assert collections.Counter(map(tuple, repeats.shared(rows, bytesdedup.BYTES).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert 0 < len(want) < len(every)
    assert repeats.shared(rows.where("false"), bytesdedup.BYTES).count() == 0
    columns = [np.array([5, 1 << 63, 7], np.uint64), np.array([1, 2, 3], np.uint64), np.array([-1, 1 << 40, 3]), np.array([0, -9, 2]), np.array([0, 1 << 31, 4]), np.array([31, 0, 1])]
    assert all((a == b).all() for a, b in zip(columns, repeats.unpacked(repeats.packed(*columns))))


def test_line_feeds_and_runs_of_marks_are_cut_before_the_library():
    enc = tokenbin.Encoder(tokenbin.vocabulary())
    rng = random.Random(3)
    parts = ["a", "The", "été", "×", "ɏ", " ", " ", "\n", "\n", "  ", "\t", "\r\n", ".", ",", "***", "$$$", "'", "'s", "'LL", "12", "٣", "漢", "é", "-", "_", "\xa0", "\0", "\x1c", "\x85", "!!!!!!!!!", "?!", " \n", "\n "]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None, "\n", "a\n", "\na", "a\nb", "a\n***", "x***\n", "\0a"]
    lines = ["\n".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}word{m}" for m in (".", "***", "$$$", "")) for i in range(600)]
    for texts in (odd, lines):
        assert [x.tolist() for x in enc(texts)] == [list(e.ids) for e in enc.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    asked, real = [], enc.tok

    class Counted:
        def encode_batch_fast(self, pieces, **options):
            asked.extend(pieces)
            return real.encode_batch_fast(pieces, **options)

    enc.tok = Counted()
    enc(lines)
    assert len(asked) < 10  # the runs of marks, each once; before, every piece with a line feed or a run


def test_suffixes_are_sorted_further_only_where_first_bytes_agree(monkeypatch):
    rng = random.Random(12)
    stems = [bytes(rng.choices(b"ab", k=3)) * 40 for _ in range(6)] + [bytes(rng.choices(b"abc", k=120)) for _ in range(4)]
    for window in (5, 50):
        phrases = [(rng.randrange(4), s[a : a + window - 1 + n], n) for s in stems for a, n in [(rng.randrange(40), rng.randrange(1, 30)) for _ in range(6)]]
        key, count = np.array([k for k, _, _ in phrases]), np.array([n for _, _, n in phrases])
        group = bytesdedup._compare(pa.array([c for _, c, _ in phrases], pa.binary()), key, count, window)
        want = [(k, c[i : i + window]) for k, c, n in phrases for i in range(n)]
        assert len(set(group.tolist())) == len(set(want)) == len(set(zip(group.tolist(), want)))
    assert len(bytesdedup._compare(pa.array([], pa.binary()), key[:0], count[:0], 50)) == 0
    kinds, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: kinds.append(len(keys)) or lexsort(keys))
    bytesdedup._compare(pa.array([rng.randbytes(60) for _ in range(50)], pa.binary()), np.zeros(50, np.int64), np.full(50, 11), 50)
    assert kinds == [2]


def test_covered_units():
    rng = np.random.default_rng(4)
    start, mask = rng.integers(0, 900, 30), rng.integers(-(1 << 63), 1 << 63, 30) & rng.integers(-(1 << 63), 1 << 63, 30)
    want = np.zeros(1000, bool)
    for s, m in zip(start.tolist(), mask.tolist()):
        for i in range(64):
            if m >> i & 1:
                want[s + i : s + i + 35] = True
    assert (anchors.covered(1000, start, mask, 35) == want).all() and not anchors.covered(0, start[:0], mask[:0], 35).size
