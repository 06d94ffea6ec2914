"""Byte-level coding, conversation repair and centroid clustering against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import bytebpe, convrepair, kdmeans

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---------------------------------------------------------------- byte-level coding


@pytest.fixture(scope="module")
def plain_codec():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def fast():
    text = bytebpe.model(bytebpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    return bytebpe._loaded(text), bytebpe.ByteTable(text)


def odd_texts(n, seed=7):
    rng = random.Random(seed)
    marks = ["a", "the", " ", "  ", "\n", "\t", "é", "中", "👩‍👩‍👧", "'s", "'LL", "12", "½", "!", "…", " ", "\u0085", "　", "\x1c", "\x00", "<|endoftext|>", "ing", "tion", "ا", "́", "aba", "ababa"]
    pick = lambda: rng.choice(marks) if rng.random() < 0.85 else chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(pick() for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("kept", [bytebpe.KEPT, 10])
def test_ids_are_those_of_the_other_library(plain_codec, fast, kept, monkeypatch):
    monkeypatch.setattr(bytebpe, "KEPT", kept)
    tok, table = fast
    texts = odd_texts(3000) + ["", " ", "\n\n a", "word " * 50_000, "x" * 3000]
    encode = bytebpe.Pieces(tok, table.lens)
    for text, ids in zip(texts, [x for at in range(0, len(texts), 700) for x in encode(texts[at : at + 700])]):
        assert ids.tolist() == plain_codec.encode_ordinary(text), text
        assert table.decode(ids) == text.encode()
    assert bytebpe.Pieces(tok, table.lens)([]) == []


def test_character_classes_agree(fast):
    """Every code point is a letter, a number, white space or another sign to both libraries alike."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for p in b"a1!":
        ranks |= {bytes([p, b]): len(ranks) + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: i for i, k in enumerate(ranks)}, special_tokens={})
    split = fast[0].pre_tokenizer
    for c in [*range(0x3100), *range(0x3100, 0xD800, 7), *range(0xE000, 0x110000, 13)]:
        for p in "a1!":
            s = p + chr(c)
            assert (len(probe.encode_ordinary(s)) == len(s.encode()) - 1) == (len(split.pre_tokenize_str(s)) == 1), hex(c)


def test_offsets_span_split_characters(fast):
    tok, table = fast
    for text in odd_texts(300, 3) + ["𓀀a", "naïve 中文 🤖"]:
        ids = bytebpe.Pieces(tok, table.lens)([text])[0]
        ends, first, last = bytebpe.offsets(table.lens[ids], text.encode())
        data, at = text.encode(), 0
        for e, a, b in zip(ends.tolist(), first.tolist(), last.tolist()):
            whole = text[a:b].encode()
            assert data[at:e] in whole and len(text[:a].encode()) <= at < e <= len(text[:b].encode())
            assert len(text[: a + 1].encode()) > at and len(text[: b - 1].encode()) < e  # no wider than needed
            at = e
        assert at == len(data)


def test_round_trip_of_a_table(spark, plain_codec):
    texts = [None, "", "a 🤖 b", "a 🤖 b", *odd_texts(60, 11), "lang " * 100_000]
    rows = [(i if i != 3 else 2, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    got = sorted(((r.doc_id or -1, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bytebpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()))
    want = sorted((i or -1, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows for ids in [plain_codec.encode_ordinary(t or "")])
    assert got == want
    codec = bytebpe.Codec(spark, RANKS, public_tokenizers.PATTERN)
    one = docs.where("doc_id = 2").limit(1).select(codec.ids(F.col("text")).alias("i"), F.lit(None).cast("binary").alias("none"))
    half = F.substring("i", 1, 8)  # up to within the emoji
    r = one.select(codec.text_of(F.col("i")).alias("t"), codec.spans(F.col("i")).alias("s"), codec.text_of(half).alias("h"), codec.bytes_of(F.col("none")).alias("b"), codec.spans(F.col("none")).alias("n"), codec.bytes_of(F.lit(b"\xff\xff\xff\x7f")).alias("u")).first()
    assert r.t == "a 🤖 b" and r.s[0].char_end == 1 and r.s[1].char_end == 3 and r.s[2].char_start == 2 and r.s[-1].byte_end == 8
    assert r.h.startswith("a ") and r.h.endswith("�") and r.b is None and r.n is None and bytes(r.u) == b""
    assert bytebpe.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError):
        bytebpe.model({b"a": 0}, public_tokenizers.PATTERN)


# ---------------------------------------------------------------- conversation repair


def best_repair(rows):
    """Cheapest and then ASCII-least edits by trying all, with the repaired rows; rows of (role, text, fault)."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.lru_cache(None)
    def least(i, state, room):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if room:
            c, a, t = least(i, step[state], room - 1)
            ways.append((c + 3, "I" + a, ((name[step[state]], ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = least(i + 1, state, 3)
            ways.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ({"": "su", "s": "u", "u": "a", "a": "u"}[state]) and role:
                    c, a, t = least(i + 1, role[0], 3)
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = least(i + 1, step[state], 3)
                ways.append((c + 3 + more, "R" + a, ((name[step[state]], text), *t)))
        return min(ways, default=(10**9, "", ()))

    return least(0, "", 3)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_audits(rows):
    """rows of (conv, turn, role, text, gone)"""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, gone in rows if c == conv and not gone))
        said = [(r, x) for *_, r, x in own]
        f = faults(said)
        cost, audit, fixed = best_repair(tuple((r, x, y) for (r, x), y in zip(said, f)))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest(), fixed)
    return out


def chats(seed=2, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher", "User"])
            text = rng.choice(["Yes.", "No.", "What?", "cut off", " \t", "", None, "Well.  \n", f"Line {rng.randrange(5)}.", "x" * 5 + "!"])
            rows.append((c if c else None, rng.choice([t, t, t, None, rng.randrange(12)]), role, text))
    return rows


def test_repairs_are_cheapest_and_least(spark):
    rows = chats() + [(7, 3, "user", "w " * 200_000), (-5, -(1 << 63), "user", "Hi."), (-5, (1 << 63) - 1, "assistant", "Yes.")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"code": F.lit(1), "place": F.lit("p"), "fault": F.lit("f"), "conv": F.lit(2)})
    want = plain_audits([(*r, False) for r in rows])
    want[-5] = ((1 << 63) - 1, *want[-5][1:])
    got = {r.conv_id: tuple(r)[1:] for r in convrepair.audit(data).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    fixed = {}
    for r in sorted(convrepair.repair(data).collect(), key=lambda r: r.place):
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    assert fixed == {k: list(v[-1]) for k, v in want.items() if v[-1]}
    assert convrepair.audit(data.limit(0)).count() == 0


def test_damage_and_dropped_conversations(spark):
    rows = [r for r in chats(5, 400) if r[0] is None or r[0] >= 0]
    rows += [(c, 0, "user", "Only. One! row?") for c in range(1000, 1060)]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hurt = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    want = plain_audits(hurt)
    got = {r.conv_id: tuple(r)[1:] for r in convrepair.audit(convrepair.damaged(data)).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()  # one whose only row was dropped


def test_layers_stay_few_in_a_long_conversation():
    rng = random.Random(1)
    rows = [("c", False, rng.choice(["user", "assistant", "system", "tool"]), rng.randrange(4)) for _ in range(50_000)]
    convrepair.back.cache_clear()
    codes = list(convrepair.decide(iter(rows)))
    assert convrepair.back.cache_info().currsize < 500 and codes[-1][1] > 50_000


# ---------------------------------------------------------------- centroids


def plain_centroids(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            some = [v for (_, v), o in zip(kept, own) if o == j]
            if some:
                cents[j] = [sum(x) // len(some) for x in zip(*some)]
    last = [near(v) for _, v in kept]
    part = [sum(d for d, j in last if j == c) for c in range(len(cents))]
    return sorted((-1 if i is None else i, j, d, part[j], sum(part), ",".join(map(str, cents[j]))) for (i, _), (d, j) in zip(kept, last))


def vectors(seed, n=400, width=4, spread=3.0):
    rng = random.Random(seed)
    mids = [[rng.uniform(-spread, spread) for _ in range(width)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in rng.choice(mids)]) for i in range(n)]
    rows += [(i, [1.0] * width) for i in range(n, n + 80)]  # one vector many times: ties and leaves that can't be cut
    rows += [(1, rows[5][1]), (1, rows[6][1]), (None, [0.5] * width), (n + 90, None), (n + 91, [1.0]), (n + 92, [None] * width), (n + 93, [float("nan")] * width), (n + 94, [float("inf")] * width), (n + 95, [])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_centroids(spark, seed, monkeypatch):
    monkeypatch.setattr(kdmeans, "MEMBERS", 128)
    rows = vectors(seed)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({"id": F.lit("x"), "v": F.lit(1), "cluster": F.lit(9), "distance": F.lit(0)})
    got = sorted((-1 if r.vec_id is None else r.vec_id, *tuple(r)[1:]) for r in kdmeans.clustered(data, k=7, width=4, scale=8.0).collect())
    assert got == plain_centroids(rows, 7, 3, 4, 8.0)


def test_few_none_and_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(3, [1.0, 2.0])], [(i, [1e30 * i, -1e25]) for i in range(9)] + [(20, [1e306, 1.0]), (21, [0.5, -0.5])]):
        got = sorted(tuple(r) for r in kdmeans.clustered(spark.createDataFrame(rows, kind), k=4, rounds=2, width=2, scale=64.0).collect())
        want = plain_centroids([(i, v) for i, v in rows if max(map(abs, v)) < 1e300], 4, 2, 2, 64.0)
        if not any(max(map(abs, v)) > 1e300 for _, v in rows):
            assert got == want
        else:
            assert len(got) == len(rows) and {r[0] for r in got} == {i for i, _ in rows}


def test_pruning_is_strict_and_settles_whole_nodes():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-4, 5, (300, 3)) + m for m in ([0, 0, 0], [60, 0, 0], [0, 60, 0])])
    tree = kdmeans.build(points, 16)
    cents = np.array([[0, 0, 0], [60, 0, 0], [0, 60, 0], [60, 0, 0]])  # the last one ties with the second everywhere
    label, far = kdmeans.labels_of(tree, points, cents)
    want = ((points[:, None] - cents[None]) ** 2).sum(2)
    assert (label == want.argmin(1)).all() and (far == want.min(1)).all()
    nodes, _, places, _ = kdmeans.owners_of(tree, points, cents[:3])
    assert len(places) < len(points) / 4 and (tree.ends[nodes] - tree.starts[nodes]).max() > 100
    nodes, _, places, _ = kdmeans.owners_of(tree, points, cents)
    assert len(places) >= 300  # equal centroids are never dropped, so theirs are settled one by one
    total = {c: (n, s.tolist()) for c, n, s in kdmeans.sums_of(tree, points, cents)}
    assert total == {c: (int((label == c).sum()), points[label == c].sum(0).tolist()) for c in range(3)}
