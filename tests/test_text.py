import random

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import text as T


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,want",
    [("USCG-2026-0123 and A53/A53M", ["uscg-2026-0123", "and", "a53/a53m"]), ("", []), (None, []), ("-a- b", ["a", "b"])],
)
def test_tokens_hold_compounds_together(spark, text, want):
    assert one(spark, text, T.tokens) == want


def test_masthead_is_removed_once_and_for_all(spark):
    text = "[Federal Register Volume 91, Number 1]\n[Notices]\n[Pages 1-2]\nFrom the Federal Register Online via x\n[FR Doc No: 2026-1]\n======\n-----\nBody [[Page 7]]here\n\n\n\nEnd\n"
    first = one(spark, text, T.without_masthead)
    assert first.startswith("Body here") and "\n\n\n" not in first and first.endswith("End")
    assert one(spark, first, T.without_masthead) == first


def test_page_text_decodes_in_order(spark):
    assert one(spark, "<html><PRE>a &amp;lt; b  \n<b>c</b>&nbsp;&#39;</pre> z", T.page_text) == "a < b\nc '"
    assert one(spark, "<p>no pre</p>", T.page_text) == "no pre"


@pytest.mark.parametrize("value,want", [("2026-09-05", "September 5, 2026"), ("2026-13-01", None), ("", None), (None, None), ("soon", None)])
def test_spelled_date(spark, value, want):
    assert one(spark, value, T.spelled_date) == want


@pytest.mark.parametrize(
    "found,expected,want",
    [
        ("The docket number is USCG-2026-1030.", "Docket Number USCG-2026-1030", True),
        ("It is USCG‑2026‑1030", "USCG-2026-1030", True),
        ("USCG-2026-1031", "Docket Number USCG-2026-1030", False),
        ("by October 23, 2026 at noon", "October 23, 2026", True),
        ("nothing", "", False),
        (None, "x", False),
        ("rule 3173", "rule 317", True),
        ("a telling word", "word telling", False),
    ],
)
def test_holds_answer(spark, found, expected, want):
    df = spark.createDataFrame([(found, expected)], "a string, b string")
    assert df.select(T.holds_answer(T.plain_scored("a"), T.plain_scored("b")).alias("y")).first().y is want


def test_decomposition(spark):
    assert one(spark, "résumé", T.plain_scored) == "re sume"


def test_refusals(spark):
    assert one(spark, "Not found in the available documents.", lambda c: T.is_refusal(T.plain(c)))
    assert one(spark, "I could not find it", lambda c: T.is_refusal(T.plain(c)))
    assert not one(spark, "It is 5", lambda c: T.is_refusal(T.plain(c)))


def test_ablation(spark):
    df = spark.createDataFrame([("What is the fee for Olcott, NY for?", ["olcott"]), ("Is it certain?", [])], "q string, t array<string>")
    assert [r.y for r in df.select(T.ablate("q", "t").alias("y")).collect()] == ["What is the fee for, NY ?", "Is it certa?"]
    assert df.select(T.ablate("q", "t", strict=True).alias("y")).collect()[1].y == "Is it certain?"


def test_degenerate(spark):
    assert one(spark, "On what date does the rule take effect?", T.is_degenerate)
    assert not one(spark, "lake ontario fireworks display", T.is_degenerate)


def test_sketch_and_similarity(spark):
    import zlib

    text = "a b c d e f g"
    want = sorted({zlib.crc32(" ".join(text.split()[i : i + 5]).encode()) for i in range(3)})
    assert one(spark, text, T.sketch) == want
    assert one(spark, "x y", T.sketch) == [zlib.crc32(b"x y")]
    assert one(spark, "", T.sketch) == [0]
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([1], [])], "a array<bigint>, b array<bigint>")
    assert [r.y for r in df.select(T.sketch_similarity("a", "b").alias("y")).collect()] == [0.5, 0.0]


def test_answer_key(spark):
    import hashlib

    df = spark.createDataFrame([("q1", "why", None)], "id string, question string, generated string")
    got = df.select(T.answer_key("id", "question", "generated").alias("a"), T.answer_key("id", "question", "generated", F.lit(False)).alias("b")).first()
    assert got.a == hashlib.sha256(b"q1|why|None").hexdigest()[:16] and got.b == hashlib.sha256(b"q1|why|").hexdigest()[:16]


def test_only_texts_beyond_ascii_are_decomposed_in_python(spark):
    rows = spark.createDataFrame([("plain text",), ("ﬁve résumés",), (None,), ("",)], "x string").select("x", T.plain_scored("x").alias("y"))
    assert [r.y for r in rows.collect()] == ["plain text", "five re sume s", "", ""]
    calls = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "run(" in line and "EvalPython" in line]
    assert calls and all("RLIKE" in line for line in calls)


def test_sketches_in_batches_are_those_of_single_hashes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß\u4e2d") for _ in range(rng.choice((1, 4, 9, 25))))
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["", " ", None, "A\u00a0b\tC", "one two three four five"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").repartition(2)
    for hashing in (T.md5_hash, F.crc32):
        for k, most in ((256, None), (7, 30), (5, 3)):
            both = rows.select(T.sketch("x", k, 5, most, hashing).alias("a"), T._sketch_columns("x", k, 5, most, hashing).alias("b"))
            assert both.where("not (a <=> b)").count() == 0
