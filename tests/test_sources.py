import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from lexiquarry import models, schemas
from lexiquarry.sources import committed, files, rest
from lexiquarry.streaming import arrivals


def test_resume_reads_past_a_cut_line(spark, tmp_path):
    at = tmp_path / "d.jsonl"
    at.write_text('{"document_number": "a"}\n\n{"document_number": "b"}\n{"document_nu')
    assert sorted(r[0] for r in files.present_ids(spark, f"file://{at}").collect()) == ["a", "b"]
    assert files.present_ids(spark, f"file://{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_jsonl(spark, f"file://{tmp_path}/none")


def test_records(spark, tmp_path):
    at = tmp_path / "m.txt"
    at.write_text("# note\nDOC: d1\nQ: why so?\nA: because\n\nDOC: d2\nQ: what\nA: none\n")
    assert [tuple(r)[1:] for r in files.read_records(spark, f"file://{at}").collect()] == [("d1", "why so?", "because"), ("d2", "what", None)]


def test_verdicts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "correct", "1", "q", "e", "g")], "answer_key string, verdict string, id string, question string, expected string, generated string")
    files.write_verdicts(rows, f"file://{tmp_path}/v")
    assert files.read_verdicts(spark, f"file://{tmp_path}/v").collect() == rows.collect()
    assert files.read_verdicts(spark, f"file://{tmp_path}/none").count() == 0


def test_vector_cache(spark, tmp_path):
    made = []

    def make(c):
        made.append(1)
        return c.select("chunk_id")

    chunks = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    for c, model, again in ((chunks, "m", False), (chunks, "m", False), (chunks, "n", False), (chunks.limit(0), "n", False), (chunks.limit(0), "n", True)):
        files.cached_vectors(c, f"file://{tmp_path}/c", model, make, again)
    assert len(made) == 4


def test_listing_follows_pages():
    pages = {1: {"results": [{"document_number": "a"}], "next_page_url": "http://x/2"}, 2: {"results": [{"document_number": "b"}]}}
    seen = []

    def transport(url):
        seen.append(url)
        return 200, json.dumps(pages[2 if url.endswith("/2") else 1]).encode()

    assert [r[0] for r in rest.list_day("http://x/1", "2026-08-03", ["RULE"], transport)] == ["a", "b"]
    assert "2026-08-03" in seen[0] and "RULE" in seen[0]
    days = rest.ListingReader({"url": "", "start": "2026-08-01", "end": "2026-08-04"}).partitions()
    assert [d.value for d in days] == ["2026-08-03", "2026-08-04"]


def test_get_retries():
    answers = iter([(503, b""), (429, b""), (200, b"ok")])
    assert rest.get("u", lambda u: next(answers), sleep=lambda s: None) == b"ok"
    assert rest.get("u", lambda u: (404, b"")) is None
    with pytest.raises(RuntimeError):
        rest.get("u", lambda u: (500, b""), sleep=lambda s: None)


def test_backends():
    assert models.backend("groq", {}) == "groq" and models.backend(None, {}) is None and models.backend(None, {"OPENAI_API_KEY": "x", "OLLAMA_HOST": "y"}) == "openai"
    assert models.reasoning_options("groq", "openai/gpt-oss-120b", 500, False) == {"reasoning_effort": "low", "max_completion_tokens": 2048, "max_tokens": None}
    assert models.reasoning_options("nvidia", "m", 500, True)["chat_template_kwargs"]["thinking"] is True
    bodies = []

    def transport(url, headers, body, timeout):
        bodies.append(body)
        return (500, {}, {}) if len(bodies) == 1 else (200, {}, {"choices": [{"message": {"content": " yes "}}]})

    client = models.Client("groq", env={"GROQ_API_KEY": "k"}, transport=transport, sleep=lambda s: None)
    assert client("p") == "yes" and "max_tokens" not in bodies[0] and bodies[0]["temperature"] == 0
    with pytest.raises(ValueError):
        models.Client("nobody")


def test_pace():
    now, slept = [0.0], []
    pace = models.Pace(60, lambda: now[0], slept.append)
    pace.wait()
    pace.wait()
    assert slept == [1.0]


def test_all_tasks_share_one_pace(spark):
    slots = models.Slots(60, lambda: 100.0)
    assert [slots.reserve() for _ in range(4)] == [0.0, 1.0, 2.0, 3.0] and models.Slots(0, lambda: 0.0).reserve() == 0.0
    with models.PaceServer(spark, 60, clock=lambda: 0.0) as pace:  # a clock that stands still: the waits are the calls' times
        host, port, secret = pace.host, pace.port, pace.secret

        def run(rows):
            waits = []
            mine = models.SharedPace(host, port, secret, sleep=waits.append)
            for pdf in rows:
                for _ in range(len(pdf)):
                    mine.wait()
                yield pdf.assign(w=waits[-len(pdf) :])

        got = sorted(r.w for r in spark.range(0, 64, 1, 8).mapInPandas(run, "id long, w double").collect())
        with pytest.raises(OSError):
            models.SharedPace(host, port, "guess").wait()
    assert got == [float(i) for i in range(64)]  # 64 calls of 8 tasks take 64 slots of a second


def test_generation_keeps_errors(spark):
    def make():
        def call(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return call

    rows = models.generate(spark.createDataFrame([("1", "a"), ("2", "bad")], "query_id string, prompt string"), make).orderBy("query_id").collect()
    assert [tuple(r) for r in rows] == [("1", "A", None), ("2", None, "ValueError: no")]


def doc(number, day=None, text="w " * 200, **more):
    return json.dumps({"document_number": number, "text": text, "publication_date": day, **more})


def test_arrivals_keep_undated_and_late_documents_once(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    (tmp_path / "in").mkdir()

    def run():
        arrivals.ingest(spark, at("in"), at("out"), at("cp")).awaitTermination(120)
        return sorted(r.document_number or "-" for r in arrivals.present(spark, at("out")).collect())

    (tmp_path / "in/a.json").write_text("\n".join([doc("D-1", "2026-09-01"), doc("D-1", "2026-09-01"), doc("D-2"), doc("C1-2026"), doc("short", text="x"), doc(None)]))
    assert run() == ["-", "D-1", "D-2"]
    (tmp_path / "in/b.json").write_text("\n".join([doc("D-3", "2026-09-02", docket_ids=["x"]), doc("D-4"), doc("D-5", "2026-07-01"), doc("D-2", "2026-09-03")]))
    assert run() == ["-", "D-1", "D-2", "D-3", "D-4", "D-5"] and run() == ["-", "D-1", "D-2", "D-3", "D-4", "D-5"]
    # a batch that is run again, as after a failure between its commit and the checkpoint's, adds nothing
    for name in ("1", ".1.crc"):
        (tmp_path / "cp/commits" / name).unlink()
    assert run() == ["-", "D-1", "D-2", "D-3", "D-4", "D-5"]


def test_commits_are_whole_and_once(spark, tmp_path):
    path, kind = f"file://{tmp_path}/set", "k string, a array<int>, d date"
    rows = spark.createDataFrame([(f"k{i}", [i] if i % 2 else None, None) for i in range(40)], kind).repartition(4)
    assert committed.read(spark, path, kind).count() == 0
    bad = rows.withColumn("k", F.udf(lambda k: k if k != "k39" else 1 / 0)("k"))
    with pytest.raises(Exception, match="division"):
        committed.write(bad, path, "one")
    assert committed.read(spark, path, kind).count() == 0 and not list((tmp_path / "set").glob("commits/*"))
    for commit in ("one", "one", "two"):
        committed.write(rows, path, commit)
    assert committed.read(spark, path, kind).count() == 80 and committed.read(spark, path, kind).distinct().exceptAll(rows).count() == 0
    (tmp_path / "set/parts/one/left-by-a-lost-task.json").write_text('{"k": "never", "a": nul')
    committed.write(rows.limit(3), path, append=False)
    committed.write(rows.limit(0), path)
    assert committed.read(spark, path, kind).count() == 3
    with pytest.raises(Exception, match="name"):
        committed.write(rows, path, "a/b")


def test_verdicts_of_many_files(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(f"k{i:02d}", "correct", str(i), "q \"é\"", None, "g") for i in range(25)], schemas.VERDICT)
    files.write_verdicts(rows.limit(3), path)
    files.write_verdicts(rows, path, each=5)
    assert files.read_verdicts(spark, path).exceptAll(rows).count() == 0 and files.read_verdicts(spark, path).count() == 25
    found = [json.loads(open(p[7:] if p.startswith("file://") else p[5:]).read()) for p in committed.parts(spark, path)]
    assert len(found) > 2 and {k for m in found for k in m} == {f"k{i:02d}" for i in range(25)}  # each file is an object keyed by answer
    (tmp_path / "old.json").write_text(json.dumps({"k": {"verdict": "wrong", "id": "1", "question": "q", "expected": "e", "generated": "g"}}))
    assert files.read_verdicts(spark, f"file://{tmp_path}/old.json").first().verdict == "wrong"


@pytest.fixture()
def source():
    """A listing that answers by day and type, with the requests it saw."""

    class Source(http.server.BaseHTTPRequestHandler):
        days: dict = {}
        seen: list = []

        def do_GET(self):
            asked = urllib.parse.urlparse(self.path)
            Source.seen.append(self.path)
            if asked.path == "/docs.json":
                q = urllib.parse.parse_qs(asked.query)
                day, types = q["conditions[publication_date][is]"][0], q.get("conditions[type][]")
                rows = [{"document_number": n, "title": n, "type": t, "publication_date": day} for n, t in Source.days.get(day, []) if not types or t in types]
                body = json.dumps({"results": rows}).encode()
            elif asked.path.endswith(".json"):
                n = urllib.parse.unquote(asked.path.split("/")[-1][:-5])
                body = json.dumps({"document_number": n, "title": f"About {n}", "raw_text_url": f"http://127.0.0.1:{port}/raw/{urllib.parse.quote(n)}"}).encode()
            else:
                body = b"<html><pre>" + b"word &amp; " * 100 + b"</pre></html>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Source)
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Source, f"http://127.0.0.1:{port}/docs.json"
    server.shutdown()


def test_listing_stream_goes_on_where_it_stopped(spark, tmp_path, source):
    src, url = source
    src.days, src.seen = {"2026-08-03": [("a", "RULE"), ("b", "NOTICE")], "2026-08-04": [("c", "RULE")]}, []

    def run(today):
        arrivals.ingest_listing(spark, url, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "2026-08-03", today, back=2).awaitTermination(120)
        return sorted(r.document_number for r in arrivals.present(spark, f"file://{tmp_path}/out").collect())

    assert run("2026-08-04") == ["a", "b", "c"]
    src.days |= {"2026-08-04": [("c", "RULE"), ("late", "RULE")], "2026-08-05": [("d", "RULE")], "2026-08-03": [("a", "RULE"), ("b", "NOTICE"), ("too late", "RULE")]}
    src.seen = []
    assert run("2026-08-06") == ["a", "b", "c", "d", "late", "too late"]
    assert {urllib.parse.parse_qs(p.split("?")[1])["conditions[publication_date][is]"][0] for p in src.seen if "?" in p} == {"2026-08-03", "2026-08-04", "2026-08-05", "2026-08-06"}
    assert not any(f"/{n}.json" in p for p in src.seen for n in "abc")  # those held already are not fetched again
    src.days["2026-08-03"] = [("behind the window", "RULE")]
    assert run("2026-08-10") == ["a", "b", "c", "d", "late", "too late"]
    rows = arrivals.present(spark, f"file://{tmp_path}/out").where("document_number = 'a'").first()
    assert rows.title == "About a" and rows.word_count == 200 and rows.text.startswith("word & word")


def test_filters_become_requests(spark, source):
    src, url = source
    src.days, src.seen = {f"2026-08-{d:02d}": [(f"r{d}", "RULE"), (f"n{d}", "NOTICE")] for d in range(1, 32)}, []
    listing = rest.listing(spark, url, "2026-08-03", "2026-08-31")

    def asked(df):
        src.seen.clear()
        got = sorted(r.document_number for r in df.collect())
        q = [urllib.parse.parse_qs(p.split("?")[1]) for p in src.seen]
        return got, sorted(x["conditions[publication_date][is]"][0][-2:] for x in q), {tuple(x.get("conditions[type][]", [])) for x in q}

    assert asked(listing.where("publication_date >= '2026-08-27' and type = 'RULE'")) == (["r27", "r28", "r31"], ["27", "28", "31"], {("RULE",)})
    assert asked(listing.where(F.col("publication_date").isin("2026-08-05", "2026-08-07", "2026-08-08") & F.col("type").isin("NOTICE", "OTHER"))) == (["n5", "n7"], ["05", "07"], {("NOTICE", "OTHER")})
    assert asked(listing.where("publication_date > '2026-08-27' and publication_date < '2026-08-31'"))[:2] == (["n28", "r28"], ["28"])
    assert asked(listing.where("type = 'RULE' and type = 'NOTICE'"))[:2] == ([], []) and asked(listing.where("publication_date > '2026-08-2'"))[1][0] == "03"
