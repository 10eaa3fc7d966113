import io
import json
import urllib.error

import pytest

from sparkloom import schema as t
from sparkloom.operators import batches, explorer, validation
from sparkloom.sources import files, http


def test_majorities(spark):
    votes = [("a", "1", "valid", "r1"), ("a", "2", "invalid", "r2"), ("b", "1", "invalid", "no"), ("b", "2", "valid", "yes"), ("b", "3", "valid", "yes2"), ("c", "1", "unsure", "?"), ("d", "1", "valid", "d")]
    b = spark.createDataFrame([(f, r, v, x, "") for f, r, v, x in votes], t.BALLOTS)
    got = {r.finding_id: (r.verdict, r.unanimous, r.reason) for r in validation.majorities(b).collect()}
    assert got == {"a": ("invalid", False, "r2"), "b": ("valid", False, "yes"), "c": ("unchecked", False, None), "d": ("valid", True, "d")}
    s = validation.summary(validation.majorities(b)).collect()[0]
    assert (s.n, s.valid, s.invalid, s.max_readers, s.stop) == (3, 2, 1, 3, True)
    found = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {r.id: r.validated for r in validation.merged(found, validation.majorities(b)).collect()} == {"a": False, "c": None}


def test_sample(spark):
    f = spark.createDataFrame([(f"F1-{i:04d}",) for i in range(80)], "id string")
    one = [r.id for r in validation.sample(f, most=10).orderBy("id").collect()]
    assert len(one) == 10 and one == [r.id for r in validation.sample(f.repartition(3), most=10).orderBy("id").collect()] and validation.sample(f, most=80).count() == 80


def test_explorer(spark):
    f = spark.createDataFrame([("F1-0001", "near_miss", 2, "concept:b", "Lazy b", True), ("F1-0002", "near_miss", 2, "concept:a", "Eager a", None), ("F2-0001", "orphan_concept", 5, "concept:c", "C", False)], "id string, type string, demand bigint, concept string, label string, validated boolean")
    s = explorer.searchable(explorer.status(f), "label", "concept")
    ids = lambda **k: [r.id for r in explorer.selected(s, **k).collect()]
    assert ids() == ["F2-0001", "F1-0001", "F1-0002"] and ids(kind="near_miss") == ["F1-0001", "F1-0002"] and ids(state="unchecked") == ["F1-0002"] and ids(text=" LAZY ") == ["F1-0001"]
    assert ids(order="concept") == ["F1-0002", "F1-0001", "F2-0001"] and ids(page=1, size=2) == ["F1-0002"]
    assert explorer.lookup(s, spark.createDataFrame([("#F2-0001",), ("#x",)], "hash string")).count() == 1


def test_packing(spark):
    rows = [("sec:%02d" % i, "doc:d", "t", "h", 1, "p", (i, i), "u", "x" * n, None, n) for i, n in enumerate([100] * 13 + [17_000, 900, 20_000, 10])]
    got = {r.id: r.part for r in batches.packed(spark.createDataFrame(rows, t.SECTIONS)).collect()}
    assert [got[f"sec:{i:02d}"] for i in range(17)] == [1] * 12 + [2] * 2 + [2] + [3] + [4]
    p = batches.prompts(spark.createDataFrame([("doc:d", 1, "sec:00")], "doc_id string, part int, id string"), spark.createDataFrame(rows[:1], t.SECTIONS), "Read:", 5).collect()
    assert p[0].prompt == "Read:\n\n## h\nxxxxx"


def test_progress_and_completion(spark):
    b = spark.createDataFrame([("b1", "p1"), ("b2", "p2")], "batch_id string, prompt string")
    done = spark.createDataFrame([("b1",)], "batch_id string")
    assert tuple(batches.progress(b, done).collect()[0]) == (2, 1, 1)
    assert [tuple(r) for r in batches.completed(batches.missing(b, done), lambda p: p.upper()).collect()] == [("b2", "P2")]


def test_files(spark, tmp_path):
    (tmp_path / "docs/tutorial").mkdir(parents=True)
    (tmp_path / "docs/tutorial/a.md").write_bytes(b"# A\r\nx")
    (tmp_path / "docs/b.md").write_text("y")
    pages = files.read_pages(spark, str(tmp_path / "docs"))
    assert {(r.path, r.text, r.bytes, r.lines) for r in pages.collect()} == {("tutorial/a.md", "# A\nx", 6, 2), ("b.md", "y", 1, 1)}
    nav = files.nav_order(spark.createDataFrame([("site: x\nnav:\n  - b.md\n  - T: tutorial/a.md\n  - b.md\nplugins:\n  - z.md",)], "text string"))
    assert {(r.path, r.rank) for r in nav.collect()} == {("b.md", 1), ("tutorial/a.md", 2)}
    assert [r.path for r in files.select_pages(pages, nav, 1).collect()] == ["tutorial/a.md"]
    (tmp_path / "out").mkdir()
    (tmp_path / "out/batch-000.json").write_text('{"a": 1}')
    (tmp_path / "out/batch-001.json").write_text("{broken")
    (tmp_path / "out/batch-002.json").write_text('Here it is:\n```json\n{"b": 2}\n```\nDone.')
    assert sorted(tuple(r) for r in files.read_replies(spark, f"{tmp_path}/out/batch-*.json").collect()) == [("batch-000", '{"a": 1}'), ("batch-002", '{"b": 2}\n')]
    keyed = spark.createDataFrame([("k", "batch-000", 1), ("k", "batch-002", 3), ("j", "batch-001", 2)], "key string, batch_id string, v int")
    assert {r.key: r.v for r in files.last_wins(keyed, "key").collect()} == {"k": 3, "j": 2}


def test_threads(spark, tmp_path):
    row = {"number": 1, "title": "T", "body": "q" * 80, "url": "u", "answered": True, "answer": {"body": "a" * 120, "author": "x", "author_association": "OWNER"}}
    (tmp_path / "1.json").write_text(json.dumps(row, indent=1))
    (tmp_path / "2.json").write_text(json.dumps(row | {"number": 2, "body": " q "}))
    (tmp_path / "3.json").write_text(json.dumps({"number": 3, "title": None, "body": None, "answer": None}))
    threads = files.read_threads(spark, str(tmp_path))
    assert threads.count() == 3 and [r.number for r in files.substantial(threads).collect()] == [1]
    raw = {r.number: r.raw for r in files.rendered(threads).collect()}
    assert "## Accepted answer by x" in raw[1] and raw[3].startswith("# \n")


def test_vectors_follow_their_text(spark):
    texts = spark.createDataFrame([("a", "old"), ("b", "new")], "id string, text string")
    had = texts.selectExpr("id", "sha2(IF(id = 'b', 'before', text), 256) AS digest")
    assert [r.id for r in files.stale_vectors(texts, had).collect()] == ["b"]


def test_http():
    tries = []

    def opener(request):
        tries.append(request.full_url)
        if len(tries) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        return io.BytesIO(b"ok")

    assert http.fetch("http://x.test", pause=0, opener=opener) == b"ok" and len(tries) == 3
    replies = {None: {"rows": [{"n": 1}, {"n": 2}], "next": "c"}, "c": {"rows": [{"n": 3}]}}
    assert [r["n"] for r in http.pages(replies.get, 9)] == [1, 2, 3] and len(list(http.pages(replies.get, 2))) == 2
    with pytest.raises(RuntimeError):
        list(http.pages(lambda c: {"errors": ["no"]}, 1))


def test_stream(spark, tmp_path):
    from graphs import section

    from sparkloom.streaming import ingest

    s = spark.createDataFrame([section("s", "head\nYou need a session before you query.")], t.SECTIONS)
    (tmp_path / "in").mkdir()
    row = {"batch_id": "b0", "section_id": "sec:d1#s", "pos": 0, "type": "REQUIRES", "concept": "session", "span": "need a session before", "confidence": "low"}
    for n in range(2):
        (tmp_path / f"in/{n}.json").write_text(json.dumps(row | {"batch_id": f"b{n}"}))
    ingest.start(ingest.read_proposals(spark, str(tmp_path / "in"), 1), s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.type, r.dst) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("REQUIRES", "concept:session")]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_commits_trees_and_tokens(monkeypatch):
    assert http.head_commit(lambda: {"sha": "ab" * 20}) == "ab" * 20
    with pytest.raises(RuntimeError):
        http.head_commit(lambda: {"message": "limit"})
    tree = {"tree": [{"type": "blob", "path": p} for p in ("docs/b.md", "docs/a/c.md", "docs/x.png", "other/y.md")] + [{"type": "tree", "path": "docs/a.md"}]}
    assert http.listed_pages(tree, "docs") == ["a/c.md", "b.md"]
    with pytest.raises(RuntimeError):
        http.listed_pages(tree | {"truncated": True}, "docs")
    for name in ("SPARKLOOM_TOKEN", "API_TOKEN"):
        monkeypatch.delenv(name, raising=False)
    assert http.token() is None and http.token(("echo", "t1")) == "t1" and http.token(("no-such-command-here",)) is None
    many = {None: {"rows": [{"n": i} for i in range(400)]}}
    assert len(list(http.pages(many.get))) == 400


def test_the_thread_source(spark, tmp_path):
    """The data source end to end, over a server on this machine."""
    import http.server
    import threading

    class Page(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["cursor"]
            rows = [{"number": n, "title": f"t{n}", "answered": n % 2 == 0, "answer": {"body": "b", "is_maintainer": True} if n % 2 == 0 else None} for n in ((1, 2) if asked is None else (3,))]
            body = json.dumps({"rows": rows, "next": "c" if asked is None else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    from sparkloom.sources.http import ThreadSource

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(ThreadSource)
        rows = spark.read.format("threads").option("url", f"http://127.0.0.1:{server.server_port}/").load().orderBy("number").collect()
    finally:
        server.shutdown()
    assert [(r.number, r.title, r.answer and r.answer.body) for r in rows] == [(1, "t1", None), (2, "t2", "b"), (3, "t3", None)]


def test_fetch_report(spark):
    pages = spark.createDataFrame([("b.md", 3, 1), ("a.md", 4, 2)], "path string, bytes int, lines int")
    threads = spark.createDataFrame([(1, "x"), (12, "y"), (3, None)], "number bigint, title string")
    said = json.loads(files.fetch_report(pages, threads, "0" * 40, "docs").collect()[0].json)
    assert (said["pages"], said["bytes"], [p["path"] for p in said["listed"]], [n["number"] for n in said["numbers"]]) == (2, 7, ["a.md", "b.md"], [12, 3, 1])
    with pytest.raises(ValueError):
        files.fetch_report(pages, threads, "main", "docs")


def test_prompts_from_templates(spark):
    rows = spark.createDataFrame([("b1", 2, "q2", "long text"), ("b1", 1, "q1", None), ("b2", 3, "q3", "z")], "batch string, place int, id string, body string")
    got = {r.batch: r.prompt for r in batches.from_template(rows, "batch", "place", "ID {id}\n{body}", {"body": 4}, "Answer:\n").collect()}
    assert got == {"b1": "Answer:\nID q1\n\n\nID q2\nlong", "b2": "Answer:\nID q3\nz"}


def test_commands(spark, tmp_path, capsys):
    from sparkloom.__main__ import main

    assert main(["list"]) == 0 and "f1_near_miss" in capsys.readouterr().out
    assert main(["run", "a2_edges_by_type", "/root/testdata/sf0.001", str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 3


def test_written_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from sparkloom.functions.shared import shared_folder

    conf = lambda d: SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: d.get(k, default)))
    assert shared_folder(conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_folder(conf({"spark.master": "local[4]"})).startswith("file://")
    with pytest.raises(ValueError):
        shared_folder(conf({"spark.master": "yarn"}))
