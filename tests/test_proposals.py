from graphs import section

from sparkloom import schema as t
from sparkloom.operators import proposals as p

TEXT = "Using sessions here\nYou need a session before you query.\nThe engine opens it lazily."
CODE = [("src/a.py", "src/a.py", (5, 6), "engine = create_engine(url)\nsession = open(engine)")]


def sections(spark):
    return spark.createDataFrame([section("s", TEXT, CODE)], t.SECTIONS)


def proposed(spark, *rows):
    return spark.createDataFrame([("batch-000", s, i, k, c, x, conf) for i, (s, k, c, x, conf) in enumerate(rows)], t.PROPOSALS)


def test_every_reason(spark):
    s = "sec:d1#s"
    rows = p.judged(
        proposed(spark, (s, "requires ", "`Session`", "you need a SESSION before you query", "HIGH"), (s, "REQUIRES", "session", "You need a session before you query.", None), (s, "USES", "x", "You need a session before", None), (s, "DEFINES", " ", "You need a session before", None),
                 (s, "DEFINES", "engine", "short", None), (s, "DEFINES", "engine", "using sessions here", None), (s, "DEFINES", "engine", "not to be found anywhere", None), ("sec:gone", "DEFINES", "engine", "You need a session before", None), (s, "DEFINES", "engine", "engine = create_engine(url) session", "odd")),
        sections(spark),
    )
    got = {r.pos: r.drop_reason for r in rows.collect()}
    assert got == {0: None, 1: "duplicate", 2: "bad_type", 3: "bad_type", 4: "short_span", 5: "heading_only", 6: "span_not_found", 7: "unknown_section", 8: None}
    edges = {r.dst: r for r in p.edges_of(rows).collect()}
    assert edges["concept:session"].confidence == "high" and edges["concept:session"].evidence.kind == "prose" and tuple(edges["concept:session"].evidence.lines) == (2, 2)
    assert edges["concept:engine"].confidence == "medium" and edges["concept:engine"].evidence.kind == "code" and tuple(edges["concept:engine"].evidence.lines) == (5, 6)
    line = p.ledger(rows).collect()[0].asDict()
    assert line["proposed"] - line["kept"] == sum(v for k, v in line.items() if k.startswith("dropped_") and k != "dropped_unknown_section")


def test_replies(spark):
    reply = '{"sec:d1#s": {"concepts": [], "edges": [{"type": "DEFINES", "concept": "a", "span": "b", "confidence": "low"}]}}'
    df = spark.createDataFrame([("b1", reply), ("b2", "broken"), ("b3", None)], "batch_id string, reply string")
    assert [tuple(r) for r in p.exploded(df).collect()] == [("b1", "sec:d1#s", 0, "DEFINES", "a", "b", "low")]


def test_votes_and_resolver(spark):
    named = spark.createDataFrame([("c1", "Session", "api", 0), ("c1", "session", "term", 1), ("c1", "session", "api", 2), ("c1", "Session", "term", 3), ("c1", "a session", "term", 4)], "concept_id string, label string, kind string, ordinal int")
    (v,) = p.voted_concepts(named).collect()
    assert (v.label, v.kind, v.surface_forms, v.aliases) == ("Session", "term", ["Session", "a session", "session"], ["a session", "session"])
    c = spark.createDataFrame([("c:1", "Alpha", "t", ["beta"], ["Alpha"]), ("c:2", "beta", "t", ["gamma"], []), ("c:3", "Alpha", "t", ["gamma"], [])], t.CONCEPTS)
    assert {r.key: r.concept for r in p.resolver(c).collect()} == {"alpha": "c:3", "beta": "c:2", "gamma": "c:2"}


def test_asked(spark):
    q = spark.createDataFrame([("q:1", "How do I use the `engine` in tests?", "discussions/1.md")], "id string, body string, path string")
    c = spark.createDataFrame([("concept:engine", "engine", "t", [], [])], t.CONCEPTS)
    a = spark.createDataFrame([("b", "q:1", 0, "Engine", "use the engine in tests", "low"), ("b", "q:1", 1, "engine", "How do I use the", None), ("b", "q:9", 0, "engine", "x", None), ("b", "q:1", 2, "other", "How do I use the", None)], "batch_id string, question_id string, pos int, label string, span string, confidence string")
    rows = p.asked_edges(a, q, c)
    assert sorted((r.question_id, r.pos, r.drop_reason, r.recovered) for r in rows.collect()) == [("q:1", 0, None, True), ("q:1", 1, "duplicate", False), ("q:1", 2, "unknown_concept", False), ("q:9", 0, "unknown_question", False)]
    assert [tuple(r) for r in p.unknown_labels(rows).collect()] == [("other", 1)]


def test_sweep(spark):
    from graphs import edge, graph

    g = graph(spark, [edge(1, "REQUIRES", "sec:d1#a", "concept:x"), edge(2, "MENTIONS", "sec:d1#b", "concept:x"), edge(3, "REQUIRES", "sec:d1#a", "concept:y"), edge(4, "DEFINES", "sec:d1#s", "concept:z"), edge(5, "ASKS_ABOUT", "q:1", "concept:w")])
    assert {(r.concept, r.sections, r.asked) for r in p.sweep_targets(g.edges).collect()} == {("concept:x", 2, 0), ("concept:w", 0, 1)}
    found = spark.createDataFrame([("docs/d1.md", "concept:x", "You need a session before", "low"), ("docs/d1.md", "concept:z", "You need a session before", "low"), ("docs/d1.md", "concept:v", "is not in there at all", "low")], "path string, concept string, span string, confidence string")
    assert [(r.src, r.dst, r.extractor) for r in p.sweep_edges(found, sections(spark), g.edges).collect()] == [("sec:d1#s", "concept:x", "definition-sweep")]
