from graphs import Drawn, edge, graph, section

from sparkloom import schema as t
from sparkloom.operators import graph as gr
from sparkloom.operators import proposals
from sparkloom.operators.findings import near_misses
from sparkloom.plans import pipeline


def test_checks(spark):
    g = Drawn(1).frame(spark)
    assert gr.dangling(g).count() == gr.wrong_ends(g.edges).count() == gr.reciprocal(g.edges).count() == gr.without_evidence(g.edges).count() == 0
    bad = graph(spark, [edge(1, "DEFINES", "q:1", "concept:a"), edge(2, "X", "sec:d1#a", "concept:a"), edge(3, "DEFINES", "sec:d1#a", "concept:a", span=" "), edge(4, "LINKS_TO", "sec:d1#a", "doc:d1"), edge(5, "CONTAINS", "doc:d1", "sec:d1#a"), edge(6, "MENTIONS", "sec:d1#a", "concept:a")], [section("a")])
    assert {r.id for r in gr.wrong_ends(bad.edges).collect()} == {"e:1", "e:2"} and {r.id for r in gr.without_evidence(bad.edges).collect()} == {"e:3"}
    assert {r.missing for r in gr.dangling(bad).collect()} == {"q:1", "concept:a"} and gr.reciprocal(bad.edges).count() == 1
    assert [tuple(r) for r in gr.double_relations(bad.edges).collect()] == [("sec:d1#a", "concept:a")]
    assert [tuple(r) for r in gr.parallel(bad.edges).collect()] == [("sec:d1#a", "concept:a", 3)]


def test_structure(spark):
    text = "# A\nsee [b](b.md#x) and [again](b.md), [out](https://x/y.md)\n[self](a.md)"
    s = spark.createDataFrame([("sec:a#a", "doc:a", "A", "A", 1, "docs/a.md", (3, 5), "u", text, None, 1)], t.SECTIONS)
    d = spark.createDataFrame([("doc:a", "A", "p", "u"), ("doc:b", "B", "p", "u")], t.DOCS)
    (x,) = gr.link_edges(s, d).collect()
    assert (x.src, x.dst, x.evidence.lines.start) == ("sec:a#a", "doc:b", 4)
    (c,) = gr.contains_edges(s).collect()
    assert (c.src, c.dst, c.evidence.span, c.evidence.lines.start) == ("doc:a", "sec:a#a", "# A", 3)
    q = spark.createDataFrame([("q:1", 1, "# t\n\n## Accepted answer by x\nyes"), ("q:2", 2, "no marker")], "id string, number bigint, raw string")
    a = spark.createDataFrame([("ans:1", "q:1", "x", True, "MEMBER", "b", "u"), ("ans:2", "q:2", "x", True, "MEMBER", "b", "u")], t.ANSWERS)
    assert {(r.src, r.evidence.lines.start) for r in gr.answer_edges(q, a).collect()} == {("q:1", 3), ("q:2", 1)}


def test_dense_ids(spark):
    e = spark.createDataFrame([edge(i, "MENTIONS", f"sec:d1#{i:04d}", f"concept:{i % 7}") for i in range(500)], t.EDGES)
    rows = gr.with_ids(e.drop("id"), 5).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, 501)) and [r.src for r in rows] == sorted(r.src for r in rows) and rows[0].id == "e:00001"


def test_pipeline(spark):
    d = Drawn(3)
    g = d.frame(spark)
    built = pipeline.build(g.docs, g.sections, g.concepts, g.questions, g.answers, g.edges.where("type = 'ASKS_ABOUT'"))
    asked = {c for q, cs in d.held.items() if q.startswith("q:") for c in cs}
    assert {r.id for r in built.concepts.collect()} == asked
    assert built.edges.where("type = 'CONTAINS'").count() == len(d.sections)
    found = near_misses(g)
    m = pipeline.manifest(g, found).collect()[0]
    touched = {x for e in d.edges for x in e[2:4]}
    nodes = {"doc:d1", *(f"sec:d1#{s}" for s in d.sections), *(f"concept:{c}" for c in d.concepts), *(f"q:{q}" for q in d.questions), *(f"ans:{a[0]}" for a in d.answers)}
    assert m.nodes["Concept"] == len(d.concepts) and m.edges["REQUIRES"] == sum(e[1] == "REQUIRES" for e in d.edges) and m.findings == {"near_miss": found.count()}
    assert m.defined == sum(bool(by["DEFINES"]) for by in d.into.values()) and m.isolated == len(nodes - touched)
    ((kind, n),) = pipeline.reached(found).collect()
    assert kind == "near_miss" and n == len({q for r in found.collect() for q in r.questions})


def test_build_adds_answers_and_the_sweep(spark):
    text = "A page on ferries\nA pilot is the person who steers the ferry.\nAsk the pilot."
    edges = [edge(1, "REQUIRES", "sec:d1#b", "concept:pilot"), edge(2, "MENTIONS", "sec:d1#c", "concept:pilot"), edge(3, "DEFINES", "sec:d1#b", "concept:ferry")]
    g = graph(spark, edges, [section("a", text), section("b", "x"), section("c", "y")], ["pilot", "ferry"], [1], [(1, True, "body")])
    said = [("docs/d1.md", "concept:pilot", "the person who steers the ferry", "high"), ("docs/d1.md", "concept:ferry", "A page on ferries", None), ("docs/d1.md", "concept:pilot", "words that stand nowhere", None)]
    found = spark.createDataFrame(said, "path string, concept string, span string, confidence string")
    threads = spark.createDataFrame([(1, "# t\n\n## Accepted answer by x\nyes")], "number bigint, raw string")
    built = pipeline.build(g.docs, g.sections, g.concepts, g.questions, g.answers, g.edges, threads=threads, found=found).edges
    swept = built.where("extractor = 'definition-sweep'").collect()
    assert [(r.src, r.dst, tuple(r.evidence.lines)) for r in swept] == [("sec:d1#a", "concept:pilot", (2, 2))]
    assert [(r.src, r.dst, r.evidence.lines.start) for r in built.where("type = 'ANSWERED_BY'").collect()] == [("q:1", "ans:1", 3)]
    assert proposals.sweep_landed(built).collect()[0].landed == 1


def test_spans_are_checked_where_they_stand(spark):
    s = spark.createDataFrame([("sec:a#a", "doc:a", "A", "A", 1, "docs/a.md", (3, 5), "u", "# A\nsee the **old** mill\nand the river", [("src/m.py", "src/m.py", (7, 8), "mill = Mill()\nmill.turn(3)")], 1)], t.SECTIONS)
    spans = [("see the old mill", "docs/a.md", 4, 4), ("old mill and the river", "docs/a.md", 4, 5), ("mill.turn(3)", "src/m.py", 8, 8), ("see the old mill", "docs/a.md", 5, 5), ("see the old mill", "docs/a.md", 4, 9), ("see the new mill", "docs/a.md", 4, 4), ("see the old mill", "docs/b.md", 4, 4)]
    e = spark.createDataFrame([(f"e:{i}", "MENTIONS", "sec:a#a", "concept:m", (x, p, (lo, hi), "prose"), "model", None) for i, (x, p, lo, hi) in enumerate(spans)], t.EDGES)
    texts = gr.cited_texts(s)
    assert {r.id for r in gr.lost_spans(e, texts).collect()} == {"e:5", "e:6"}
    assert {r.id for r in gr.misplaced_spans(e, texts).collect()} == {"e:3", "e:4", "e:5", "e:6"}
