import random
from collections import Counter

import pytest
from graphs import Drawn, edge, graph, shuffled

from sparkloom.operators import retrieval as r


def sections_of(spark, edges):
    return {x.question: x.sections for x in r.graph_retrieval(graph(spark, edges).edges).collect()}


def test_fallback_and_hop(spark):
    e = [edge(1, "ASKS_ABOUT", "q:1", "concept:a"), edge(2, "REQUIRES", "sec:d1#x", "concept:a"), edge(3, "MENTIONS", "sec:d1#x", "concept:a"), edge(4, "MENTIONS", "sec:d1#w", "concept:a"), edge(5, "REQUIRES", "sec:d1#x", "concept:b"), edge(6, "DEFINES", "sec:d1#y", "concept:b")]
    assert sections_of(spark, e) == {"q:1": ["sec:d1#x", "sec:d1#w", "sec:d1#y"]}


def test_definitions_outweigh_use(spark):
    e = [edge(1, "ASKS_ABOUT", "q:1", "concept:a"), edge(2, "REQUIRES", "sec:d1#x", "concept:a"), edge(3, "DEFINES", "sec:d1#y", "concept:a")]
    assert sections_of(spark, e) == {"q:1": ["sec:d1#y"]}


def test_slots(spark):
    """Six seeds and four hops: three of the one, two of the other."""
    e = [edge(0, "ASKS_ABOUT", "q:1", "concept:a")]
    e += [edge(10 + i, "DEFINES", f"sec:d1#s{i}", "concept:a") for i in range(6)]
    e += [edge(30 + i, "REQUIRES", "sec:d1#s0", f"concept:h{i}") for i in range(4)] + [edge(40 + i, "DEFINES", f"sec:d1#h{i}", f"concept:h{i}") for i in range(4)]
    assert sections_of(spark, e) == {"q:1": [f"sec:d1#{x}" for x in ("s0", "s1", "s2", "h0", "h1")]}
    assert sections_of(spark, [x for x in e if "concept:h" not in x[3]]) == {"q:1": [f"sec:d1#s{i}" for i in range(5)]}


def test_a_hop_that_is_also_a_seed_leaves_a_slot(spark):
    e = [edge(0, "ASKS_ABOUT", "q:1", "concept:a")] + [edge(10 + i, "DEFINES", f"sec:d1#s{i}", "concept:a") for i in range(4)]
    e += [edge(30, "REQUIRES", "sec:d1#s0", "concept:h"), edge(31, "DEFINES", "sec:d1#s3", "concept:h")]
    assert sections_of(spark, e) == {"q:1": [f"sec:d1#s{i}" for i in range(4)]}


def test_vector_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "item_id bigint, item_vector array<float>")
    assert [x.item_id for x in r.vector_top_k(q, v, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_compare(spark):
    a = spark.createDataFrame([(f"q:{i}",) for i in range(4)], "question_id string")
    v = spark.createDataFrame([("q:0", "vector", "correct"), ("q:0", "graph", "declined"), ("q:1", "vector", "correct"), ("q:1", "graph", "correct"), ("q:2", "graph", "correct")], "question_id string, path string, verdict string")
    x = r.compare(a, v).collect()[0]
    assert (x.n, x.vector_only, x.graph_only, x.both, x.neither, x.vector_unscored, x.vector_correct_rate, x.mcnemar_correct) == (4, 1, 1, 1, 1, 2, 1.0, 1.0)


def test_overlap_of_ways(spark):
    one = spark.createDataFrame([("q:1", ["a", "b"]), ("q:2", ["a"])], "question string, sections array<string>")
    two = spark.createDataFrame([("q:1", ["b", "a"]), ("q:3", ["c"])], "question string, sections array<string>")
    assert tuple(r.retrieval_overlap(one, two).collect()[0]) == (3, 1, 1, 1)


def seed_scores(edges):
    """Brute force: seeds and their scores of each question."""
    defined, out = {e[3] for e in edges if e[1] == "DEFINES"}, Counter()
    for a in edges:
        for e in edges if a[1] == "ASKS_ABOUT" else ():
            if e[3] == a[3] and (e[1] == "DEFINES" or e[1] in ("REQUIRES", "MENTIONS") and e[3] not in defined):
                out[a[2], e[2]] += 3 if e[1] == "DEFINES" else 1
    return out


@pytest.mark.parametrize("seed", range(20, 23))
def test_seed_scores(spark, seed, monkeypatch):
    """Also with edges that say a thing twice, in many blocks and tasks."""
    d = Drawn(seed)
    e = d.edges + [(f"{x[0]}-again", *x[1:]) for x in d.edges[::7]]
    want = seed_scores(e)
    assert {(x.question, x.section): x.score for x in r.seeds(graph(spark, e).edges).collect()} == want and want
    monkeypatch.setattr(r, "DICTIONARY_BYTES", 40)
    monkeypatch.setattr(r, "SUMS_A_TASK", 20)
    assert sorted(map(tuple, r.seeds(graph(spark, e).edges).collect())) == sorted((*k, n) for k, n in want.items())


def test_seed_pairs_are_not_shuffled(spark):
    e = [edge(i, "ASKS_ABOUT", f"q:{i}", f"concept:{i % 2}") for i in range(200)] + [edge(1000 + i, "DEFINES", f"sec:d1#{i}", f"concept:{i % 2}") for i in range(200)]
    rows, moved = shuffled(spark, lambda: r.seeds(graph(spark, e).edges).count())
    assert rows == 20_000 and moved < 2_000


@pytest.mark.parametrize("seed", range(30, 33))
def test_best_seeds_and_hops(spark, seed):
    """Against brute force, with edges that say a thing twice; the same for one question of each kind as for all."""
    d = Drawn(seed, sections=30, concepts=8, questions=25)
    e = d.edges + [(f"{x[0]}-again", *x[1:]) for x in d.edges[::7]]
    g, top = graph(spark, e).edges, {}
    for (q, s), n in seed_scores(e).items():
        top.setdefault(q, []).append((-n, s))
    top = {q: sorted(v)[:3] for q, v in top.items()}
    found = r.best_seeds(g, 3)
    assert sorted((x.question, x["rank"], x.section, x.score) for x in found.collect()) == sorted((q, i, s, -n) for q, v in top.items() for i, (n, s) in enumerate(v, 1))
    want = Counter()
    for q, v in top.items():
        for _, s in v:
            for need in (x for x in e if x[1] == "REQUIRES" and x[2] == s):
                for give in (x for x in e if x[1] == "DEFINES" and x[3] == need[3]):
                    want[q, give[2]] += give[2] not in {t for _, t in v}
    want = {k: n for k, n in want.items() if n}
    assert sorted(map(tuple, r.hops(g, found).collect())) == sorted((*k, n) for k, n in want.items()) and want
    best = {q: sorted((-n, s) for (p, s), n in want.items() if p == q)[:2] for q in {q for q, _ in want}}
    assert sorted(map(tuple, r.hops(g, found, 2).collect())) == sorted((q, s, -n) for q, v in best.items() for n, s in v)


def many(n: int = 200) -> list:
    """Questions, sections with what they ask about, and sections one hop on."""
    e = [edge(i, "ASKS_ABOUT", f"q:{i}", "concept:a") for i in range(n)] + [edge(1000 + i, "DEFINES", f"sec:d1#{1000 + i}", "concept:a") for i in range(n)]
    return e + [edge(2000 + i, "REQUIRES", f"sec:d1#{1000 + i}", "concept:b") for i in range(n)] + [edge(3000 + i, "DEFINES", f"sec:d1#{3000 + i}", "concept:b") for i in range(n)]


def test_hop_pairs_are_not_shuffled(spark):
    g = graph(spark, many()).edges
    top = spark.createDataFrame([(f"q:{i}", f"sec:d1#{1000 + k}") for i in range(200) for k in range(3)], "question string, section string")
    rows, moved = shuffled(spark, lambda: r.hops(g, top).count())
    assert rows == 40_000 and moved < 10_000


def test_graph_retrieval_by_counted_rows(spark):
    """Five sections for all 200 questions alike, and no shuffle of their pairs."""
    g = graph(spark, many()).edges
    rows, moved = shuffled(spark, lambda: r.graph_retrieval(g).collect())
    assert {tuple(x.sections) for x in rows} == {tuple(f"sec:d1#{i}" for i in (1000, 1001, 1002, 3000, 3001))} and len(rows) == 200 and moved < 10_000
