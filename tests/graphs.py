"""Graphs for tests: rows of every table, and random graphs that a brute-force finder can read too."""

from __future__ import annotations

import random
from collections import defaultdict

from sparkloom import schema as t
from sparkloom.schema import Graph


def edge(n, kind, src, dst, span="a span of evidence", prose="prose", confidence="high"):
    return (f"e:{n}", kind, src, dst, (span, "docs/d1.md", (1, 1), prose), "model", confidence)


def section(name, text="text", code=None, heading=None):
    return (f"sec:d1#{name}", "doc:d1", "D1", heading or name, 2, "docs/d1.md", (1, len(text.split("\n"))), "u", text, code, len(text))


def graph(spark, edges, sections=(), concepts=(), questions=(), answers=()):
    frame = lambda rows, s: spark.createDataFrame(list(rows), s)
    return Graph(
        frame([("doc:d1", "D1", "docs/d1.md", "u")], t.DOCS), frame(sections, t.SECTIONS), frame([(f"concept:{c}", c, "term", [], [c]) for c in concepts], t.CONCEPTS),
        frame([(f"q:{n}", n, f"title {n}", "body", "2024", "u", True) for n in questions], t.QUESTIONS), frame([(f"ans:{n}", f"q:{n}", "x", m, "NONE", b, "u") for n, m, b in answers], t.ANSWERS), frame(edges, t.EDGES),
    )


class Drawn:
    """A random graph as plain rows, with the sets that brute force needs."""

    def __init__(self, seed: int, sections: int = 14, concepts: int = 10, questions: int = 12) -> None:
        rnd = random.Random(seed)
        self.sections, self.concepts, self.questions = [f"s{i:02d}" for i in range(sections)], [f"topic{i}" for i in range(concepts)], list(range(questions))
        self.answers = [(q, rnd.random() < 0.4, "w" * rnd.randrange(6)) for q in self.questions if rnd.random() < 0.8]
        self.edges, seen = [], set()

        def add(kind, src, dst):
            if (kind, src, dst) not in seen:
                seen.add((kind, src, dst))
                self.edges.append(edge(len(self.edges), kind, src, dst, prose=rnd.choice(["prose", "prose", "code"]), confidence=rnd.choice(["high", "medium", "low", None])))

        for s in self.sections:
            for _ in range(rnd.randint(0, 5)):
                c = rnd.randrange(concepts)
                add(rnd.choice(["REQUIRES", "MENTIONS", "DEFINES"] if c < concepts // 2 else ["REQUIRES", "MENTIONS"]), f"sec:d1#{s}", f"concept:topic{c}")
        for q in self.questions:
            for _ in range(rnd.randint(0, 4)):
                add("ASKS_ABOUT", f"q:{q}", f"concept:topic{rnd.randrange(concepts)}")
        for q, _, _ in self.answers:
            add("ANSWERED_BY", f"q:{q}", f"ans:{q}")
        self.into = defaultdict(lambda: defaultdict(list))  # concept -> type -> edges
        self.held = defaultdict(set)  # section or question -> concepts
        for e in self.edges:
            if e[3].startswith("concept:"):
                self.into[e[3]][e[1]].append(e)
                self.held[e[2]].add(e[3])

    def frame(self, spark) -> Graph:
        return graph(spark, self.edges, [section(s) for s in self.sections], self.concepts, self.questions, self.answers)


def shuffled(spark, work) -> tuple:
    """What ``work()`` gives, and how many rows it wrote to shuffles."""
    sc = spark.sparkContext

    def rows() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    return work(), rows() - before
