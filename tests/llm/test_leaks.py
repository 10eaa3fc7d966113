import random
import re

from sparkloom.llm import leaks as l


def corpus():
    rnd = random.Random(8)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(40)).capitalize() + ".") for i in range(25)] + [(90, None), (91, ""), (92, "only five words in here"), (3, "x")]
    docs = []
    for d in range(60):
        text = " ".join(rnd.choice(words) for _ in range(50))
        if d % 2:
            w = items[rnd.randrange(25)][1].split()
            n = rnd.choice([8, 11, 12, 13, 30])
            at = rnd.randrange(len(w) - n)
            part = w[at : at + n]
            text += "\n\n" + rnd.choice([" ", ",  ", "\n"]).join(part).upper() + " " + text[:40]
        docs.append((d, None, text))
    return [*docs, (200, None, None), (201, None, " "), (202, None, "one"), docs[1]], items


def brute(docs, items, run=12):
    words = lambda t: re.findall(r"\w+", (t or "").casefold())
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    held = [(i, grams(words(t))) for i, t in items]
    return {(d, i) for d, _, t in docs for i, g in held if grams(words(t)) & g}


def test_all_quotes_are_found(spark, rows):
    docs, items = corpus()
    b = spark.createDataFrame([(i, "suite", t) for i, t in items], "item_id bigint, suite string, text string")
    for block in (1 << 24, 700, 1):
        got = l.leaks(rows(docs, "doc_id", "text"), "doc_id", "text", b, "item_id", "text", block=block).where("run >= 12")
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_empty(spark, rows):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id bigint, text string")
    assert l.leaks(rows([(1, None, "a b")], "doc_id", "text"), "doc_id", "text", none, "item_id", "text").count() == 0
    assert l.leaks(rows([], "doc_id", "text"), "doc_id", "text", some, "item_id", "text").count() == 0


def test_alignment_against_the_full_table():
    import numpy as np

    def table(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (l.MATCH if a[i - 1] == b[j - 1] else l.MISMATCH), h[i - 1, j] + l.GAP, h[i, j - 1] + l.GAP)
        return h.max()

    rnd = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert l.align(a, b) == table(a, b)


def test_an_edited_copy_scores(spark, rows):
    words = [f"u{i}" for i in range(40)]
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    (r,) = l.leaks(rows([(5, None, "before " + " ".join(edited) + " after")], "doc_id", "text"), "doc_id", "text", b, "item_id", "text").collect()
    assert r.run == 8 and r.score > 50 and r["size"] == 40


def test_texts_of_one_item_are_kept_apart(spark, rows):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    items = spark.createDataFrame([(1, a), (1, b)], "item_id bigint, text string")
    docs = [(1, None, " ".join([*a.split()[-10:], *b.split()[:10]])), (2, None, " ".join([*b.split()[-10:], *a.split()[:10]])), (3, None, b[:60])]
    got = {r.doc_id: r.run for r in l.leaks(rows(docs, "doc_id", "text"), "doc_id", "text", items, "item_id", "text", least=10).collect()}
    assert got[1] == got[2] == 10 and got[3] > 12


def test_blocks_hold_counted_bytes(spark):
    known = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((5, 5, 5, 50, 1, 1))], "id bigint, t string")
    assert list(l.blocks_of(known, 10)) == [[0, 1], [2], [3], [4, 5]] and list(l.blocks_of(known.limit(0), 10)) == []
