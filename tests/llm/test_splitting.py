import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import splitting as s


def cut(rows, texts, limit=100, overlap=10):
    got = s.split_rows(rows([(i, None, t) for i, t in enumerate(texts)]), "number", "body_text", limit, overlap).orderBy("number", "piece_no").collect()
    out = {}
    for r in got:
        assert r.piece_no == len(out.setdefault(r.number, [])) + 1
        out[r.number].append(r.piece)
    return out


def check(text, pieces, limit=100, overlap=10):
    whole = pieces[0]
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b.startswith(a[-overlap:] if overlap else "")
        whole += b[overlap:]
    assert whole == text and max(map(len, pieces)) <= limit


def test_pieces(rows):
    rnd = random.Random(2)
    sentence = lambda: " ".join("abcdefgh"[: rnd.randint(2, 8)] for _ in range(rnd.randint(3, 9))) + rnd.choice(". ! ? ; ,".split()) + rnd.choice([" ", "\n", "\n\n", "\r\n"])
    texts = ["".join(sentence() for _ in range(60)) for _ in range(20)] + ["x" * 1000, "é😀" * 300, "", None, "y" * 100, "z" * 101, "\n" * 500, "日本語の文。" * 80]
    got = cut(rows, texts)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 100}
    for i, p in got.items():
        check(texts[i], p)
        assert len(p) == 1 or i < 20 or len(p[0]) >= 50
    assert sum(p[-1] in "\n .!?;," for i in range(20) for p in got[i][:-1]) >= 0.9 * sum(len(got[i]) - 1 for i in range(20))
    assert not any(p.endswith("\r") and q[10:11] == "\n" for i in range(20) for p, q in zip(got[i], got[i][1:], strict=False))


def test_strongest_boundary(rows):
    text = "a" * 60 + "\n\n" + "b" * 20 + ". " + "c" * 80
    assert cut(rows, [text])[0][0] == "a" * 60 + "\n\n"


def test_boundary_in_the_first_half(rows):
    texts = ["Some words here.\nMore of them\n" + "x" * 300, "Some. More. It is y" + "y" * 95, "one two. " + "A" * 20 + ". " + "w" * 300, "dump " + "60225,14304," * 40, "z" * 70 + "-" + "z" * 200]
    got = cut(rows, texts)
    for i, t in enumerate(texts):
        check(t, got[i])
    assert got[0][0] == "Some words here.\nMore of them\n" and got[1][0] == "Some. More. " and got[2][0] == texts[2][:31]
    assert all(p.endswith(",") for p in got[3])
    assert got[4][0] == "z" * 70 + "-"


def test_repeats_and_empty(rows):
    assert len(cut(rows, [])) == 0
    long = "word " * 100
    got = s.split_rows(rows([(1, None, long), (1, "other title", long)]), "number", "body_text", 100, 10)
    assert got.count() == got.distinct().count()


def test_very_long(rows):
    text = "One sentence here. " * 50_000
    check(text, cut(rows, [text], 4000, 200)[0], 4000, 200)


def test_no_run_of_blanks_or_marks_passes_the_limit(rows):
    rnd = random.Random(8)
    texts = ["word " * 600 + "\n" + " " * 5000 + "\n" + "tail " * 900, "." + '"' * 600 + "x" * 9000]
    for _ in range(60):
        parts = [rnd.choice([" ", "\t", '"', "'", ")", "]", "\n", "\r\n", ".", "。", "ab ", "x"]) * int(10 ** rnd.uniform(0, 4)) for _ in range(rnd.randint(2, 7))]
        texts.append("".join(parts))
    for limit, overlap in ((4000, 200), (100, 10), (40, 0)):
        got = cut(rows, texts, limit, overlap)
        assert set(got) == {i for i, t in enumerate(texts) if len(t) > limit}
        for i, p in got.items():
            check(texts[i], p, limit, overlap)


def test_running_sums(spark):
    sizes = [[3, 1, 4], list(range(1000)), [7] * 256, [7] * 257, [5]]
    got = [r.x for r in spark.createDataFrame([(x,) for x in sizes], "a array<int>").select(s.running(F.col("a")).alias("x")).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for x in sizes]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab \n.\r,é", min_size=41, max_size=300))
def test_pattern_covers_every_text(text):
    """The same pattern in Python: fresh parts join to the text, each within its limit."""
    import regex

    parts = [m[0] for m in regex.finditer(s.pattern(40, 5), text)]
    assert "".join(parts) == text and len(parts[0]) <= 40 and all(len(p) <= 35 for p in parts[1:])
