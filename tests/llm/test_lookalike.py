import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import lookalike as l

BASE = "Café in Köln: the naïve approach, 12 files.\nSecond line!"
VARIANTS = ["Cafe\u0301 in Ko\u0308ln: the nai\u0308ve approach, 12 files.\nSecond line!", BASE.replace("files", "fi\u200bles"), BASE.replace(" ", "\u00a0"), BASE.replace("a", "\u0430"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in BASE), BASE.replace("\n", "\r\n")]
OTHERS = [BASE.upper(), BASE.replace("!", "."), BASE.replace("Café", "Cafe"), BASE.replace("\n", " "), BASE.replace("12", "1²"), BASE.replace("'", "’") + "’"]


def test_classes(rows):
    data = [(i, None, t) for i, t in enumerate([BASE, *VARIANTS, *OTHERS], 1)] + [(50, None, None), (51, None, " \n"), (52, None, "\u00a0"), (53, None, ""), (1, None, BASE), (54, None, BASE)]
    got = {(r.number_a, r.number_b) for r in l.same_reading(rows(data), "number", "body_text").collect()}
    same = [*range(1, 8), 54]
    texts = dict((n, t) for n, _, t in data)
    assert got == {(a, b) for a in same for b in same if a < b and texts[a] != texts[b]}
    forms = {r.number: (r.body_text, r.class_id) for r in l.unify(rows(data), "number", "body_text").collect()}
    assert {forms[n][0] for n in same} == {BASE} and {forms[n][1] for n in same} == {1}
    assert forms[50] == (None, None) and all(forms[n][1] is None for n in range(8, 14)) and len(forms) == len(texts)


def test_empty_and_long(rows):
    assert l.same_reading(rows([]), "number", "body_text").count() == 0
    long = "word é " * 60_000
    assert l.same_reading(rows([(1, None, long), (2, None, unicodedata.normalize("NFD", long))]), "number", "body_text").count() == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable(text):
    once = l.unified(text)
    assert l.unified(once) == once and l.unified(unicodedata.normalize("NFD", once)) == once or any(0x1100 <= ord(c) for c in text)


def test_python_and_sql_agree(spark):
    from pyspark.sql import functions as F

    texts = [BASE, *VARIANTS, *OTHERS, "Привет мир, ёлка", "ｶﾞｷﾞ テスト", "e\u0301\u0302x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(l.canonical(F.col("t")).alias("c")).collect()] == [l.unified(t) for t in texts]


def test_a_text_of_many_ids_meets_its_other_form_only(spark):
    """One stored text under a third of a million ids, and one id that stores it with another blank."""
    import time

    from pyspark.sql import functions as F

    def took(frame):
        began = time.time()
        n = l.same_reading(frame, "number", "body_text").count()
        return n, time.time() - began

    many, line = 200_000, "one text that everybody posts again"
    ids = spark.range(many).withColumnRenamed("id", "number")
    copies = ids.withColumn("body_text", F.lit(line)).union(spark.createDataFrame([(many, line.replace(" ", " "))], "number bigint, body_text string"))
    distinct = ids.withColumn("body_text", F.format_string(line + " %d", "number"))
    took(distinct)  # starts the engine
    (n, hot), (none, cold) = took(copies), took(distinct)
    assert n == many and none == 0 and hot < 3 * cold + 5
