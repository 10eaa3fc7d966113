import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import defects as d

WORDS = {
    "en": "the server does not answer when a client sends two requests and nobody knows why this happens after the update of our project".split(),
    "de": "der Dienst antwortet nicht mehr wenn zwei Anfragen gleichzeitig kommen und niemand weiß warum das nach dem Umbau so geschieht".split(),
    "es": "el servicio no responde cuando llegan dos peticiones a la vez y nadie sabe por qué ocurre esto después del cambio".split(),
}


def sentence(rnd, lang):
    w = [rnd.choice(WORDS[lang]) for _ in range(rnd.randint(7, 12))]
    return " ".join(w).capitalize() + "."


def body(rnd, lang, n=4):
    return " ".join(sentence(rnd, lang) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    labelled = spark.createDataFrame([(body(rnd, lang), lang.upper() if i % 5 == 0 else lang) for i in range(60) for lang in WORDS], "text string, lang string")
    rows = [(i, sentence(rnd, "en")[:-1], body(rnd, "en"), True, body(rnd, "en", 3)) for i in range(200)]
    t = lambda *r: rows.append(r)
    q, good = "Why is it slow?", body(rnd, "en")
    t(300, q, None, False, None)
    t(301, q, "  \n", True, "N/A")
    t(302, q, good, True, None)
    t(303, q, good, True, "I'm sorry, but I can't help with that. I hope you understand.")
    t(304, q, good, True, "I cannot test this right now, but " + body(rnd, "en", 2))
    t(305, q, good, True, " ".join(good.split()[5:25]).upper())
    t(306, q, good, True, "> " + good[:60] + "\n\n" + body(rnd, "en", 3))
    t(307, q, good, True, body(rnd, "de", 3))
    t(308, sentence(rnd, "es"), body(rnd, "de"), False, None)
    t(309, q, good, True, body(rnd, "en", 2) + " The server does not answer when a cli")
    t(310, q, "“" + q.lower() + "”", False, None)
    t(311, q, good, False, "")
    t(312, None, good, True, body(rnd, "en", 2))
    t(313, q, good + " Regards, Ann Miller", False, None)
    t(303, q, good, True, "I'm sorry, but I can't help with that. I hope you understand.")
    frame = spark.createDataFrame(rows, "number bigint, title string, body_text string, answered boolean, reply string")
    return frame.withColumn("answer", F.struct(F.lit("x").alias("body"), F.col("reply").alias("body_text"))).drop("reply").withColumn("key", F.lit("k")), labelled


def test_defects(tables):
    got = {(r.number, r.pair): r.defect for r in d.broken_pairs(tables[0], "number", tables[1]).collect()}
    assert {k: v for k, v in got.items() if k[0] >= 300} == {
        (300, "question"): "empty", (301, "question"): "empty", (301, "answer"): "empty", (302, "answer"): "empty", (303, "answer"): "refusal", (305, "answer"): "copied", (307, "answer"): "other_language", (308, "question"): "other_language", (309, "answer"): "truncated", (310, "question"): "copied",
    }
    assert sum(k[0] < 300 for k in got) <= 2


def test_empty_tables(spark, tables):
    none = tables[0].limit(0)
    assert d.broken_pairs(none, "number", tables[1]).count() == 0
    assert d.broken_pairs(tables[0].where("number = 303"), "number", tables[1].limit(0)).collect()[0].defect == "refusal"


@pytest.mark.parametrize(
    ("title", "said", "want"),
    [("Slow server", "slow server", "copied"), ("Timeouts", "“Timeouts”", "copied"), ("サーバーの再起動", "「サーバーの再起動」", "copied"), ("設定", "設定", "copied"), ("キャッシュが消える問題について", "キャッシュが消える問題について。", "copied"), ("Slow server", "Slow.", None), ("設定ファイル", "再起動する。", None), ("Timeouts", "Restart it.", None)],
)
def test_short_and_unspaced_titles(title, said, want):
    head = d.Text(title)
    got = d.judge([head], d.Text(said), head, d.Tokens(), None)
    assert got == want or want is None and isinstance(got, list)


def test_length_decides_nothing():
    head, sorry = d.Text("Why is it slow?"), "I cannot help with that."
    said = lambda t: d.judge([head], d.Text(t), head, d.Tokens(), None)
    assert said(sorry + " I am sorry." * 5) == said((sorry + "\n\n") * 200) == "refusal"
    assert said(sorry + " Restart the worker first." + " Then clear the cache of every node, and set the limit to four." * 3) is None
    assert said("N/A" + " -" * 500) == said("\n" * 3000 + "n/a\n" + "." * 3000) == "empty"
    long = "word " * 3000
    assert isinstance(said(long + "x" * 1000 + " and the wor"), list) and said(long + "\nContact: " + "a" * 900 + "@b.example") is None


def test_runs_are_counted_exactly(spark):
    """Against counting every run of every text."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("ab Cd the e1 . , Xy".split()) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    tokens, n, e, groups = d.Tokens(), {}, {}, []
    for t in texts:
        ids = tokens(t.strip())
        for i in range(len(ids) - 1):
            kind = tokens.table[2, ids[i]]
            if kind < 2:
                for g in d.end_runs([0, 0, 0, *ids[: i + 1]], tokens.table):
                    groups.append(g)
                    for k in g:
                        n[k] = n.get(k, 0) + 1
                        e[k] = e.get(k, 0) + int(tokens.table[2, ids[i + 1]] in (1, 2))
    wanted = sorted({k for g in groups[::3] for k in g})
    bloom = d.bloom_of(spark.createDataFrame([(k,) for k in wanted], "run bigint"))
    assert bloom.has(np.array(wanted, np.int64).view(np.uint64)).all()
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.run: (r.n, r.inside) for r in frame.mapInArrow(lambda it: d.counted(it, bloom), "run bigint, n bigint, inside bigint").groupBy("run").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).collect()}
    assert {k: got[k] for k in wanted} == {k: (n[k], e[k]) for k in wanted}


def test_cuts_alike_do_not_vouch_for_each_other(spark, tables):
    """As many cuts with one same end as a larger table brings along."""
    rnd = random.Random(8)
    cut = [" The server does not answer when a cli", " Nobody knows why this happens into"]
    rows = [(i, body(rnd, "en") + "\nHope this helps") for i in range(3000)] + [(3000 + i, body(rnd, "en") + cut[i % 2]) for i in range(10)]
    frame = spark.createDataFrame([(i, sentence(rnd, "en")[:-1], text) for i, text in rows], "number bigint, title string, body_text string")
    frame = frame.withColumns({"answered": F.lit(False), "answer": F.struct(F.lit(None).cast("string").alias("body_text"))})
    got = d.broken_pairs(frame, "number", tables[1]).where("defect = 'truncated'").collect()
    assert sorted(r.number for r in got) == list(range(3000, 3010))


def test_words_that_begin_others_go_on(spark):
    tokens = d.Tokens()
    ends = [d.end_runs(tokens(t), tokens.table) for t in ("when a cli", "comes from Iso", "call get")]
    bloom = d.bloom_of(spark.createDataFrame([(k,) for k in sorted({k for e in ends for g in e for k in g})], "run bigint"))
    texts = ["It fails when a client stops. Or when a Climber falls.", "when a cli\nIt comes from IsolatedView or from LocalView, we call get_user here", "call GetUser or getUser, a clip"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.run: (r.n, r.inside) for r in frame.mapInArrow(lambda it: d.counted(it, bloom), "run bigint, n bigint, inside bigint").groupBy("run").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside")).collect()}
    assert [got[k] for k in ends[0][0][:3]] == [(3, 1), (3, 1), (3, 1)]  # client, Climber and cli itself; clip ends a text
    assert [got[k] for k in ends[1][1][:2]] == [(7, 0), (2, 0)]  # It, Or, It, IsolatedView, LocalView, GetUser, Climber
    assert [got[k] for k in ends[2][0][:2]] == [(3, 0), (2, 0)]  # get_user, GetUser, getUser


def test_repeated_rows_leave_the_sample_whole(spark):
    from sparkloom.llm.common import bounded_sample

    rows = spark.range(1000).withColumn("text", F.md5(F.col("id").cast("string")))
    many = rows.crossJoin(spark.range(50).select()).select("id", "text")
    assert bounded_sample(many, 300).count() == 300 and bounded_sample(many, 1000).count() == 1000
