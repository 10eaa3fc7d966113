import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import abuse as a


def snippets():
    rnd = random.Random(3)
    noun = lambda: rnd.choice("queue cache index worker page form".split())
    fine = ["Kill the parent process of the {n} first.", "The {n} is slow after the update of the server.", "A stupid mistake of mine, I forgot the {n}.", "Women and men use the {n} of the portal.", "The naked except clause hides the {n} error."]
    bad = {"abusive": ["You are a worthless idiot and your {n} proves it.", "I will find out where you live and break your fingers, {n}."], "hateful": ["Foreigners are vermin and should be kept away from the {n}."], "sexual": ["Send me nudes and I will fix your {n}."]}
    out = [(rnd.choice(fine).format(n=noun()), "none") for _ in range(120)]
    return out + [(rnd.choice(v).format(n=noun()), k) for k, v in bad.items() for _ in range(20)] + [("You are a worthless idiot.", None), ("x", "other")]


DOCS = [
    (1, "The queue is slow. You are a w0rthl3ss id*ot and your cache proves it. Thanks.", True), (2, "Kill the parent process of the form first, then the child.", False), (3, "Send me nu​des and I will fix your page.", True), (4, "YOU ARE A WORTHLESS I-D-I-O-T and your page proves it", True),
    (5, "Du bist ein dummer Vollidiot, halt die Fresse.", True), (6, "Ты тупой идиот, заткнись уже.", True), (7, "お前は本当に馬鹿だ、消えろ。", True), (8, "The naked except clause hides the error of women and men.", False), (9, None, False), (10, "", False), (11, " \n", False), (12, "The server is fine. " * 5000, False), (13, "The server is fine. " * 200 + "Foreigners are vermіn and should be kept away from it. " + "The server is fine. " * 200, True),
]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(snippets())], "label_id bigint, text string, label string")


def test_scores(spark, rows, labels):
    docs = rows([(i, None, t) for i, t, _ in DOCS] + [(100 + i, None, "The worker reads the index and the form of the server after the update.") for i in range(60)], "doc_id", "text")
    rated = a.rate_rows(docs, "doc_id", "text", labels, keep=("title", "key"))
    got = {r.doc_id: (r.score, r.passages) for r in rated.collect()}
    assert {i: got[i][1] > 0 for i, _, _ in DOCS} == {i: bad for i, _, bad in DOCS}
    assert got[9] == got[10] == got[11] == (0.0, 0) and not any(got[i][1] for i in got if i >= 100)
    (r,) = a.source_rates(rated, "key").collect()
    assert (r.documents, r.abusive) == (len(got), sum(b for *_, b in DOCS))


def test_corpus_counts_the_words_that_are_scored():
    scorer = a.Scorer([(t, k in a.BAD) for t, k in snippets() if k in ("none", *a.BAD)])
    texts = ["お前は本当に馬鹿だ、消えろ。", "馬鹿な設定で全裸のサーバーが落ちる", "The worker reads the index.", None]
    (batch,) = a.counted(iter([pa.record_batch([pa.array(texts)], names=["text"])]), scorer)
    got = {i: n for i, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True)}
    words = [w for t in texts if t for w in scorer.folder(t)]
    assert got.pop(len(scorer.vocabulary)) == len(words)
    assert {scorer.vocabulary[i]: n for i, n in got.items()} == {w: words.count(w) for w in words if w in scorer.number}
    assert got[scorer.number["馬鹿"]] == 2


def test_empty(spark, rows, labels):
    assert a.rate_rows(rows([], "doc_id", "text"), "doc_id", "text", labels).count() == 0
    none = a.rate_rows(rows([(1, None, "You worthless idiot, you pathetic scum.")], "doc_id", "text"), "doc_id", "text", labels.limit(0))
    assert none.collect()[0].passages >= 0


def test_segments_against_brute_force():
    rnd = random.Random(5)

    def brute(s, lo=0, hi=None):
        hi = len(s) if hi is None else hi
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        return brute(s, lo, best[3]) + [(best[0], best[3], best[4])] + brute(s, best[4], hi)

    for _ in range(300):
        s = [rnd.choice((-3, -2, -1, 1, 2, 4)) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        assert [(round(x, 6), i, j) for x, i, j in a.segments(s)] == [(round(x, 6), i, j) for x, i, j in brute(s)]


# Written apart from the seeds' sentences; each language has its own words of abuse.
ABUSE = {
    "de": ["Du bist so ein Trottel, halt endlich die Fresse.", "Was für ein Arschloch, verpiss dich.", "Dieser Wichser hat wieder alles kaputt gemacht.", "Abschaum wie du gehört nicht hierher, Missgeburt.", "Sie schickte Nacktbilder und wollte ficken."],
    "es": ["Eres un gilipollas y un inútil.", "Cállate, pendejo de mierda.", "Ojalá te pudras, cabrón, muérete.", "Esa gente es escoria, unas ratas.", "Mandó fotos desnuda y hablaba de follar."],
    "fr": ["Ta gueule, espèce de connard.", "Quel crétin, vraiment un abruti débile.", "Crève, ordure.", "Ces gens sont des parasites, de la vermine.", "Elle montrait ses seins nue, du porno pur."],
    "pt": ["Seu idiota, cala a boca, otário.", "Que babaca, burro de merda.", "Vai para o inferno, desgraçado, seu lixo.", "Eles são vermes, escória.", "Mandou fotos nua e falava de foder."],
    "ru": ["Ты идиот и дебил, заткнись.", "Какой же ты урод, сдохни.", "Эта тварь, мразь и сволочь опять тут.", "Все они паразиты и отбросы.", "Она прислала голые фото и хотела трахать."],
    "ja": ["お前は馬鹿だ、死ね。", "このクズ、黙れ、消えろ。", "アホなゴミは死ねばいい。", "あいつらは害虫だ、殺すべきだ。", "裸の写真とエロい動画を送ってきた。"]
}
SOUND_ABROAD = {"de": ["Der Dienst antwortet nicht mehr, und niemand weiß warum.", "Bitte den Bericht bis morgen schicken."], "es": ["El servicio no responde desde ayer.", "Gracias por la ayuda, ya funciona."], "fr": ["Le service ne répond plus depuis hier.", "Merci pour votre aide."], "pt": ["O serviço não responde desde ontem.", "Obrigado pela ajuda."], "ru": ["Сервис не отвечает со вчерашнего дня.", "Спасибо за помощь."], "ja": ["サーバーが昨日から応答しません。", "ありがとうございます、直りました。"]}


def test_recall_by_language():
    """Sentences of six languages without labels, each inside harmless text."""
    scorer = a.Scorer([(t, k in a.BAD) for t, k in snippets() if k in ("none", *a.BAD)])
    plain = "The build is fine again after the update of the cache. "
    rnd = random.Random(5)
    texts = [t + " " + " ".join(f"word{rnd.choice('abcdefgh')}{rnd.choice('abcdefgh')}" for _ in range(60)) for t, k in snippets() if k == "none"]
    (batch,) = a.counted(iter([pa.record_batch([pa.array(texts)], names=["text"])]), scorer)
    corpus = [0] * (len(scorer.vocabulary) + 1)
    for i, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
        corpus[i] = n
    scorer.fit(np.array(corpus[:-1]), corpus[-1])

    def passages(text):
        (out,) = a.rated(iter([pa.record_batch([pa.array([1]), pa.array([text])], names=["id", "text"])]), scorer)
        return out["passages"][0].as_py()

    for lang, said in ABUSE.items():
        assert sum(passages(plain + x + " " + plain) > 0 for x in said) >= 0.8 * len(said), lang
        assert not any(passages(plain + x) for x in SOUND_ABROAD[lang]), lang
