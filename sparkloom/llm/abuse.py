"""Problem 9: passages that insult, threaten, degrade or are sexually explicit.

1. Words and word pairs of reviewed snippets get log-odds of standing in a bad snippet, with
   a Dirichlet prior: the counts of the same words over all documents, and on the bad side
   ``SEEDS`` of several languages as pseudo-counts, since the snippets are English only.
2. Maximum-scoring segment search: one pass over a document's scores finds every maximal
   segment. Words outside the vocabulary, the most, score below zero.
3. Extreme-value calibration: the best segment of n chance words follows a Gumbel law whose
   scale is the root of ``sum p(s) exp(lambda s) = 1`` over the score counts of the corpus and
   whose place comes from the snippets judged harmless. Scores become the negative log of the
   chance of such a segment, comparable between short and long documents; the threshold lies
   in the gap between harmless and bad snippets, but never where chance has more than 1.5 %.

Disguised words (digits and signs for letters, letters set apart, stretched or masked,
invisible characters, look-alikes) are folded if they give a word of the vocabulary's bad side.

Null and blank texts score 0. Labels other than the four known, and null, are left out. At most
``MOST_LABELS`` labelled rows are used, chosen by hash. Without bad labels the seeds decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample
from .lookalike import unified

MOST_LABELS, PRIOR, CORPUS, SEED_COUNT, CLIP, DRIFT, PAIR_CLIP, LEAST_CUT = 20_000, 100.0, 20_000.0, 6.0, 4.0, 0.6, 3.0, 4.2
BAD = ("abusive", "hateful", "sexual")

# Words of abuse, hate and explicit sexual talk, by language; Japanese as pairs of characters.
SEEDS = {
    "en": "idiot moron imbecile halfwit dimwit loser scumbag bastard bitch asshole fuck fucking cunt whore slut retard pathetic worthless filthy vermin subhuman scum parasite clown cretin jerk dumbass nudes porn horny naked blowjob dick pussy cock orgasm masturbate hate despise liars ashamed ass beat licked moaned undressed bare strangle stab rape exterminate inferior rid gone miss lose kiss",
    "de": "vollidiot idiot trottel dummkopf arschloch fresse verpiss wichser hurensohn schlampe versager erbärmlicher missgeburt abschaum ungeziefer untermenschen verrecke krepier nacktbilder geil titten ficken muschi schwanz porno",
    "es": "idiota imbécil estúpido inútil gilipollas cabrón puta mierda basura escoria ratas infierno cállate muérete pendejo maricón desnuda desnudas desnudo caliente cachonda follar tetas porno polla",
    "fr": "idiot crétin imbécile connard connasse salope pute merde ordure gueule ferme abruti débile minable vermine parasites dégage crève raclure nue nues excité excitée bander baiser seins porno",
    "pt": "idiota imbecil burro otário babaca merda lixo inferno cala verme vermes escória desgraçado puta vagabunda nua nuas pelada tesão foder peitos porno",
    "ru": "идиот дурак дебил тупой тупая заткнись сдохни мразь сволочь ублюдок урод шлюха сука отбросы паразиты твари убирайтесь голую голые голая возбужден возбуждён порно трахать сиськи проваливай ничтожество жалкий мусор",
    "ja": "馬鹿 バカ アホ 死ね クズ 消え えろ 黙れ ゴミ 害虫 殺す 殺し 裸の 全裸 興奮 エロ ヌー セッ 無能 くた ばれ",
}
# English function words, which say little by themselves.
FUNCTION = frozenset("a about after all also an and any are as at be because been before but by can could did do does for from had has have he her him his how i if in into is it its just many me more most my no nor not of off on once only or other others our out over she should so some such than that the their them then there these they this those though to too under until up very was we were what when where whether which while who whom whose why will with would you your".split())
LEET = str.maketrans("013457@$!|8", "oieastasiib")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[0-9]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
MIXED = re.compile(r"(?<![\w/.@*-])(?:[^\W\d_]+[0134578@$!*#|]+|[@$*013457]+[^\W\d_])[^\W_@$!*#|]*(?:[0134578@$!*#|]+[^\W\d_]+)*(?![\w/@*])")
CAMEL = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z]*[a-z0-9]+(?:[A-Z][a-z0-9]*)+\b")  # the set in front lets the search skip to it
SIGN, BLANK, LETTER = re.compile(r"[0134578@$!*#|]"), re.compile(r"\s"), re.compile(r"[^\W\d_]")
LINK = re.compile(r"https?://\S+")
TRIPLES = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
APART = re.compile(r"(?<![\w-])(?:[^\W\d_][-.·•_ *]{1,2}){3,}[^\W\d_](?![\w-])")
LONG = re.compile(r"\w*([^\W\d_])\1\1\w*")


SPACED = re.compile(r"(?<!\w)[^\W\d_][-.·•_ *]{1,2}[^\W\d_][-.·•_ *]{1,2}[^\W\d_](?!\w)|[*·•]")


def without_snakes(text: str) -> str:
    """The text without words that hold an underscore and do not begin or end with one."""
    parts, last, at = [], 0, text.find("_")
    while at >= 0:
        lo, hi = at, at + 1
        while lo > last and (text[lo - 1] == "_" or text[lo - 1].isalnum()):
            lo -= 1
        while hi < len(text) and (text[hi] == "_" or text[hi].isalnum()):
            hi += 1
        if text[lo] != "_" and text[hi - 1] != "_":
            parts += [text[last:lo], " "]
            last = hi
        at = text.find("_", hi)
    return "".join(parts) + text[last:] if parts else text


def plain(text: str) -> str:
    """Lower case, one form, no names of code and no links."""
    text = unified(text)
    if "://" in text:
        text = LINK.sub(" ", text)
    if "_" in text:
        text = without_snakes(text)
    return CAMEL.sub(" ", text).lower()


class Folder:
    """Gives disguised words back if they are known."""

    def __init__(self, known: set[str]) -> None:
        self.known, self.sizes = known, {}
        seeds = " ".join(SEEDS.values()).split()
        for w in sorted(known, key=lambda w: (w not in seeds, w)):
            self.sizes.setdefault(len(w), []).append(w)
        # a word with one letter doubled
        doubled = {w[: i + 1] + w[i:]: w for w in known if len(w) > 3 and w.isascii() for i in range(len(w))}
        self.doubled = {k: w for k, w in doubled.items() if k not in known}

    def mixed(self, m: re.Match) -> str:
        word = m[0]
        for w in (word.translate(LEET), word.replace("1", "l").translate(LEET), re.sub(r"(.)\1+", r"\1", word.translate(LEET))):
            if w in self.known:
                return w
        if "*" in word or "#" in word:
            parts = re.findall(r"[*#]+|[^*#]+", word)
            mask = re.compile("".join(f".{{1,{max(len(p), 2)}}}" if p[0] in "*#" else re.escape(p.translate(LEET)) for p in parts))
            for size in range(len(word) + 1, 2, -1):
                for w in self.sizes.get(size, ()):
                    if mask.fullmatch(w):
                        return w
        return word

    def unmixed(self, text: str) -> str:
        """The text with its mixed words folded; only words that hold a sign are looked at."""
        parts, last, done = [], 0, 0
        for m in SIGN.finditer(text):
            at = m.start()
            if at < done:
                continue
            lo = at
            while lo > done and not text[lo - 1].isspace():
                lo -= 1
            end = BLANK.search(text, at)
            done = end.start() if end else len(text)
            if LETTER.search(text, lo, done):
                word = text[lo:done]
                if (new := MIXED.sub(self.mixed, word)) != word:
                    parts += [text[last:lo], new]
                    last = done
        return "".join(parts) + text[last:] if parts else text

    def apart(self, m: re.Match) -> str:
        letters = [c for c in m[0] if c.isalpha()]
        for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
            w = "".join(letters[a : len(letters) - b])
            if w in self.known:
                return " ".join([*letters[:a], w, *letters[len(letters) - b :]])
        return m[0]

    def long(self, m: re.Match) -> str:
        for w in (re.sub(r"(.)\1\1+", r"\1", m[0]), re.sub(r"(.)\1\1+", r"\1\1", m[0])):
            if w in self.known:
                return w
        return m[0]

    def pairs(self, word: str) -> list[str]:
        every = [word[i : i + 2] for i in range(max(1, len(word) - 1))]
        return [p for i, p in enumerate(every) if i % 3 == 0 or p in self.known]

    def split(self, text: str) -> list[str]:
        words = WORD.findall(text)
        if CJK.search(text):
            # a word there is about three characters long, so of unknown pairs every third counts
            words = [p for w in words for p in (self.pairs(w) if CJK.match(w) else [w])]
        return words

    def words(self, text: str) -> list[str]:
        """The words of a text without names of code, Japanese and Chinese runs as pairs of characters; doubled letters as they are."""
        text = plain(text)
        text = self.unmixed(text)
        if SPACED.search(text):
            text = APART.sub(self.apart, text)
        if any(t in text for t in TRIPLES) or not text.isascii():
            text = LONG.sub(self.long, text)
        return self.split(text)

    def __call__(self, text: str) -> list[str]:
        get = self.doubled.get
        return [get(w, w) for w in self.words(text)]


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, ``score, start, end``, in one pass."""
    held: list[list[float]] = []  # left sum, right sum, start, end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        left, right, start = before, total, i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j -= 1
            if j < 0 or held[j][1] >= right:
                break
            left, start = held[j][0], int(held[j][2])
            del held[j:]
        held.append([left, right, start, i + 1])
    return [(r - l, int(a), int(b)) for l, r, a, b in held]


class Scorer:
    """Scores of words and pairs, and the calibrated law of their segments."""

    def __init__(self, snippets: list[tuple[str, bool]]) -> None:
        seeds = {unified(w).lower() for words in SEEDS.values() for w in words.split()}
        self.seeds = seeds
        self.folder = Folder(seeds)
        bad = Counter(w for t, b in snippets if b for w in set(self.folder(t)))
        fine = Counter(w for t, b in snippets if not b for w in set(self.folder(t)))
        self.folder = Folder(seeds | {w for w, n in bad.items() if len(w) > 2 and n > 1 and not fine[w]})
        self.snippets = [(self.folder(t), b) for t, b in snippets]
        self.vocabulary = sorted(seeds | {w for words, _ in self.snippets for w in words})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.number = {d: self.number[w] for d, w in self.folder.doubled.items() if w in self.number} | self.number

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words], np.int64)

    def fit(self, corpus: np.ndarray, words: int) -> Scorer:
        """``corpus``: how often each word of the vocabulary stands in the documents, of ``words`` in all."""
        size = len(self.vocabulary)
        met = {b: np.zeros(size) for b in (True, False)}
        pairs = {b: Counter() for b in (True, False)}
        for listed, b in self.snippets:
            i = self.ids(listed)
            np.add.at(met[b], i, 1)
            pairs[b].update(zip(i[:-1].tolist(), i[1:].tolist(), strict=True))
        share = (corpus + 0.5) / (words + 0.5 * size)
        bad = met[True] + np.array([SEED_COUNT * (w in self.seeds) for w in self.vocabulary])
        fine = met[False] + CORPUS * share  # the documents are mostly harmless, so they speak for that side
        odds = lambda y, prior: np.log((y + prior) / (y.sum() + PRIOR - y - prior + 1))
        value = odds(bad, PRIOR * share) - odds(fine, PRIOR * share)
        rare = np.array([n < 2 and w not in self.seeds for w, n in zip(self.vocabulary, met[True], strict=True)])
        value = np.where(rare, np.minimum(value, 0.5), value)  # met in one bad snippet only
        value = np.where([w in FUNCTION for w in self.vocabulary], np.minimum(value, 1.0), value)
        self.value = np.append(np.clip(value, -CLIP, CLIP) - DRIFT, -DRIFT)  # the last for unknown words
        nb, nf = sum(pairs[True].values()) + 1, sum(pairs[False].values()) + 1
        company = {}
        for (x, y), z in pairs[False].items():  # harmless company of a word that is bad elsewhere
            if z > 1 and x >= 0 and y >= 0:
                company[x * size + y] = float(np.clip(math.log((pairs[True][x, y] + 0.5) / nb) - math.log((z + 0.5) / nf), -PAIR_CLIP, 0))
        self.pair_codes = np.array([-1, *sorted(company)], np.int64)
        self.pair_values = np.array([0.0, *(company[c] for c in sorted(company))])
        return self.calibrate(corpus, words)

    def calibrate(self, corpus: np.ndarray, words: int) -> Scorer:
        p = np.append(corpus, max(words - corpus.sum(), 0)) + 1e-9
        p = p / p.sum()
        lo, hi = 1e-3, 5.0
        for _ in range(60):  # the root is the rate at which long chance segments become rare
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if float((p * np.exp(mid * self.value)).sum()) < 1 else (lo, mid)
        self.rate = lo
        self.place = 0.0
        fine = np.array([self.rating(w) for w, b in self.snippets if not b] or [0.0])
        self.place = float(fine.mean()) - 0.5772
        fine = fine - self.place
        bad = np.array([self.rating(w) for w, b in self.snippets if b] or [12.0])
        # the cut: the fewest errors on snippets, a fifth into the range where they are fewest, as bad forms unseen there score lower
        cuts = np.unique(np.concatenate([fine, bad, [float(fine.max()) + 0.5]]))
        errors = [(fine >= c).sum() + (bad < c).sum() for c in cuts]
        best = np.flatnonzero(errors == np.min(errors))
        low = cuts[best[0] - 1] if best[0] else cuts[best[0]] - 1
        self.cut = max(LEAST_CUT, float(low + (cuts[best[-1]] - low) / 5))
        return self

    def scores(self, words: list[str]) -> np.ndarray:
        i = self.ids(words)
        s = self.value[i].copy()
        codes = i[:-1] * len(self.vocabulary) + i[1:]
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        met = np.flatnonzero(self.pair_codes[at] == codes)
        s[met + 1] += self.pair_values[at[met]]
        return s

    def rating(self, words: list[str], found: list | None = None) -> float:
        """The negative log of the chance of the best segment; ``found`` gets all segments."""
        if not words:
            return 0.0
        every = segments(self.scores(words).tolist())
        if found is not None:
            found += every
        return self.rate * max((s for s, _, _ in every), default=0.0) - math.log(len(words)) - self.place


def counted(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    total, words = np.zeros(len(scorer.vocabulary) + 1, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                i = scorer.ids(scorer.folder.split(plain(text)))  # disguised words are too few to matter here
                words += len(i)
                total += np.bincount(i[i >= 0], minlength=len(total))
    total[-1] = words
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["word", "n"])


def rated(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, passages = [], []
        for text in batch.column(1).to_pylist():
            words, found = scorer.folder.words(text) if text else [], []
            score = scorer.rating(words, found)
            least = scorer.cut + scorer.place + math.log(max(len(words), 1))
            scores.append(round(score, 4) if words else 0.0)
            passages.append(sum(scorer.rate * s >= least for s, _, _ in found))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:1], *batch.columns[2:], pa.array(scores, pa.float64()), pa.array(passages, pa.int32())], [*batch.schema.names[:1], *batch.schema.names[2:], "score", "passages"]
        )


def rate_rows(docs: DataFrame, key: str, text: str, labels: DataFrame, keep: tuple[str, ...] = (), label_text: str = "text", label: str = "label") -> DataFrame:
    """``key, *keep, score, passages`` of every document; ``passages`` counts the segments beyond the threshold."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin("none", *BAD) & F.col(label_text).isNotNull()).select(F.col(label_text).alias("t"), F.col(label).alias("l"))
    rows = bounded_sample(known, MOST_LABELS).toPandas()
    scorer = Scorer([(t, x in BAD) for t, x in zip(rows["t"], rows["l"], strict=True)])
    sent = spark.sparkContext.broadcast(scorer)
    counts = docs.select(text).mapInArrow(lambda it: counted(it, sent.value), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    corpus = np.zeros(len(scorer.vocabulary) + 1)
    for r in counts.toLocalIterator():
        corpus[r.word] = r.n
    model = spark.sparkContext.broadcast(scorer.fit(corpus[:-1], int(corpus[-1])))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(key, text, *keep).mapInArrow(lambda it: rated(it, model.value), f"{fields}, score double, passages int")


def source_rates(rated_rows: DataFrame, source: str) -> DataFrame:
    """``source, documents, abusive, rate`` over all documents."""
    hit = F.count_if(F.col("passages") > 0)
    return rated_rows.groupBy(source).agg(F.count("*").alias("documents"), hit.alias("abusive"), F.round(hit / F.count("*"), 4).alias("rate"))
