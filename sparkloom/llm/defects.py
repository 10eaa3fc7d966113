"""Problem 3: prompt and response pairs that are broken, each with its type of defect.

* ``other_language``: the language posteriors of prompt and response, by naive Bayes over
  hashed character n-grams of their words. It is fitted on at most ``LANGUAGE_ROWS``
  labelled rows, chosen by hash, whose labels may be partly wrong. Names of code are left out.
* ``truncated``: the likelihood that a text ends after its last words, from exact counts over
  all texts of how often each run of up to four words is met and how often it ends a line,
  sentence or text. Only runs that end an undecided text are counted: a Bloom filter of those
  runs, of bounded size, goes to the counting tasks, so that they send no others to the
  shuffle; a run it lets through by chance is dropped by the join. Undecided pairs meet the
  counts in joins, so nothing that grows with the corpus reaches the driver.
  A text's own end counts once for all its copies: equal texts are one, and near copies
  with one last word, met by ``BANDS`` bands of least hashes, share one count. Of the classes
  that end with a run, ``OWN`` or, where that is more, ``OWN_SHARE`` of all classes without a
  stop say no more than shorter runs do: cuts alike grow with the corpus, so a fixed number
  would let them vouch for each other. A word that begins a longer one counts there as met
  and going on.
* ``copied``: at most ``SPARE`` words lie outside the longest run the response shares with
  the prompt's title or text, or every line is such a run. Below three words the response
  must be the title; text without blanks counts by characters.
* ``refusal`` and ``empty`` by their wording; a reply that goes on to answer is sound.

Null and blank responses are ``empty``; a null title or text is an empty prompt, which has
no language and nothing to copy. Repeated rows come out once; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, materialize, splitmix
from .lookalike import unified

LANGUAGE_ROWS, NGRAM_BUCKETS, WORDS_KEPT, RUNS_KEPT, PLACES = 4000, 1 << 16, 200_000, 2_000_000, 1 << 17
FILTER_BITS, MOST_FILTER_BITS = 32, 27  # of the Bloom filter: for each run, and the exponent of its greatest size
LEAST_END, PRIOR, SPARE, MARGIN, REPEATS = 0.04, 4.0, 2, 6.0, 3
BANDS, BAND_ROWS, OWN, OWN_SHARE = 16, 4, 3, 0.002

# Stand-ins for text, and wordings of refusals and of what may follow them.
STAND_INS = frozenset("n a|na|none|no response|no text|empty|null|nil|nothing|no answer|no content|no description|no comment|tbd|todo|deleted|removed|blank|no reply|not provided|no description provided|keine antwort|sin respuesta|sans réponse|sem resposta|нет ответа|なし".split("|"))
REFUSAL = re.compile(
    r"(?ix)"
    r"(?:can(?:no|['’])?t|cannot|won['’]t|will\s+not|unable\s+to|not\s+able\s+to|not\s+allowed\s+to|not\s+permitted\s+to|must\s+decline|decline(?:\s+to|\s+the)|(?:would|['’]d)\s+rather\s+not|inappropriate\s+(?:for\s+me\s+)?to|(?:do|does)\s+not\s+allow\s+me\s+to|forbid\w*\s+me\s+to|not\s+going\s+to|have\s+to\s+refuse|must\s+refuse|refuse\s+to|not\s+comfortable|not\s+something\s+I\s+(?:can|may|am|will)|no\s+comment)"
    r"(?:[^.!?\n]{0,40}?\b(?:answer\w*|help\w*|assist\w*|comment|discuss\w*|explain\w*|guidance|advi[cs]e|describ\w*|share|post|fulfil\w*|say\s+anything|provide|write\s+down|respond|reply|talk\s+about|tell|disclose|request|completed|do|from\s+me)\b)?"
)
REFUSED = re.compile(r"(?i)\b(?:answer\w*|help|assist\w*|comment|discuss\w*|explain\w*|guidance|advi[cs]e|describ\w*|share|post|fulfil\w*|say anything|write down|respond|reply|disclose|request)\b|no text from me")
REFUSED_ELSEWHERE = re.compile(r"(?i)no puedo (?:ayudar|responder|contestar)|(?:kann|darf|möchte)\b[^.!?]{0,60}\bnicht\b[^.!?]{0,30}(?:helfen|beantworten|antworten|sagen)|ne (?:peux|puis) pas\b[^.!?]{0,30}(?:aider|répondre)|não posso (?:ajudar|responder)|не (?:могу|буду)\b[^.!?]{0,20}(?:помочь|ответить|отвечать)|(?:お答え|お手伝い|回答)(?:は)?(?:でき|致しかね)")
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
COURTESY = 14  # words
STAND_IN_WORDS = max(len(x.split()) for x in STAND_INS)

TOKEN = re.compile(r"[^\W\d]\w*|\+?\d[\d ()/.-]{5,}\d|\d+(?:\.\d+)*|[^\w\s]|\n")
DATA_TOKEN = re.compile(r"\w+://\S+|[\w.+-]+@[\w.-]*\w|" + TOKEN.pattern)
LETTER = re.compile(r"\s[a-wyzа-я]$")
MOOD = re.compile(r"\s+(?:[:;]-?[()DP]|;)$")
LABEL = re.compile(r"(?:^|[.!?][ ]+)[ >*+\t-]*[A-Za-z]+(?: [a-z]+)? ?[:=] ?(?=\S)")
DATUM = re.compile(r"""["'(\[]*(?:[A-Z0-9+#@(]|at\b|dot\b|rue\b|bis\b)|.*[@\d]""")
SPELLED_AT, SPELLED_DOT = re.compile(r"(?i)[\[( ]at[\]) ]"), re.compile(r"(?i)\bdot\b")
CLOSING = re.compile(r"(?:[Cc]c|[Rr]egards|[Tt]hanks(?: in advance)?|[Cc]heers|[Bb]est(?: \w+)?|[Ss]incerely|[Yy]ours)[,!.:]* +(?=[A-ZÀ-Þ])")
WORD = re.compile(r"\w+")
CAMEL = re.compile(r"[A-Z]+[a-z0-9]+\w*[A-Z]\w*|[a-z]+[A-Z]\w*")
LETTERS = re.compile(r"(?<![\w/.@_-])[^\W\d_]+(?![\w/@_-])")
KANA = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+")
STOPS = frozenset(".!?…。！？")


LOWER, UPPER, MIXED = (np.uint64(xxhash.xxh3_64_intdigest("\0" + x)) for x in ("xx", "Xx", "CxC"))


def shape(token: str) -> str:
    if len(token) > 2 and not token.isidentifier():
        if "://" in token:
            return "://"
        if "@" in token:
            return "@"
        if len(token) > 6 and token[-1].isdigit() and not token[0].isalpha():
            return "#"
    if token[0].isdigit():
        return "0"
    if not (token[0].isalpha() or token[0] == "_"):
        return token
    if "_" in token.strip("_"):
        return "s_x_" if token[-1] == "_" else "s_x"
    if CAMEL.fullmatch(token):
        return "CxC"
    return ""


class Tokens:
    """Tokens of texts as numbers of a table that is remembered up to a fixed size."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((4, WORDS_KEPT * 2), np.uint64)  # word, shape, 2 for a line feed and 1 for a stop, and 1 for a capital
        self.add("\0")  # number 0 stands between texts

    def add(self, t: str) -> int:
        i = self.known[t] = len(self.known)
        if i >= self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        kind = shape(t)
        self.table[:, i] = (
            xxhash.xxh3_64_intdigest(kind or t.lower()),
            xxhash.xxh3_64_intdigest("\0" + (kind or ("Xx" if t[0].isupper() else "xx"))),
            3 if t == "\0" else 2 if t == "\n" else int(t in STOPS),
            int(t[0].isupper()),
        )
        return i

    def __call__(self, text: str) -> list[int]:
        found = (DATA_TOKEN if "@" in text or "://" in text else TOKEN).findall(text)
        known = self.known
        try:
            return [known[t] for t in found]
        except KeyError:
            return [known[t] if t in known else self.add(t) for t in found]


FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(k: np.ndarray, i: int) -> np.ndarray:
    return (k ^ (k >> np.uint64(29))) * FACTORS[i % 6] ^ np.uint64(i)


def by_words(w0: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> list[np.ndarray]:
    """Runs of one to four words, from the last word back."""
    a, b, c, _, e, f = FACTORS
    two = w0 * a + w1 * b
    return [mixed(k, i) for i, k in enumerate((w0 * e, two, two + w2 * c, two + w2 * c + w3 * f))]


def by_shape(f0: np.ndarray, f1: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> list[np.ndarray]:
    """Runs of one to three words, the last word or the last two by shape."""
    _, b, c, d, e, f = FACTORS
    seen = f0 * d
    return [mixed(k, 4 + i) for i, k in enumerate((seen, seen + w1 * b, seen + f1 * f + w2 * c, seen + w1 * e + w2 * c))]


def end_runs(ids: list[int], table: np.ndarray) -> list[list[int]]:
    """The runs a text ends with, short to long: by words, and where the last word is capitalised or no word also by shape."""
    last = np.array([0, 0, 0, *ids][-4:], np.int64)
    w, f = table[0, last][::-1], table[1, last][::-1]
    with np.errstate(over="ignore"):
        groups = [by_words(*w[:, None])] + ([] if f[0] == LOWER else [by_shape(f[:1], f[1:2], w[1:2], w[2:3])])
    return [[int(k.view(np.int64)[0]) for k in g] for g in groups]


class Bloom:
    """Which runs are wanted: one bit each, so one that is wanted is never missed."""

    def __init__(self, power: int) -> None:
        self.power, self.words = power, np.zeros(1 << (power - 6), np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.power)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bloom_of(runs: DataFrame) -> Bloom:
    """Of distinct ``run``s; its bits are put together by the executors, and come as at most 2^(MOST_FILTER_BITS - 6) words."""
    power = min(MOST_FILTER_BITS, max(16, (runs.count() * FILTER_BITS).bit_length()))
    bloom = Bloom(power)
    at = F.shiftrightunsigned("run", 64 - power)
    word = runs.select(F.shiftright(at, 6).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
    made = word.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()
    bloom.words[made["word"].to_numpy()] = made["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return bloom


class Beginnings:
    """The words that each known token begins with and goes on from, where their runs of one word are wanted."""

    def __init__(self, bloom: Bloom) -> None:
        self.bloom = bloom
        self.clear()

    def clear(self) -> None:
        self.first, self.many = np.zeros((2, 0), np.int64)  # of each token, in ``words``
        self.words = np.zeros(0, np.uint64)

    def learn(self, tokens: Tokens) -> None:
        """Of the tokens that came since; all words that begin a word are plain, those of a name of code up to its first mark."""
        words, owner = [], []
        for i, t in enumerate(islice(tokens.known, len(self.first), None)):
            if len(t) > 1 and t.isidentifier():
                plain = not shape(t)
                for size in range(1, len(t)):
                    if not plain and shape(t[:size]):
                        break
                    words.append(xxhash.xxh3_64_intdigest(t[:size].lower()))
                    owner.append(i)
        word, of = np.array(words, np.uint64), np.array(owner, np.int64)
        with np.errstate(over="ignore"):
            wanted = self.bloom.has(mixed(word * FACTORS[4], 0))
        many = np.bincount(of[wanted], minlength=len(tokens.known) - len(self.first))
        self.first = np.concatenate([self.first, len(self.words) + np.cumsum(many) - many])
        self.many = np.concatenate([self.many, many])
        self.words = np.concatenate([self.words, word[wanted]])

    def __call__(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place of ``at`` with the number in ``words`` of each word that begins the token there."""
        ids = flat[at]
        many = self.many[ids]
        before = np.cumsum(many) - many
        return np.repeat(at, many), np.repeat(self.first[ids] - before, many) + np.arange(many.sum())


def counted(batches: Iterator[pa.RecordBatch], bloom: Bloom) -> Iterator[pa.RecordBatch]:
    """``run, n, inside``: how often each wanted run is met and goes on, also within its last word, and how often it meets an end inside a text."""
    tokens, begins, parts, held = Tokens(), Beginnings(bloom), [], 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, e = (np.concatenate([p[i] for p in parts]) for i in range(3))
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n).astype(np.int64), np.bincount(at, e).astype(np.int64)

    def sent() -> pa.RecordBatch:
        keys, n, e = summed() if parts else (np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(e)], ["run", "n", "inside"])

    for batch in batches:
        texts = [unified(t).strip() for column in batch.columns for t in column.to_pylist() if t]
        for lo in range(0, len(texts), 2000):
            if len(tokens.known) > WORDS_KEPT:
                tokens.clear()
                begins.clear()
            ids = [0, 0, 0]
            for text in texts[lo : lo + 2000]:
                if text:
                    ids += tokens(text)
                    ids += (0, 0, 0)
            flat = np.array([*ids, 0], np.int64)
            kind = tokens.table[2, flat]
            at = np.flatnonzero((kind[3:-1] < 2) & (kind[4:] != 3)) + 3  # words that something follows
            word, form = tokens.table[0, flat], tokens.table[1, flat]
            with np.errstate(over="ignore"):
                wanted = at[bloom.has(by_words(word[at], word[at - 1], word[at - 2], word[at - 3])[0])]
                groups = [(wanted, by_words(word[wanted], word[wanted - 1], word[wanted - 2], word[wanted - 3]))]
                wanted = at[(form[at] != LOWER)]
                wanted = wanted[bloom.has(by_shape(form[wanted], form[wanted - 1], word[wanted - 1], word[wanted - 2])[0])]
                groups.append((wanted, by_shape(form[wanted], form[wanted - 1], word[wanted - 1], word[wanted - 2])))
            for where, keys in groups:
                after = kind[where + 1]
                end = ((after == 1) | (after == 2)).astype(np.int64)
                for k in keys:
                    some = bloom.has(k)
                    parts.append((k[some], np.ones(int(some.sum()), np.int64), end[some]))
                    held += len(parts[-1][0])
            begins.learn(tokens)
            times, begun = np.zeros(len(begins.words), np.int64), []
            with np.errstate(over="ignore"):
                for some in range(0, len(at), PLACES):
                    where, which = begins(flat, at[some : some + PLACES])
                    times += np.bincount(which, minlength=len(times))
                    first = begins.words[which]
                    wanted = bloom.has(mixed(first * FACTORS[0] + word[where - 1] * FACTORS[1], 1))  # the run of two
                    where, first = where[wanted], first[wanted]
                    begun.append(by_words(first, word[where - 1], word[where - 2], word[where - 3])[1:])
                met = np.flatnonzero(times)
                parts.append((mixed(begins.words[met] * FACTORS[4], 0), times[met], np.zeros_like(met)))
                held += len(met)
                where = at[(form[at] == MIXED) & (tokens.table[3, flat[at]] == 1)]  # a name of code begins with a capitalised word
                begun.append(by_shape(np.full(len(where), UPPER), form[where - 1], word[where - 1], word[where - 2]))
            for keys in begun:
                for k in keys:
                    k = k[bloom.has(k)]
                    parts.append((k, np.ones(len(k), np.int64), np.zeros(len(k), np.int64)))
                    held += len(k)
            if held > RUNS_KEPT:
                parts = [summed()]
                held = len(parts[0][0])
                if held > RUNS_KEPT // 2:
                    yield sent()
                    parts, held = [], 0
    yield sent()


BAND_FACTORS = splitmix(np.arange(BANDS * BAND_ROWS, dtype=np.uint64)) | np.uint64(1)


def tail_bands(ids: list[int], table: np.ndarray) -> np.ndarray:
    """Bands of the least hashes of a text's runs of three tokens, with its last token."""
    a, b, c, d = FACTORS[:4]
    word = table[0, [0, 0, *ids]]
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        run = np.unique(splitmix(word[2:] * a + word[1:-1] * b + word[:-2] * c))
        for lo in range(0, len(run), 4096):
            least = np.minimum(least, (run[lo : lo + 4096, None] * BAND_FACTORS).min(axis=0))
        rows = splitmix(least).reshape(BANDS, BAND_ROWS)
        return splitmix((rows * FACTORS[:BAND_ROWS]).sum(axis=1, dtype=np.uint64) + word[-1] * d + np.arange(BANDS, dtype=np.uint64))


def end_shares(tails: DataFrame) -> DataFrame:
    """``ends, share`` of each text of ``tails(id, bands, ends)``, so that each class of copies counts once."""
    held = materialize(tails.groupBy("id").agg(F.first("bands").alias("bands"), F.first("ends").alias("ends")), "tails")
    each = held.select("id", F.explode("bands").alias("band"))
    shared = materialize(each.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    size = each.join(shared, "band").groupBy("id").agg(F.max("size").alias("size"))
    return held.select("id", "ends").join(size, "id", "left").select("ends", (1 / F.coalesce("size", F.lit(1))).alias("share"))


def likelihood(counts: Column, own: float) -> Column:
    """The probability of an end after runs that go on ``n - inside`` times and end ``inside`` texts and at the ``last`` of them, short runs backing long ones and ``own`` of the last ends."""

    def after(p: Column, c: Column) -> Column:
        doubtful = F.least(c["last"], F.lit(own))
        return (c["inside"] + c["last"] - doubtful + (PRIOR + doubtful) * p) / (c["n"] + c["last"] + PRIOR)

    return F.aggregate(counts, F.lit(0.03), after)


def likely_ends(groups: DataFrame, threads: DataFrame, columns: list, tails: DataFrame) -> DataFrame:
    """``group, p``: the likelihood of an end after each of ``groups(runs)``, whose name is their longest run."""
    named = materialize(groups.select(F.element_at("runs", -1).alias("group"), "runs").dropDuplicates(["group"]), "groups")
    each = named.select("group", F.posexplode("runs").alias("pos", "run"))
    bloom = threads.sparkSession.sparkContext.broadcast(bloom_of(each.select("run").distinct()))
    met = threads.select(*columns).mapInArrow(lambda it: counted(it, bloom.value), "run bigint, n bigint, inside bigint").groupBy("run").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    shares = materialize(end_shares(tails), "shares")
    own = max(float(OWN), OWN_SHARE * (shares.agg(F.sum("share")).first()[0] or 0.0))
    last = shares.select(F.explode(F.flatten("ends")).alias("run"), "share").groupBy("run").agg(F.sum("share").alias("last"))
    none = F.lit(0).cast("bigint")
    both = met.select("run", "n", "inside", F.lit(0.0).alias("last")).unionByName(last.select("run", none.alias("n"), none.alias("inside"), "last"))
    names = ["n", "inside", "last"]
    total = materialize(both.groupBy("run").agg(*(F.sum(x).cast("double").alias(x) for x in names)), "ends")
    counts = each.join(total, "run", "left").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in names)))).alias("counts"))
    return counts.select("group", likelihood(F.col("counts"), own).alias("p"))


class Languages:
    """Naive Bayes over hashed character n-grams; a word's log likelihoods are remembered."""

    def __init__(self, texts: list[str], labels: list[str], least: int = 5) -> None:
        many = Counter(labels)
        self.names = sorted(k for k, v in many.items() if v >= least)
        counts = np.full((len(self.names), NGRAM_BUCKETS), 0.1)
        at = {k: i for i, k in enumerate(self.names)}
        by: dict[int, Counter] = defaultdict(Counter)
        for text, label in zip(texts, labels, strict=True):
            if label in at:
                by[at[label]].update(self.words(text))
        for i, words in by.items():
            for w, n in words.items():
                np.add.at(counts[i], self.grams(w), min(n, 1 + math.log(n) * 20))
        self.weights = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.names)), np.float32)

    def __getstate__(self) -> dict:
        return {"names": self.names, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.clear()

    @staticmethod
    def words(text: str) -> list[str]:
        found = [w.lower() for w in LETTERS.findall(text) if w.islower() or not CAMEL.fullmatch(w)]
        if KANA.search(text):  # no blanks between words there, so runs count by pairs of characters, and each pair for the script
            runs = KANA.findall(text)
            found = [w for w in found if not KANA.search(w)] + [w for r in runs for i in range(0, len(r), 2) for w in (r[i : i + 2], "ー")]
        return found

    @staticmethod
    def grams(word: str) -> np.ndarray:
        padded = f" {word} "
        return np.array([xxhash.xxh3_64_intdigest(padded[i : i + n]) % NGRAM_BUCKETS for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)], np.int64)

    def add(self, word: str) -> int:
        i = self.known[word] = len(self.known)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        s = self.weights[:, self.grams(word)].sum(axis=1) / 4
        self.rows[i] = np.maximum(s - s.max(), -6.0)
        return i

    def scores(self, text: str) -> np.ndarray:
        """The log likelihood of each language; four n-grams count as one observation, a word at most ``REPEATS`` times."""
        known = self.known
        if len(known) > WORDS_KEPT:
            self.clear()
            known = self.known
        ids = [known[w] if w in known else self.add(w) for w in self.words(text)]
        if not ids:
            return np.zeros(len(self.names), np.float32)
        which, times = np.unique(ids, return_counts=True)
        return np.minimum(times, REPEATS) @ self.rows[which]


def is_field(text: str) -> bool:
    """Whether the text's last line ends as a field with data in it, or as a name under a closing formula."""
    line = text.rsplit("\n", 1)[-1]
    label = None
    for label in LABEL.finditer(line):
        pass
    if label and all(DATUM.match(w) for w in line[label.end() :].split()):
        return True
    if label and (spelled := SPELLED_AT.search(line, label.end())) and SPELLED_DOT.search(line, spelled.end()):
        return True
    formula = None
    for formula in CLOSING.finditer(line):
        pass
    words = line[formula.end() :].split() if formula else []
    return 0 < len(words) < 5 and all(w[0].isupper() for w in words)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(unified(text).casefold()) if text else []


def shared_run(part: list[str], whole: str) -> int:
    """The most words of ``part``, taken in a row, that stand in a row in ``whole``, words set off by NUL; 0 below ``len(part) - SPARE``."""
    size = len(part)
    run = lambda lo, hi: "\0" + "\0".join(part[lo:hi]) + "\0"
    if size > 2 * SPARE and run(SPARE, min(size - SPARE, SPARE + 8)) not in whole:
        return 0
    for length in range(size, max(0, size - SPARE - 1), -1):
        if any(run(i, i + length) in whole for i in range(size - length + 1)):
            return length
    return 0


def is_empty(text: str | None) -> bool:
    """Blank, without any word, or a stand-in; the longest stand-in has ``STAND_IN_WORDS`` words, so no more are looked at."""
    if not text or text.isspace():
        return True
    first = [m[0] for m in islice(WORD.finditer(text), STAND_IN_WORDS + 1)]
    return not first or len(first) <= STAND_IN_WORDS and " ".join(words_of(text)) in STAND_INS


def is_refusal(text: str) -> bool:
    """Whether sentences decline and the different others, together, say no more than a courtesy does."""
    rest, refused, met = 0, False, set()
    for p in SENTENCE.split(text.strip()):
        if not p.strip() or (same := p.strip().casefold()) in met:
            continue
        met.add(same)
        m = REFUSAL.search(p)
        goes_on = m and re.search(r"(?i)[,;] (?:but|however|yet)\b", p[m.start() :])
        if (m and (m[0].lower().startswith("no comment") or REFUSED.search(p)) and not goes_on) or REFUSED_ELSEWHERE.search(p):
            refused = True
            continue
        rest += len(WORD.findall(p))
        if rest > COURTESY:
            return False
    return refused


class Text:
    """A text with what several tests need of it, each worked out once."""

    def __init__(self, raw: str | None) -> None:
        self.raw, self.made = raw, {}

    @property
    def flat(self) -> str:
        if "flat" not in self.made:
            self.made["flat"] = unified(self.raw).strip() if self.raw else ""
        return self.made["flat"]

    @property
    def words(self) -> list[str]:
        if "words" not in self.made:
            self.made["words"] = WORD.findall(self.flat.casefold())
        return self.made["words"]

    @property
    def chain(self) -> str:
        if "chain" not in self.made:
            self.made["chain"] = "\0" + "\0".join(self.words) + "\0"
        return self.made["chain"]

    def scores(self, languages: Languages) -> np.ndarray:
        if "scores" not in self.made:
            self.made["scores"] = languages.scores(self.flat)
        return self.made["scores"]


def judge(copies: list[Text], response: Text, speaks: Text, tokens: Tokens, languages: Languages | None) -> str | list[list[int]] | None:
    """The defect of one pair, or the runs whose likelihood of an end decides; ``speaks`` is the text whose language the response must share."""
    if is_empty(response.raw):
        return "empty"
    text, said = response.flat, response.words
    for c in copies:
        if len(said) >= 3 and len(c.words) >= len(said) - SPARE and len(said) - shared_run(said, c.chain) <= min(SPARE, len(said) // 3):
            return "copied"
    if said and len(said) < 3 and said == copies[0].words:
        return "copied"  # too short for runs: the whole title
    if KANA.search(text):  # no blanks between words there, so characters count, about three to a word
        flat, wholes = "".join(said), ["".join(c.words) for c in copies]
        if flat == wholes[0] or len(flat) >= 9 and any(flat[i : len(flat) - j] in w for w in wholes for i in range(SPARE + 1) for j in range(SPARE + 1 - i)):
            return "copied"
    lines = [WORD.findall(x) for x in text.casefold().split("\n")]
    if len(said) >= 3 and any(len(x) >= 3 for x in lines) and all(any(shared_run(x, c.chain) == len(x) for c in copies) for x in lines if x):
        return "copied"  # put together from whole stretches, or the title again and again
    if is_refusal(text):
        return "refusal"
    if languages is not None and not is_empty(speaks.raw):
        a, b = speaks.scores(languages), response.scores(languages)
        i, j = int(np.argmax(a)), int(np.argmax(b))
        if i != j and a[i] - a[j] >= MARGIN / 2 and b[j] - b[i] >= MARGIN:
            return "other_language"
    groups: list[list[int]] = []
    for t in {text, MOOD.sub("", text)}:
        if t[-1:] in STOPS or is_field(t) or not (ids := tokens(t)):
            return None
        if not LETTER.search(t):  # else a word cut after its first letter
            groups += end_runs(ids, tokens.table)
    return groups or "truncated"


JUDGED = "pair string, defect string, ends array<array<bigint>>, id bigint, bands array<bigint>"


def judged(batches: Iterator[pa.RecordBatch], languages: Languages | None) -> Iterator[pa.RecordBatch]:
    """A row for each pair that is defective or undecided, and one without ``pair`` for each text that does not end with a stop."""
    tokens, met = Tokens(), set()
    for batch in batches:
        rows: list[tuple] = []
        for i, (title, text, answered, reply) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            if len(tokens.known) > WORDS_KEPT:
                tokens.clear()
            if len(met) > RUNS_KEPT:
                met.clear()
            head, body, said = Text(title), Text(text), Text(reply)
            cases = [("question", [head], body, head)]
            if answered:
                cases.append(("answer", [head, body], said, body))
            for pair, copies, response, speaks in cases:
                defect = judge(copies, response, speaks, tokens, languages)
                if defect:
                    rows.append((i, pair, None, defect, None, None) if isinstance(defect, list) else (i, pair, defect, None, None, None))
            for t in (body.flat, said.flat):
                if not t or t[-1] in STOPS and "://" not in t.rsplit(None, 1)[-1] or (name := xxhash.xxh3_64_intdigest(t)) in met or not (ids := tokens(t)):
                    continue
                met.add(name)
                rows.append((i, None, None, end_runs(ids, tokens.table), int(np.uint64(name).view(np.int64)), tail_bands(ids, tokens.table).view(np.int64).tolist()))
        at, pairs, defects, ends, names, bands = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pairs, pa.string()), pa.array(defects, pa.string()), pa.array(ends, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["key", "pair", "defect", "ends", "id", "bands"],
        )


def relabelled(texts: list[str], labels: list[str], times: int = 2) -> Languages | None:
    """A model of the given labels, then of its own: labels that the texts speak against lose their say."""
    model = Languages(texts, labels)
    for _ in range(times):
        if len(model.names) < 2:
            return None
        model = Languages(texts, [model.names[int(np.argmax(model.scores(t)))] for t in texts])
    return model if len(model.names) > 1 else None


def fit_languages(labelled: DataFrame, text: str, label: str, most: int = LANGUAGE_ROWS) -> Languages | None:
    rows = labelled.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(text).alias("t"), F.lower(F.trim(label)).alias("l"))
    held = bounded_sample(rows, most).toPandas()
    texts = [unified(t) for t in held["t"]]
    return relabelled(texts, list(held["l"]))


def broken_pairs(threads: DataFrame, key: str, labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """``key, pair, defect`` of every defective pair of ``threads`` (``title, body_text, answered, answer.body_text``)."""
    spark, kind = threads.sparkSession, threads.schema[key].dataType.simpleString()
    reply = F.col("answer.body_text").alias("reply")
    model = spark.sparkContext.broadcast(fit_languages(labelled, text, label))
    seen = threads.select(key, "title", "body_text", "answered", reply).mapInArrow(lambda it: judged(it, model.value), f"key {kind}, {JUDGED}")
    seen = materialize(seen, "pairs")
    cases, tails = seen.where("pair IS NOT NULL"), seen.where("pair IS NULL").select("id", "bands", "ends")
    undecided = cases.where("defect IS NULL").select("key", "pair", "ends").distinct()
    likely = likely_ends(undecided.select(F.explode("ends").alias("runs")), threads, [F.col("body_text"), reply], tails)
    ends = undecided.select("key", "pair", "ends", F.explode(F.transform("ends", lambda r: F.element_at(r, -1))).alias("group")).join(likely, "group")
    cut = ends.groupBy("key", "pair", "ends").agg(F.max("p").alias("p")).where(F.col("p") < LEAST_END)
    made = cases.where("defect IS NOT NULL").select("key", "pair", "defect").unionByName(cut.select("key", "pair", F.lit("truncated").alias("defect")))
    return made.withColumnRenamed("key", key).distinct()
