"""Problem 2: personal data in free text, found and replaced by typed placeholders.

1. Generators with high recall propose overlapping spans of five types.
2. Each span is described by its format (digits, groups, signs, case) and its context
   (cue words before and after it, the characters next to it).
3. Boosted trees score the spans. They are trained on the driver from ``TRAINING`` sentences
   of a grammar (``carriers``) whose words are put together at random, half of them with
   look-alikes; no sentence of a corpus is used. An e-mail address is judged by its format
   and its neighbours only, not by the words around it.
4. Scores are calibrated on sentences the trees have not seen; each type's threshold is the
   one that gave the best F1 there. Of overlapping spans the most probable, then longest, wins.

A null text gives null and no items, a blank text itself. Lines end at each line feed.
Invisible characters and look-alike letters inside an item are seen through. Repeated
rows come out once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .carriers import BOTS, CUES, DOES, MEETS, ROLES, STAMPS, Grammar
from .lookalike import python_table

TYPES = ("email", "phone", "id_number", "address", "name")
TRAINING = 9000

# Given names, street words and cue words.
GIVEN = frozenset(
    "ada adam aisha alan alex alice amara amina ana anders andrea anna anton arjun astrid aylin ben bianca boris bram carla carlos carmen cecilia chloe claire clara daniel dario david diego dmitri edith elena elif elin emeka emil emily emma erik eva fatima felix fiona francesca frida george giulia greta hana hans hassan helena henrik hugo ian ida ines ingrid irina isabel ivan ivo jakob james jan jane john jonas jose juan julia kai karin keiko kenji lara lars laura lea leila lena leo leon lin linus lucas lucia luis maja marco maria marie marta martin mary mateo matteo maya mehmet mei mia michael mila mohamed nadia naomi nina noah noemi nora oleg olga oliver omar oscar oskar otto owen pablo paul paula pedro peter petra pia pierre priya rafael rahul robert rosa ruben ruth samir sara sarah sofia stefan sven tamsin tara theo thomas tomas vera viktor walter yara yusuf zofia ahmed ali amy ann brian bruno charles chris dave elisa frank grace hannah henry hiroshi jack jessica joe joseph karen kate kevin kwame lisa lucy marcus mark max mike nancy natasha nick olivia patrick rob ryan sam simon sophie steve susan tim tobias tom wei wendy yuki zoe".split()
)
STREETS = "Street St Road Rd Lane Ln Avenue Ave Close Court Ct Drive Dr Boulevard Blvd Way Place Pl Square Sq Terrace Crescent Grove Row Hill Gardens Mews Parkway Highway Walk".split()
BEFORE = {
    "phone": [*CUES[1], "handy", "téléphone", "телефон", "電話"],
    "id_number": "passport ssn social security tax id card identity national person_id insurance licence license nino dni nie tin nif steuer taxpayer citizen pesel cpf personal person reisepass ausweis pasaporte passeport паспорт инн снилс".split(),
    "address": [*CUES[3], "sit", "street", "addr", "адрес"],
    "sign": "regards thanks cheers best sincerely greetings advance yours wishes love cc thx grüße gruß saludos cordialement merci gracias obrigado спасибо уважением".split(),
    "role": [*ROLES, "name", "named", "dear", "hi", "hello", "called", "author", "signed", "reviewer", "cc"],
    "met": [*MEETS, "as", "am", "ask", "spoke"],
    "off": [*STAMPS, "dump", "id", "box", "built", "build", "hash", "sha", "rev", "v", "route", "listens", "took", "pinned"],
}
AFTER = {
    "name": [*DOES, "from", "who", "and", "last", "if", "here", "team"],
    "off": "took ms kb by port listens with seconds step percent calls workers rows entries".split(),
}
STARTERS = frozenset(
    "a above across after against all along also although always among an and any are around as at auf because before behind below besides best between both but by call can cc changing cheers commit contact could dear deliver der depuis description did die despite do does during each either el en every except expected fax flat for from global great hello here hi how i id if in is it its la last le les let mail many may more most mr mrs ms my need no not note now of on once only or our out passport phone please que regards reach reviewed running same seit ship sincerely so social some sometimes since sorry sous still tel thank thanks that the their then there these they this though through to toward trace try under unless until use user using we via what when where whether which while who why with within without would yes you your "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday windows linux macos debian alpine ubuntu docker python java".split()
)

NAME = r"(?:[A-ZÀ-ÖØ-Þ]['’])?(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{2,}(?:[-'’][A-ZÀ-ÖØ-Þ]+)*)(?![\w])"
GAP = r"[ \t]+"
FULL = re.compile(rf"(?<![\w@.\\/-]){NAME}(?:(?:,?{GAP})(?:[A-Z]\.(?:[A-Z]\.)*{GAP})?{NAME}|{GAP}[A-Z]\.(?={GAP}?[,\n]|$)){{1,4}}(?:[ \t]+[A-Z]\.(?!\w))?")
CLOSINGS = "regards|thanks in advance|thanks|cheers|best|best wishes|sincerely|yours|greetings|thx|cc|saludos|grüße|gruße|cordialement|merci|gracias|obrigado|obrigada"
SINGLE = re.compile(rf"(?:(?i:{CLOSINGS})[,!.:]*\s{{1,4}}[>* \t-]*|^[> \t]*(?:--|[–—])[ ]?)(?P<name>{NAME})(?=[ \t]*(?:[\r\n<\\.]|$|[ ]))", re.M)
WORD = re.compile(r"\w[\w'’-]*")
LOCAL = r"(?<![\w.+/:@-])[A-Za-z0-9](?:[A-Za-z0-9_+%-]|\\_|\.(?=[A-Za-z0-9]))*"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
DOT = r"[ ]?[(\[{][ ]?(?i:dot|\.)[ ]?[)\]}][ ]?|[ ](?:DOT|dot)[ ]"
EMAIL = re.compile(
    rf"{LOCAL}(?:@|[ ]?[(\[{{<][ ]?(?i:at|@)[ ]?[)\]}}>][ ]?){LABEL}(?:(?:\.|{DOT}){LABEL})+(?![\w@])"
    rf"|{LOCAL}[ ](?:AT|at|@)[ ]{LABEL}(?:(?:{DOT}){LABEL})+(?![\w@])"
)
# What every match of EMAIL or SINGLE holds, looked for first as it costs less.
AT = re.compile(rf"@|[(\[{{<][ ]?(?i:at)[ ]?[)\]}}>]|[ ](?:AT|at)[ ]{LABEL}(?:{DOT})")
SIGNED = ("--", "–", "—", *(w.casefold() for w in CLOSINGS.split("|")))
DIGITS = re.compile(r"(?<![\w.@/\\#-])(?:\+|\(\+?)?\d(?:[ \t().‑/-]{0,2}\d){5,16}(?:,?[ ]?(?:ext\.?|extension|x|Durchwahl)[ ]?\d{1,5})?(?![\w@])")
IDENT = re.compile(r"(?<![\w.@/\\#-])(?=[A-Z0-9 .-]{0,6}\d)(?:[A-Z]{1,3}[- ]?)?\d(?:[-. /]?[0-9]){4,14}(?:[- ]?[A-Z]{1,2})?(?![\w@])")
LEAD = re.compile(r"[A-Z]{2,3}[ ](?=\d)")
CAPITAL_BEFORE = re.compile(r"(?<![\w.!?])([A-ZÀ-Þ][\w'’-]*\.?)[ ]$")
PLACE = rf"[A-ZÀ-Þ][\w'’-]*(?:[ ][A-ZÀ-Þ][\w'’-]*){{0,2}}"
TOWN = rf"(?:,?[ ](?:\d{{4,6}}[ ]{PLACE}|{PLACE}[ ](?:[A-Z]{{2}}[ ])?\d{{4,6}}|{PLACE}(?![ ]?\d)))"
UNIT = r"(?:,?[ ](?:Apt|Apartment|Unit|Suite|Flat|Floor|No)\.?[ ]?#?\d+[A-Za-z]?)"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt|Apartment|Unit|Suite)\.?[ ]?\d+[A-Za-z]?,?[ ])?\d{{1,5}}[A-Za-z]?,?[ ]{PLACE}(?<![ ])(?:{UNIT})?(?:{TOWN})?"
    rf"|(?<![\w-])\d{{1,5}}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)[ ](?:(?:de|du|des|la|le|l')[ ]?)*{PLACE}(?:{TOWN})?"
    rf"|(?<!\w)(?:Calle|Avenida|Av\.|Plaza|Paseo|Via|Rua|Rue|Piazza|Viale)[ ](?:(?:de|del|da|do|la|las|los)[ ])*{PLACE},?[ ](?:n[ºo.]?[ ]?)?\d{{1,5}}[A-Za-z]?(?:{TOWN})?"
    rf"|(?<!\w)(?:[A-ZÄÖÜ][\w-]*[ ])?[A-ZÄÖÜ][\w-]*(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|weg|gasse|platz|allee|damm|ring|ufer|[ ]Stra(?:ß|ss)e|[ ]Weg|[ ]Platz)[ ]\d{{1,4}}[a-z]?(?:{TOWN})?"
    rf"|(?<!\w)(?:ул|пр|пер)\.?[ ][А-ЯЁ][а-яё-]+,?[ ](?:д\.?[ ]?)?\d{{1,4}}"
)
STREET = re.compile(rf"\b(?:{'|'.join(STREETS)})\b")
FOREIGN = re.compile(r"\b(?:Calle|Avenida|Av\.|Plaza|Paseo|Via|Rua|[Rr]ue|Piazza|Viale|avenue|boulevard|chemin|allée|quai|ул|пр|пер)\b|(?:stra(?:ß|ss)e|Stra(?:ß|ss)e|[Ss]tr\.|weg|Weg|gasse|platz|Platz|allee|damm|ring|ufer)[ ]\d")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``type, start, end`` of every proposed span."""
    found: list[tuple[int, int, int]] = []
    if AT.search(text):
        found += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    for m in DIGITS.finditer(text):
        if 7 <= sum(c.isdigit() for c in m[0]) <= 17:
            found.append((1, m.start(), m.end()))
    for m in IDENT.finditer(text):
        if 6 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((2, m.start(), m.end()))
            if lead := LEAD.match(m[0]):  # capitals that may be a label
                found.append((2, m.start() + lead.end(), m.end()))
    if STREET.search(text) or FOREIGN.search(text):
        found += [(3, m.start(), m.end()) for m in ADDRESS.finditer(text) if STREET.search(m[0]) or FOREIGN.search(m[0])]
    for m in FULL.finditer(text):
        part: list[re.Match] = []
        for w in [*WORD.finditer(text, *m.span()), None]:
            if w is not None and (len(w[0]) == 1 and w[0].isupper() and part or w[0].lower() not in STARTERS):
                part.append(w)
                continue
            if len(part) > 1 and sum(len(x[0]) > 1 for x in part) > 1:
                for a, b in {(0, len(part)), (max(0, len(part) - 2), len(part)), (0, 2)}:
                    found.append((4, part[a].start(), part[b - 1].end()))
            part = []
    folded = text.casefold()
    for m in SINGLE.finditer(text) if any(w in folded for w in SIGNED) else ():
        if m["name"].lower() not in STARTERS:
            found.append((4, m.start("name"), m.end("name")))
    return found


BEFORE_SETS = [frozenset(BEFORE[k]) for k in ("phone", "id_number", "address", "sign", "role", "met", "off")]
AFTER_SETS = [frozenset(AFTER[k]) for k in ("name", "off")]
SIGNS = {"\r": 1} | {c: i + 1 for i, c in enumerate("\n :\"'=,;/.!>-(@#_|[{<\\")}


UPPER_END = re.compile(r"\b[A-Z_]{2,}\W*$")


SERVICE = re.compile(rf"(?i)^(?:{'|'.join(BOTS)}|(?:svc|bot|git|ci|sys|build|deploy)(?![a-z])|(?:no|do)-?(?:not)?-?reply)|-(?:bot|job|runner|svc)@")
INSIDE = re.compile(r"(?i)(?:^|\.)(?:localhost|internal|local|lan|intranet|svc|cluster)$")


def features(text: str, kind: int, lo: int, hi: int) -> list[int]:
    span = text[lo:hi]
    groups = re.findall(r"\d+", span)
    digits = sum(map(len, groups))
    letters = sum(c.isalpha() for c in span)
    head, tail = text[max(0, lo - 70) : lo], text[hi : hi + 50]
    line = head.rsplit("\n", 1)[-1]
    sentence = re.split(r"(?<!\b[Nn]o)[.!?][)\"'»]*\s", line)[-1] if kind else ""  # an address of mail is judged by its form
    before = [w.lower() for w in WORD.findall(sentence)][-6:]
    last = before[-1] if before else ""
    after = [w.lower() for w in WORD.findall(tail.split("\n", 1)[0])][:3] if kind else []
    words = WORD.findall(span)
    lower = [w.lower() for w in words]
    signed = bool(re.search(r"(?i)(?:regards|thanks in advance|thanks|cheers|best|wishes|sincerely|yours|greetings|thx|gr[üu]ße|saludos|cordialement|merci)[,!.]*\s*[>*+:|\\ \t-]*(?:item )?$", head))
    x = [int(kind == i) for i in range(5)]
    x += [digits, min(letters, 16), min(len(span) // 3, 16), len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0]
    x += [span.count("."), span.count("-"), span.count(" "), span.count("/"), int(span[:1] == "+"), int(span[:1] == "0"), int("(" in span), int("@" in span), int(span.isupper()), int(span[:1].isalpha()), int(span[-1:].isalpha())]
    x += [SIGNS.get(text[lo - 1 : lo], 0) if lo else 16, SIGNS.get(text[hi : hi + 1], 0) if hi < len(text) else 16]
    x += [int(any(w in s for w in before)) for s in BEFORE_SETS]
    x += [int(last in s) for s in BEFORE_SETS[:2] + BEFORE_SETS[3:]]
    x += [int(any(w in s for w in after[: 1 + i])) for i, s in enumerate(AFTER_SETS)]
    x += [sum(w in GIVEN for w in lower), int(lower[:1] != [] and lower[0] in GIVEN), len(words), int("," in span), int(bool(re.search(r"\b[A-Z]\.", span))), sum(w in STARTERS for w in lower), int(signed)]
    x += [int(bool(STREET.search(span))), int(bool(FOREIGN.search(span))), int(not line.strip(" \t>*+-:|") and (not tail or tail[0] in "\r\n"))]
    x += [int("ext" in span), int(tail.startswith("'s ")), int(lower[:1] != [] and lower[0] in BEFORE_SETS[1])]
    ahead = CAPITAL_BEFORE.search(head) if kind == 4 else None
    x += [int(kind == 4 and tail[:1] == " " and tail[1:2].isupper() and after[:1] != [] and after[0] not in STARTERS), int(ahead is not None), int(ahead is not None and ahead[1].lower() in GIVEN), int(ahead is not None and ahead[1].lower().rstrip(".") in STARTERS | BEFORE_SETS[4] | BEFORE_SETS[5])]
    caps = span.isupper()
    x += [int(caps and bool(UPPER_END.search(line))), int(caps and bool(re.match(r"\W*[A-Z_]{2,}\b", tail)))]
    local, at, host = span.partition("@")
    end = re.split(r"[.\s)\]}]+", span)[-1]
    x += [int(kind == 0 and bool(SERVICE.search(span))), int(bool(at) and bool(INSIDE.search(host))), int(kind == 0 and end.isalpha()) * min(len(end), 16), int(kind == 0 and tail[:1] == ":" and not tail[1:2].isspace())]
    return x


def examples(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    grammar, xs, ys = Grammar(seed, sorted(GIVEN), STREETS), [], []
    for _ in range(count):
        text, items = grammar.spoken()
        true = {(k, text.index(v), text.index(v) + len(v)) for k, v in items}
        for k, lo, hi in candidates(text):
            xs.append(features(text, k, lo, hi))
            ys.append(float(any(k == t and lo == a and (abs(hi - b) < 3 or k == 3) for t, a, b in true)))
    return np.array(xs, np.int64), np.array(ys)


class Finder:
    """The fitted model; small, so it travels with the task."""

    def __init__(self, count: int = TRAINING) -> None:
        x, y = examples(11, count)
        held_x, held_y = examples(12, count // 3)
        self.model = Boosted().fit(x, y).calibrate(held_x, held_y)
        p = self.model.probability(held_x)
        self.least = np.full(len(TYPES), 0.5)
        for k in range(len(TYPES)):
            mine = held_x[:, k] == 1
            best = -1.0
            for t in np.arange(0.2, 0.81, 0.05):
                hit = (p[mine] >= t) * held_y[mine]
                f1 = 2 * hit.sum() / max(1.0, (p[mine] >= t).sum() + held_y[mine].sum())
                if f1 > best + 1e-9:
                    best, self.least[k] = f1, t

    def items(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text the chosen spans, in order: ``type, start, end``."""
        owner, spans, xs = [], [], []
        for i, text in enumerate(texts):
            for k, lo, hi in set(candidates(text)):
                owner.append(i)
                spans.append((k, lo, hi))
                xs.append(features(text, k, lo, hi))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not xs:
            return out
        x = np.array(xs, np.int64)
        p = self.model.probability(x)
        keep = np.flatnonzero(p >= self.least[np.argmax(x[:, :5], axis=1)])
        for j in sorted(keep, key=lambda j: (owner[j], -round(p[j], 1), spans[j][1] - spans[j][2], spans[j])):
            k, lo, hi = spans[j]
            mine = out[owner[j]]
            if all(hi <= a or lo >= b for _, a, b in mine):
                mine.append((k, lo, hi))
        return [sorted(m, key=lambda s: s[1]) for m in out]


def seen(text: str) -> tuple[str, np.ndarray | None]:
    """The text without invisible characters and look-alikes, and each character's place in the original."""
    if text.isascii():
        return text, None
    table = python_table()
    parts = [(i, table.get(ord(c), c)) for i, c in enumerate(text)]
    parts = [(i, c) for i, c in parts if c is not None]
    return "".join(c for _, c in parts), np.array([i for i, _ in parts] + [len(text)])


def redacted(batches: Iterator[pa.RecordBatch], finder: Finder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        plain = [("", None) if t is None else seen(t) for t in texts]
        found = finder.items([p for p, _ in plain])
        clean, kinds, lines = [], [], []
        for text, (flat, where), spans in zip(texts, plain, found, strict=True):
            parts, last, ks, ls = [], 0, [], []
            for k, lo, hi in spans:
                ks.append(TYPES[k])
                ls.append(flat.count("\n", 0, lo) + 1)
                a, b = (lo, hi) if where is None else (int(where[lo]), int(where[hi - 1]) + 1)
                parts += [text[last:a], f"[{TYPES[k].upper()}]"]
                last = b
            clean.append(None if text is None else "".join(parts) + text[last:])
            kinds.append(ks)
            lines.append(ls)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int64()))], ["key", "clean", "pii_types", "lines"]
        )


def redact_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, clean, pii_types, lines``: the readable text and, in order, each item's type and line; no shuffle."""
    kind = rows.schema[key].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(Finder())
    made = rows.select(key, text).mapInArrow(lambda it: redacted(it, sent.value), f"key {kind}, clean string, pii_types array<string>, lines array<bigint>")
    return made.withColumnRenamed("key", key)


def items_found(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pii_type, line``, each once."""
    made = redact_rows(rows, key, text).select(key, F.explode(F.arrays_zip("pii_types", "lines")).alias("i"))
    return made.select(key, F.col("i.pii_types").alias("pii_type"), F.col("i.lines").alias("line")).distinct()
