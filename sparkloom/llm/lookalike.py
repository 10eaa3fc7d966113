"""Problem 5: one consistent form for text that reads the same.

``mapped`` replaces width forms, kinds of space and look-alike letters and drops
invisible characters with one ``translate``. ``unify`` groups the mapped values
under Spark's accent-sensitive ``UNICODE`` collation, which holds composed and
combining accents equal, chooses the least member of each class as its canonical
text and joins it back.

Nulls stay null and blank texts stay themselves: they take part in no class.
Repeated rows of one id with one text count once. Empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Letters of other scripts drawn like a Latin letter, then that letter.
CYRILLIC = ("АВЕЅЗІЈКМНОРСТУХаеѕіјорсухһԁԛԝӀӏ", "ABESЗIJKMHOPCTYXaesijopcyxhdqwIl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp")
OTHERS = ("ЁёЇїօոսɡ", "ËëÏïonug")


@lru_cache(maxsize=1)
def pairs() -> tuple[str, str]:
    """Arguments of ``translate``: characters and their replacements; those beyond the replacements are deleted."""
    table: dict[str, str] = {}
    for src, dst in (CYRILLIC, GREEK, OTHERS):
        table |= {a: b for a, b in zip(src, dst, strict=True) if a != b}
    for c in map(chr, range(0xFF01, 0xFFEF)):
        wide = unicodedata.normalize("NFKC", c)
        if wide != c and len(wide) == 1:
            table[c] = wide
    table |= {"ﾞ": "゙", "ﾟ": "゚"}
    gone = []
    for c in map(chr, range(0x80, 0x3100)):
        kind = unicodedata.category(c)
        if kind == "Zs":
            table[c] = " "
        elif kind == "Cf" or c in "͏ᅟᅠ឴឵":
            gone.append(c)
    gone += [chr(c) for c in range(0xFE00, 0xFE10)] + ["﻿"]
    return "".join(table) + "".join(gone), "".join(table.values())


@lru_cache(maxsize=1)
def python_table() -> dict[int, str | None]:
    src, dst = pairs()
    return {ord(c): (dst[i] if i < len(dst) else None) for i, c in enumerate(src)}


@lru_cache(maxsize=1)
def composed() -> list[tuple[str, str]]:
    """Letter with combining mark, and the one character it equals, over the Latin, Greek, Cyrillic and kana blocks."""
    found = []
    for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x1F00), *range(0x3040, 0x3100)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", c) == c:
            found.append((parts, c))
    return sorted(found, key=lambda p: -len(p[0]))


@lru_cache(maxsize=1)
def mapped_letters() -> re.Pattern:
    return re.compile("[" + re.escape(pairs()[0]) + "]")


def unified(text: str) -> str:
    """The same form in Python, for operators that work on words."""
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    if mapped_letters().search(text):
        text = text.translate(python_table())
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def mapped(text: Column) -> Column:
    """ASCII texts, the most, need no table."""
    return F.replace(F.when(is_ascii(text), text).otherwise(F.translate(text, *pairs())), F.lit("\r\n"), F.lit("\n"))


def canonical(text: Column) -> Column:
    """``mapped`` with combining accents composed; only texts with such accents pay for it."""
    flat = mapped(text)
    loose, tight = (F.split(F.lit(" ".join(x)), " ") for x in zip(*composed(), strict=True))
    table = F.map_from_arrays(loose, tight)
    letters = F.regexp_extract_all(flat, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    joined = F.array_join(F.transform(letters, lambda x: F.when(F.length(x) > 1, F.coalesce(F.try_element_at(table, x), F.concat(F.try_element_at(table, F.substring(x, 1, 2)), F.substring(x, 3, 99)), x)).otherwise(x)), "")
    return F.when(~is_ascii(flat) & flat.rlike(r"\p{M}"), joined).otherwise(flat)


def block_of(flat: Column) -> Column:
    """A key that texts of one class share however their accents are stored: what is left without accented and foreign letters."""
    return F.xxhash64(F.when(is_ascii(flat), flat).otherwise(F.regexp_replace(flat, r"[A-Za-z]?\p{M}+|[^\x00-\x7f]+", "")))


def forms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``raw, class_id, canonical`` of every stored text (by hash) whose class holds a differently stored one.

    Blocks that hold one stored text only are left out by hash, before any text is
    shuffled. Of the rest each stored text goes on once, however many rows have it, and is
    grouped under the collation.
    """
    base = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), mapped(F.col(text)).alias("_flat")).where(F.col("_flat").rlike(r"\S"))
    base = base.withColumns({"_block": block_of(F.col("_flat")), "_raw": F.xxhash64("_text")})
    several = base.groupBy("_block").agg(F.min("_raw").alias("lo"), F.max("_raw").alias("hi")).where("lo <> hi").select("_block")
    held = base.join(materialize(several, "blocks"), "_block", "left_semi")
    once = held.groupBy("_block", "_raw").agg(F.min("_key").alias("_key"), F.min("_flat").alias("_flat"), F.min("_text").alias("_text"))
    once = materialize(once, "forms").withColumn("_form", F.collate("_flat", "UNICODE"))
    groups = once.groupBy("_block", "_form").agg(
        F.min("_key").alias("class_id"), F.min(canonical(F.col("_text"))).alias("canonical"), F.min("_raw").alias("lo"), F.max("_raw").alias("hi")
    )
    found = once.join(groups.where("lo <> hi"), ["_block", "_form"])
    return materialize(found.select(F.col("_raw").alias("raw"), "class_id", "canonical"), "classes")


def stored(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, raw``: each id with the hash of its stored text, once."""
    return rows.where(F.col(text).isNotNull()).select(F.col(key), F.xxhash64(text).alias("raw")).distinct()


def same_reading(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs ``<key>_a < <key>_b`` of ids whose texts read the same and are stored differently.

    The stored texts of a class, few whatever the number of ids, are paired first; ids join
    them then, so ids with one stored text never meet each other.
    """
    found = forms(rows, key, text).select("raw", "class_id")
    a, b = (found.select("class_id", F.col("raw").alias(f"raw_{x}")) for x in "ab")
    pairs_ = materialize(a.join(b, "class_id").where("raw_a <> raw_b").select("raw_a", "raw_b"), "pairs")
    ids = materialize(stored(rows, key, text).join(found.select("raw"), "raw", "left_semi"), "ids")
    left, right = (ids.select(F.col("raw").alias(f"raw_{x}"), F.col(key).alias(f"{key}_{x}")) for x in "ab")
    return pairs_.join(left, "raw_a").join(right, "raw_b").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def unify(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, class_id``: every distinct id with its text in the one form; ``class_id`` is null where no other id is stored differently."""
    base = rows.select(F.col(key), canonical(F.col(text)).alias("_own"), F.xxhash64(text).alias("raw")).dropDuplicates([key, "raw"])
    return base.join(forms(rows, key, text), "raw", "left").select(key, F.coalesce("canonical", "_own").alias(text), "class_id").distinct()
