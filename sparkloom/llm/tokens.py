"""Problem 7: token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; each distinct word is merged once
per task and remembered in a table of fixed size. A word is merged with a segment tree
over its byte positions: a leaf holds the rank of the pair that starts there, each inner
node the leftmost position of the least rank below it. A merge takes the root's position,
unlinks the right neighbour and updates the leaves of the two pairs that changed, so a
word of n bytes takes O(n log n), also where a word is a megabyte of one letter.

Null and empty texts give an empty list. Special tokens' strings are ordinary text.
Texts are used unchanged; every row comes out once per distinct id and text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The public pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_KEPT = 300_000
NONE = 1 << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class MinTree:
    """Leftmost position of the least value, with point updates."""

    def __init__(self, values: list[int]) -> None:
        self.size = size = 1 << max(0, (len(values) - 1).bit_length())
        self.value = value = values + [NONE] * (size - len(values))
        at = [0] * size + list(range(size))
        for i in range(size - 1, 0, -1):
            left, right = at[2 * i], at[2 * i + 1]
            at[i] = left if value[left] <= value[right] else right
        self.at = at

    def least(self) -> int:
        return self.at[1] if self.size > 1 else 0

    def put(self, position: int, value: int) -> None:
        values, at = self.value, self.at
        values[position] = value
        i = (position + self.size) >> 1
        while i:
            left, right = at[2 * i], at[2 * i + 1]
            at[i] = left if values[left] <= values[right] else right
            i >>= 1


class Encoder:
    """Encodes texts by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.words = ranks, {}
        self.find = regex.compile(pattern).findall

    def merge(self, word: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part before starts

        def pair(i: int) -> int:
            j = end[i]
            return ranks.get(word[i : end[j]], NONE) if j < n else NONE

        tree = MinTree([pair(i) for i in range(n)])
        while tree.value[i := tree.least()] < NONE:
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            tree.put(gone, NONE)
            tree.put(i, pair(i))
            if before[i] >= 0:
                tree.put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def __call__(self, text: str) -> list[int]:
        words, out = self.words, []
        if len(words) > WORDS_KEPT:
            words.clear()
        for w in self.find(text):
            ids = words.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        parts = [np.array(encode(t), np.int32) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])


def encode_rows(rows: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """``key, ids``. ``vocabulary`` is the path of a rank file that every executor can read."""
    path = vocabulary or default_vocabulary()
    kind = rows.schema[key].dataType.simpleString()
    made = rows.select(key, text).mapInArrow(lambda it: encoded(it, path), f"key {kind}, ids array<int>")
    return made.withColumnRenamed("key", key)
