"""Problem 8: held-out items whose passages occur in a corpus.

1. Seeds: of the five-word runs in every window of ``run`` words of an item, the one
   rarest in the corpus, by a count over all documents, is a seed; so no quote of ``run``
   words is without one.
2. A document's five-word runs meet the seeds in a sorted table; a hit names the item and
   a diagonal.
3. Smith-Waterman alignment of the item with the document around its hits scores exact,
   edited and re-laid-out copies alike.
4. ``p8_found`` keeps alignments that hold ``run`` consecutive words unchanged: an exact
   check on what the alignment found, as that query asks for unchanged words only.

Items are a stated query set: they are read in blocks of counted bytes (``BLOCK``, and one
item at least), each broadcast as its words and seeds, and every block meets all documents.
Several texts of one item are kept apart by a word that equals no other.

Null and blank texts match nothing. Repeated rows of an id count once. Empty tables give
an empty result. Words are runs of letters, digits and underscores, compared without case.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, splitmix
from .nearcopies import Words, runs

GRAM, RUN, BLOCK, PAD = 5, 12, 16 << 20, 32
MATCH, MISMATCH, GAP = 2, -1, -1


def seeds_of(item: np.ndarray, counts: dict[int, int], run: int = RUN) -> list[int]:
    """Positions of the rarest gram of every window, of equal ones the leftmost; grams that no document has lead nowhere."""
    grams = runs(item, GRAM)
    if not len(grams):
        return []
    seen = np.array([counts.get(int(g), 0) or np.inf for g in grams])
    span = min(run - GRAM + 1, len(grams))
    return sorted({i + int(np.argmin(w)) for i in range(len(grams) - span + 1) if np.isfinite((w := seen[i : i + span]).min())})


def align(item: np.ndarray, text: np.ndarray) -> int:
    """The best Smith-Waterman score of local alignments, a row of the table at a time."""
    slope = -GAP * np.arange(len(text) + 1)
    above, best = np.zeros(len(text) + 1, np.int64), 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + slope) - slope
        best = max(best, int(above.max()))
    return best


def longest(item: np.ndarray, text: np.ndarray, diagonals: set[int]) -> int:
    """The longest run of equal words on the given diagonals (text position minus item position)."""
    best = 0
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(text) - d)
        off = np.flatnonzero(item[lo:hi] != text[lo + d : hi + d])
        best = max(best, int(np.diff(np.concatenate([[-1], off, [hi - lo]])).max()) - 1)
    return best


def counted(batches: Iterator[pa.RecordBatch], grams: np.ndarray) -> Iterator[pa.RecordBatch]:
    words, total = Words(), np.zeros(len(grams), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                found = runs(words(text.casefold()), GRAM)
                at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                at = at[grams[at] == found]
                if len(at):
                    np.add.at(total, at, 1)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])


def matched(batches: Iterator[pa.RecordBatch], items: dict[int, np.ndarray], table: np.ndarray, owners: list[list[tuple[int, int]]], least: int) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        out = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            doc = words(text.casefold())
            grams = runs(doc, GRAM)
            at = np.minimum(np.searchsorted(table, grams), len(table) - 1)
            by = defaultdict(list)
            for p in np.flatnonzero(table[at] == grams):
                for item, q in owners[at[p]]:
                    by[item].append(int(p) - q)
            for item, starts in by.items():
                score, run, words_of = 0, 0, items[item]
                starts = sorted(set(starts))
                first = 0
                for k in range(1, len(starts) + 1):
                    if k == len(starts) or starts[k] - starts[k - 1] > len(words_of) + PAD:
                        lo = max(0, starts[first] - PAD)
                        part = doc[lo : starts[k - 1] + len(words_of) + PAD]
                        if MATCH * np.isin(words_of, part).sum() >= least:  # no alignment scores more
                            score = max(score, align(words_of, part))
                            run = max(run, longest(words_of, part, {s - lo for s in starts[first:k]}))
                        first = k
                if score >= least:
                    out.append((i, item, score, run, len(words_of)))
        if out:
            at, item, score, run, size = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(score, pa.int32()), pa.array(run, pa.int32()), pa.array(size, pa.int32())],
                ["key", "item", "score", "run", "size"],
            )


def blocks_of(known: DataFrame, most: int) -> Iterator[list[int]]:
    """Ids of items whose texts have at most ``most`` bytes together, one item at least; sizes come one at a time, in the order of ids."""
    chosen, held = [], 0
    for r in known.groupBy("id").agg(F.sum(F.octet_length("t")).alias("size")).orderBy("id").toLocalIterator():
        if chosen and (held + r["size"] > most or len(chosen) >= 10_000):
            yield chosen
            chosen, held = [], 0
        chosen.append(r["id"])
        held += r["size"]
    if chosen:
        yield chosen


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = RUN * MATCH, block: int = BLOCK) -> DataFrame:
    """``key, item_key, score, run, size``: alignments of at least the score ``least``.

    ``score`` gives ``MATCH`` for an equal word, ``run`` is the longest unchanged run of
    words, ``size`` the item's words.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("id"), F.col(item_text).alias("t")).dropDuplicates()
    known = materialize(known, "items")
    made = None
    for chosen in blocks_of(known, block):
        words = Words()
        rows = known.where(F.col("id").isin(chosen)).orderBy("id", F.xxhash64("t")).toPandas()
        own: dict[int, list[np.ndarray]] = defaultdict(list)
        for n, (i, t) in enumerate(zip(rows.id, rows.t, strict=True)):
            apart = splitmix(np.array([(1 << 63) + n], np.uint64))
            own[int(i)] += [words(t.casefold()), apart]
        parts = {i: np.concatenate(v[:-1]) for i, v in own.items()}
        grams = np.unique(np.concatenate([np.empty(0, np.uint64), *(runs(w, GRAM) for w in parts.values())]))
        if not len(grams):
            continue
        sent = spark.sparkContext.broadcast(grams)
        count = docs.select(text).mapInArrow(lambda it, b=sent: counted(it, b.value), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {int(grams[r.gram]): r.n for r in count.toLocalIterator()}
        places = defaultdict(list)
        for i, w in parts.items():
            g = runs(w, GRAM)
            for q in seeds_of(w, counts):
                places[int(g[q])].append((i, q))
        if not places:
            continue
        table = np.array(sorted(places), np.uint64)
        model = spark.sparkContext.broadcast((parts, table, [places[int(g)] for g in table]))
        found = docs.select(key, text).mapInArrow(
            lambda it, m=model: matched(it, *m.value, least), f"key {kind}, item bigint, score int, run int, size int"
        )
        made = found if made is None else made.unionByName(found)
    if made is None:
        made = spark.createDataFrame([], f"key {kind}, item bigint, score int, run int, size int")
    named = made.withColumnsRenamed({"key": key, "item": item_key})
    return named.groupBy(key, item_key).agg(F.max("score").alias("score"), F.max("run").alias("run"), F.max("size").alias("size"))
