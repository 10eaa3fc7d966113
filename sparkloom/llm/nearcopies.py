"""Problem 4: groups of texts that are alike beyond a threshold, without pairwise comparison.

1. Each text in its one form (problem 5) becomes its set of runs of consecutive words,
   as hashes. The sets are written once to the shared folder.
2. ProbMinHash: every element arrives at its own times, a Poisson process whose rate is
   the element's weight; each arrival takes a random slot of the signature and holds it
   if it came first. A text is done as soon as its next arrivals come after the latest
   held slot. Two signatures agree in a slot with the probability Jaccard of the weights.
3. Bands of slots give candidates among class representatives: texts with equal sets are
   one class. Copies are dropped before anything is shuffled, first within a task, then by
   partial aggregation, so a text posted a million times is one row of each of its bands.
   Bands that one class alone holds are found by the least and greatest class of each band;
   the few others are written out and meet the classes again in a join AQE can split.
4. Candidates are verified by the Jaccard of the whole sets, as 32-bit fingerprints of their
   runs: two different runs of a pair of texts share one with a probability of about 1e-5.

With unit weights the probability Jaccard is the Jaccard of the sets, which is what the
threshold of problem 4 is about, so ``p4_found`` uses those; ``weighted=True`` weighs a
run by how often the text has it.

``near_classes`` is the form whose size is bounded by the input: one row an id. ``near_pairs``
lists all pairs of a group, exact copies included, because that is its contract; its
result, and only that, grows with the square of a group.

Null titles and texts count as empty; texts with fewer than ``least`` distinct runs take
no part; repeated rows of one id count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, splitmix, unit
from .lookalike import unified

WORD = re.compile(r"\w+")
WORDS_KEPT = 200_000
SEEN_KEPT = 1_000_000


class Words:
    """Word hashes, remembered up to a fixed number of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, words = self.known, WORD.findall(text)
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = splitmix(h ^ hashes[k : k + n])
    return h


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, slots: int, seed: int = 7) -> np.ndarray:
    """``docs x slots`` signatures of the weighted sets given as parallel arrays."""
    first = np.full(docs * slots, np.inf)
    held = np.zeros(docs * slots, np.uint64)
    state, time = splitmix(element ^ np.uint64(seed)), np.zeros(len(element))
    live = np.arange(len(element))
    latest = np.full(docs, np.inf)
    while live.size:
        state[live] = s = splitmix(state[live])
        time[live] -= np.log(unit(s)) / weight[live]
        live = live[time[live] < latest[doc[live]]]
        at = doc[live] * slots + (splitmix(state[live] ^ np.uint64(0xA5A5A5A5)) % np.uint64(slots)).astype(np.int64)
        better = time[live] < first[at]
        who, at = live[better], at[better]
        order = np.lexsort((element[who], time[who]))[::-1]
        first[at[order]] = time[who][order]
        held[at[order]] = element[who][order]
        latest = first.reshape(docs, slots).max(axis=1)
    return held.reshape(docs, slots)


def sketches(batches: Iterator[pa.RecordBatch], width: int, least: int, bands: int, rows: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    words, met = Words(), set()
    for batch in batches:
        key, title, text = (batch.column(i) for i in range(3))
        keys, elements, counts = [], [], []
        for i, (a, b) in enumerate(zip(title.to_pylist(), text.to_pylist(), strict=True)):
            h, n = np.unique(runs(words(unified(f"{a or ''}\n{b or ''}").lower()), width), return_counts=True)
            if len(h) >= least:
                keys.append(i)
                elements.append(h)
                counts.append(n)
        if not keys:
            continue
        sizes = np.array([len(e) for e in elements])
        same = np.array([np.bitwise_xor.reduce(splitmix(e)) for e in elements], np.uint64) ^ sizes.astype(np.uint64)
        if len(met) > SEEN_KEPT:
            met.clear()
        new = np.zeros(len(keys), bool)  # a class that the task has met needs no second description
        for i, s in enumerate(same.tolist()):
            new[i] = s not in met
            met.add(s)
        some = np.flatnonzero(new)
        band, prints = np.empty((0, bands), np.uint64), np.empty(0, np.uint32)
        if len(some):
            element = np.concatenate([elements[i] for i in some])
            weight = np.concatenate([counts[i] for i in some]).astype(float) if weighted else np.ones(len(element))
            signature = probminhash(np.repeat(np.arange(len(some)), sizes[some]), element, weight, len(some), bands * rows)
            band = np.zeros((len(some), bands), np.uint64)
            for k in range(rows):
                band = splitmix(band ^ signature[:, k::rows])
            band = splitmix(band ^ np.arange(bands, dtype=np.uint64))
            prints = (element >> np.uint64(32)).astype(np.uint32)
        upto = lambda n: np.concatenate([[0], np.cumsum(np.where(new, n, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                key.take(pa.array(keys)),
                pa.array(same.view(np.int64)),
                pa.ListArray.from_arrays(upto(bands), pa.array(band.ravel().view(np.int64))),
                pa.ListArray.from_arrays(upto(sizes), pa.array(prints.view(np.int32))),
            ],
            ["key", "same", "bands", "runs"],
        )


def described(rows: DataFrame, key: str, title: str, text: str, width: int = 3, least: int = 50, bands: int = 64, band_rows: int = 5, weighted: bool = False) -> DataFrame:
    """``key, same, bands, runs``, written to the shared folder: ``same`` is the class of equal sets, ``runs`` 32-bit fingerprints.

    ``bands`` and ``runs`` are empty where the task has described the class before.
    """
    kind = rows.schema[key].dataType.simpleString()
    made = rows.select(key, title, text).mapInArrow(
        lambda it: sketches(it, width, least, bands, band_rows, weighted), f"key {kind}, same bigint, bands array<bigint>, runs array<int>"
    )
    return materialize(made, "runs")


def similar(made: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``same_a < same_b, similarity`` of classes at or above the threshold.

    A band that many classes share holds texts that are mostly alike, so its pairs are
    results; AQE splits the join where such a band is skewed, as both sides are read from
    written tables.
    """
    banded = made.select("same", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("same").alias("lo"), F.max("same").alias("hi"))
    several = materialize(ends.where("lo <> hi").select("band"), "several")
    shared = materialize(banded.join(several, "band", "left_semi").distinct(), "bands")
    a, b = (shared.select("band", F.col("same").alias(f"same_{x}")) for x in "ab")
    met = a.join(b, "band").where("same_a < same_b").select("same_a", "same_b").distinct()
    described_once = made.where(F.size("runs") > 0).select("same", "runs")
    sets = described_once.join(shared.select("same").distinct(), "same", "left_semi").groupBy("same").agg(F.first("runs").alias("runs"))
    for x in "ab":
        met = met.join(sets.select(F.col("same").alias(f"same_{x}"), F.col("runs").alias(f"runs_{x}")), f"same_{x}")
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    return met.select("same_a", "same_b", (both / (F.size("runs_a") + F.size("runs_b") - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(rows: DataFrame, key: str, title: str, text: str, threshold: float = 0.6, **how) -> DataFrame:
    """``<key>_a < <key>_b``: every pair of ids at or above the threshold, exact copies included.

    All pairs of a group are listed, as the contract asks: of n copies n (n - 1) / 2 rows.
    ``near_classes`` is the bounded form.
    """
    made = described(rows, key, title, text, **how)
    members = made.select("key", "same").distinct()
    a, b = (members.select(F.col("same").alias(f"same_{x}"), F.col("key").alias(x)) for x in "ab")
    between = similar(made, threshold).join(a, "same_a").join(b, "same_b").select("a", "b")
    within = a.join(b.withColumnRenamed("same_b", "same_a"), "same_a").where("a < b").select("a", "b")
    both = between.unionByName(within)
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()


def near_classes(rows: DataFrame, key: str, title: str, text: str, threshold: float = 0.6, **how) -> DataFrame:
    """``key, class_id, links``: each id with its class of equal sets and the number of other classes it is linked to."""
    made = described(rows, key, title, text, **how)
    members = made.select("key", "same").distinct()
    ends = similar(made, threshold).select(F.explode(F.array("same_a", "same_b")).alias("same")).groupBy("same").agg(F.count("*").alias("links"))
    named = members.groupBy("same").agg(F.min("key").alias("class_id")).join(ends, "same", "left")
    return members.join(named, "same").select(F.col("key").alias(key), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
