"""Vector and graph retrieval, and their paired comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.shared import materialize
from sparkloom.functions.stats import mcnemar, rate
from sparkloom.functions.text import trimmed
from sparkloom.operators.findings import of_type

TOP_K, SEED_SLOTS, BLOCK_BYTES = 5, 3, 64 << 20
#: Of ``spread``: bytes of section ids in a file, rows and sums that one task makes.
DICTIONARY_BYTES, ROWS_A_TASK, SUMS_A_TASK = 600_000, 3_000_000, 500_000


def best_of(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best items of each query in each batch, by one matrix product; ties go to the lower item id."""
    for batch in batches:
        kept = batch.filter(pc.is_valid(batch.column(1)))
        if not kept.num_rows:
            continue
        flat = kept.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        items = kept.column(0)
        order = pc.sort_indices(items)  # equal scores then come in the order of ids
        score = vectors @ flat.reshape(kept.num_rows, -1)[order.to_numpy()].T
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, top.shape[1])), items.take(order).take(pa.array(top.ravel())), pa.array(np.take_along_axis(score, top, 1).ravel())], ["query_id", "item_id", "score"]
        )


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """``query_id, item_id, score, rank``: the ``k`` best inner products; ties go to the lower item id.

    ``queries (query_id, vector)`` is a stated set: it is sent to every task in blocks of
    counted bytes; every item meets every query, by one matrix product for a batch of items,
    and ``k`` for each batch and query go on. Items without a vector are left out.
    """
    known = queries.where("vector IS NOT NULL")
    size, width = known.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(size * 8 * (width or 1)) // BLOCK_BYTES))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {vectors.schema['item_id'].dataType.simpleString()}, score double"
    made = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "vector").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        sent = queries.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), np.array(part["vector"].to_pylist(), np.float64)))
        scored = vectors.select("item_id", "item_vector").mapInArrow(lambda it, s=sent: best_of(it, *s.value, k), kinds)
        made = scored if made is None else made.unionByName(scored)
    if made is None:
        made = queries.sparkSession.createDataFrame([], kinds)
    ranked = made.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")))
    return ranked.where(F.col("rank") <= k)


def spread(asks: DataFrame, gives: DataFrame, best: int | None = None) -> DataFrame:
    """``question, section, score``: the sum of ``weight`` times ``score`` over the concepts that a question and a section share.

    ``asks``: ``question, concept, weight``, ``gives``: ``concept, section, score``, each pair once. There are
    as many rows as pairs that meet, so no pair is shuffled: sections that give the same concepts count
    as one kind, kinds are sent to the tasks in blocks of counted bytes, a question's sums are made
    where its concepts lie, and its sections unfold from the kinds at the end. A task gets a counted
    number of pairs. ``best``: as many rows at most, the highest scores, of each question; ties go to the lower section id.
    """
    order = F.array_sort(F.collect_list("section"))
    held = gives.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("concept", "score"))).alias("held"))
    kinds = materialize(held.groupBy("held").agg((F.slice(order, 1, best) if best else order).alias("sections")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    asks = materialize(asks, "asks")
    room = F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s))
    size = kinds.agg(F.sum(room)).first()[0] or 0
    # a file whose rows name few sections keeps them in a dictionary
    blocks = max(1, -(-size // (BLOCK_BYTES if best else DICTIONARY_BYTES)))
    into = kinds.select(F.explode("held.concept").alias("concept"), F.size("sections").cast("bigint").alias("n")).groupBy("concept").agg(F.sum("n").alias("sections"), F.count("*").alias("kinds"))
    met = asks.groupBy("concept").agg(F.count("*").alias("asked")).join(into, "concept").agg(F.sum(F.col("asked") * F.col("sections")), F.sum(F.col("asked") * F.col("kinds"))).first()
    tasks = max(1, -(-(met[0] or 0) // (blocks * ROWS_A_TASK)), -(-(met[1] or 0) // (blocks * SUMS_A_TASK)))
    first = F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "section"))
    made = None
    for b in range(blocks):
        part = kinds.where(F.pmod(F.xxhash64("kind"), F.lit(blocks)) == b)
        entry = part.select("kind", F.explode("held").alias("e")).select("kind", "e.concept", "e.score")
        # another number of tasks for each block, else their union would be one task for all blocks
        sums = asks.repartition(tasks + b, "question").join(F.broadcast(entry), "concept").groupBy("question", "kind").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))
        rows = sums.where("score > 0").join(F.broadcast(part.select("kind", "sections")), "kind").select("question", F.explode("sections").alias("section"), "score")
        rows = rows.withColumn("rank", first).where(F.col("rank") <= best).drop("rank") if best else rows
        made = rows if made is None else made.unionByName(rows)
    return made.withColumn("rank", first).where(F.col("rank") <= best).drop("rank") if best and blocks > 1 else made


def asked(edges: DataFrame) -> DataFrame:
    """``question, concept, weight``: how often a question asks about a concept."""
    return of_type(edges, "ASKS_ABOUT").where("dst IS NOT NULL").groupBy(F.col("src").alias("question"), F.col("dst").alias("concept")).agg(F.count("*").alias("weight"))


def given(edges: DataFrame) -> DataFrame:
    """``concept, section, score``: 3 for each definition, or 1 for each edge of a concept nobody defines."""
    into = of_type(edges, "DEFINES", "REQUIRES", "MENTIONS").select(F.col("dst").alias("concept"), F.col("src").alias("section"), "type")
    defined = into.where("type = 'DEFINES'").select("concept").distinct().withColumn("defined", F.lit(True))
    usable = into.join(defined, "concept", "left").where("(type = 'DEFINES') = coalesce(defined, false)")
    return usable.groupBy("concept", "section").agg(F.sum(F.when(F.col("type") == "DEFINES", 3).otherwise(1)).alias("score"))


def seeds(edges: DataFrame) -> DataFrame:
    """``question, section, score``: 3 for each asked concept a section defines, else 1 for each edge of a concept nobody defines."""
    return spread(asked(edges), given(edges))


def alike(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``question, like``: for each question the first that asks about the same concepts as often; and ``question, concept, weight`` of those first ones."""
    sets = materialize(asked(edges).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("concept", "weight"))).alias("asked")), "asked")
    first = sets.groupBy("asked").agg(F.min("question").alias("like"))
    asks = first.select(F.col("like").alias("question"), F.explode("asked").alias("a")).select("question", "a.concept", "a.weight")
    return sets.join(first, "asked").select("question", "like"), asks


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "section")))


def best_seeds(edges: DataFrame, k: int) -> DataFrame:
    """``question, section, score, rank``: the ``k`` best seeds of each question."""
    like, asks = alike(edges)
    top = ranked(spread(asks, given(edges), k)).withColumnRenamed("question", "like")
    return like.join(top, "like").drop("like")


def hops(edges: DataFrame, top: DataFrame, best: int | None = None) -> DataFrame:
    """``question, section, score``: definers of what the top seeds require, themselves not among those seeds; the ``best`` of each question, if given."""
    top = materialize(top.select("question", F.col("section").alias("seed")), "top")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c)).alias("concept")
    needs = of_type(edges, "REQUIRES").select(F.col("src").alias("seed"), F.col("dst").alias("concept"))
    asks = top.join(needs, "seed").groupBy("question", name("+", "concept")).agg(F.count("*").alias("weight"))
    gives = of_type(edges, "DEFINES").groupBy(name("+", "dst"), F.col("src").alias("section")).agg(F.count("*").alias("score"))
    # a seed is a concept of its own that takes more than all others can give
    own = top.select("question", name("-", "seed"), F.lit(-(1 << 40)).alias("weight")).distinct()
    seed = top.select(name("-", "seed"), F.col("seed").alias("section"), F.lit(1).cast("bigint").alias("score")).distinct()
    return spread(asks.unionByName(own), gives.unionByName(seed), best)


def graph_retrieval(edges: DataFrame, top_k: int = TOP_K, seed_slots: int = SEED_SLOTS) -> DataFrame:
    """``question, sections``: seeds first, then one hop; each side leaves unused slots to the other.

    Questions that ask about the same concepts retrieve the same, so one of each kind is worked out.
    """
    like, asks = alike(edges)
    seed = materialize(ranked(spread(asks, given(edges), top_k)), "seeds")
    hop = ranked(hops(edges, seed.where(F.col("rank") <= seed_slots), top_k))
    both = seed.select("question", "section", "rank", F.lit(0).alias("hop")).unionByName(hop.select("question", "section", "rank", F.lit(1).alias("hop")))
    q = W.partitionBy("question")
    both = both.withColumns({"n_seed": F.sum(1 - F.col("hop")).over(q), "n_hop": F.sum("hop").over(q)})
    hop_slots = top_k - seed_slots
    for_seed = F.when(F.col("n_hop") < hop_slots, top_k - F.col("n_hop")).otherwise(seed_slots)
    for_hop = F.when((F.col("n_hop") >= hop_slots) & (F.col("n_seed") < seed_slots), top_k - F.col("n_seed")).otherwise(hop_slots)
    kept = both.where(F.col("rank") <= F.when(F.col("hop") == 0, for_seed).otherwise(for_hop))
    once = kept.groupBy("question", "section").agg(F.min(F.struct("hop", "rank")).alias("at"))
    listed = once.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("at", "section"))).alias("l"))
    found = listed.select(F.col("question").alias("like"), F.slice(F.transform("l", lambda x: x["section"]), 1, top_k).alias("sections"))
    return like.join(found, "like").select("question", "sections")


def traversal(edges: DataFrame) -> DataFrame:
    """``question, steps``: in words, where each asked concept led."""
    asks = of_type(edges, "ASKS_ABOUT").select(F.col("src").alias("question"), F.col("dst").alias("concept"))
    into = of_type(edges, "DEFINES", "REQUIRES", "MENTIONS").groupBy(F.col("dst").alias("concept")).agg(
        F.count_if(F.col("type") == "DEFINES").alias("definers"), F.size(F.collect_set(F.when(F.col("type") != "DEFINES", F.col("src")))).alias("users")
    )
    said = F.when(F.col("definers") > 0, F.format_string("%s ASKS_ABOUT %s: defined by %d section(s)", "question", "concept", "definers")).otherwise(
        F.format_string("%s ASKS_ABOUT %s: no definition, used by %d section(s)", F.col("question"), F.col("concept"), F.coalesce("users", F.lit(0)))
    )
    return asks.join(into.fillna(0), "concept", "left").fillna(0, ["definers"]).select("question", "concept", said.alias("step")).groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("concept", "step"))), lambda s: s["step"]).alias("steps"))


def retrieval_overlap(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """Of ``question, sections`` by both ways: how many came out empty, alike, or with a section only the graph reached."""
    v, g = vector.select("question", F.col("sections").alias("v")), graph.select("question", F.col("sections").alias("g"))
    none = F.array().cast("array<string>")
    both = v.join(g, "question", "full").select(F.coalesce("v", none).alias("v"), F.coalesce("g", none).alias("g"))
    return both.agg(
        F.count("*").alias("questions"), F.count_if(F.size("g") == 0).alias("graph_empty"), F.count_if(F.array_sort("v") == F.array_sort("g")).alias("identical"), F.count_if(F.size(F.array_except("g", "v")) > 0).alias("graph_reached_new")
    )


def generated(replies: DataFrame) -> DataFrame:
    """``question_id, answer`` of ``replies(question_id, reply)``: a text, or an object with an ``answer``; blank ones are left out."""
    said = F.coalesce(F.get_json_object("reply", "$.answer"), F.when(F.try_parse_json("reply").isNull() | ~F.trim("reply").startswith("{"), F.col("reply")))
    return replies.select("question_id", trimmed(said).alias("answer")).where("answer <> ''")


def scorable(questions: DataFrame, *answered: DataFrame) -> DataFrame:
    """Questions answered by at least one way."""
    some = answered[0].select("question_id")
    for a in answered[1:]:
        some = some.unionByName(a.select("question_id"))
    return questions.join(some.distinct(), "question_id", "left_semi")


def compare(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: verdict counts and rates of both ways, the paired counts and exact tests.

    ``answers``: the questions put to both ways, ``question_id``; ``verdicts``: ``question_id, path, verdict``.
    """
    side = lambda p: verdicts.where(F.col("path") == p).groupBy("question_id").agg(F.first("verdict").alias(p))
    rows = answers.select("question_id").distinct().join(side("vector"), "question_id", "left").join(side("graph"), "question_id", "left").fillna("unscored", ["vector", "graph"])
    n = lambda p, v: F.count_if(F.col(p) == v).alias(f"{p}_{v}")
    counts = [n(p, v) for p in ("vector", "graph") for v in ("correct", "wrong_confident", "declined", "unscored")]
    is_ = lambda p, v: F.col(p) == v
    pair = lambda v, a, b, name: F.count_if((is_("vector", v) if a else ~is_("vector", v)) & (is_("graph", v) if b else ~is_("graph", v))).alias(name)
    total = rows.agg(
        F.count("*").alias("n"), *counts, pair("correct", 1, 0, "vector_only"), pair("correct", 0, 1, "graph_only"), pair("correct", 1, 1, "both"), pair("correct", 0, 0, "neither"),
        pair("wrong_confident", 1, 0, "vector_wrong_only"), pair("wrong_confident", 0, 1, "graph_wrong_only"),
    )
    rates = {f"{p}_{v}_rate": rate(F.col(f"{p}_{v}"), F.col("n") - F.col(f"{p}_unscored")) for p in ("vector", "graph") for v in ("correct", "wrong_confident", "declined")}
    return total.withColumns(rates | {"mcnemar_correct": mcnemar(F.col("vector_only"), F.col("graph_only")), "mcnemar_wrong": mcnemar(F.col("vector_wrong_only"), F.col("graph_wrong_only"))})
