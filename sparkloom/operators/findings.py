"""The three finders: near misses, orphan concepts and retrieval collisions.

All work on edges grouped by concept, question or section; no graph is held in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.shared import materialize
from sparkloom.functions.text import out_of_scope
from sparkloom.schema import TO_CONCEPT, Graph

MIN_SECTIONS, COLLISION_RATIO, MIN_OVERLAP, COMPETITORS, MIN_GAP = 2, 0.8, 2, 5, 0.02
#: Pairs of a question and a section that one task puts together.
MEET_A_TASK = 1_000_000


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def concept_counts(edges: DataFrame) -> DataFrame:
    """Edges of each type into every concept, and whether prose speaks of it."""
    n = lambda t: F.count_if(F.col("type") == t)
    prose = F.bool_or((F.col("evidence.kind") == "prose") & F.col("type").isin("REQUIRES", "MENTIONS"))
    into = of_type(edges, *TO_CONCEPT, "ASKS_ABOUT")
    return into.groupBy(F.col("dst").alias("concept")).agg(
        n("DEFINES").alias("defines_count"), n("REQUIRES").alias("requires_count"), n("MENTIONS").alias("mentions_count"), n("ASKS_ABOUT").alias("demand"), F.coalesce(prose, F.lit(False)).alias("in_prose")
    )


def section_concepts(edges: DataFrame) -> DataFrame:
    return of_type(edges, *TO_CONCEPT).select(F.col("src").alias("section"), F.col("dst").alias("concept")).distinct()


def evidence(edge: Column) -> Column:
    return F.struct(edge["span"].alias("span"), edge["path"].alias("path"), edge["lines"].alias("lines"))


def hop(name: Column | str, edge=None, src=None, dst=None, proof=None, checked=None, found=None) -> Column:
    """One step of a proof path; steps of all kinds share this type."""
    cast = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("hop"), cast(edge, "string").alias("edge"), cast(src, "string").alias("src"), cast(dst, "string").alias("dst"),
        cast(proof, "struct<span:string,path:string,lines:struct<start:int,end:int>>").alias("evidence"), cast(checked, "bigint").alias("sections_checked"), cast(found, "bigint").alias("defines_edges_found"),
    )


def near_miss_concepts(g: Graph) -> DataFrame:
    """Concepts asked about and required, in scope, that no section defines."""
    counts = concept_counts(g.edges).where("demand > 0 AND requires_count > 0 AND defines_count = 0")
    return counts.join(g.concepts.select(F.col("id").alias("concept"), "label", "kind"), "concept").where(~out_of_scope(F.col("label")))


def requiring_section(g: Graph, concepts: DataFrame) -> DataFrame:
    """For each concept the REQUIRES edge of the section most on its askers' topic; ties go to the lower section id."""
    asks = of_type(g.edges, "ASKS_ABOUT").select(F.col("src").alias("q"), F.col("dst").alias("x"))
    mine = asks.join(concepts.select(F.col("concept").alias("x"), "concept"), "x").select("concept", "q")
    topics = mine.join(asks, "q").where("x <> concept").select("concept", "x").distinct()
    held = section_concepts(g.edges)
    needs = of_type(g.edges, "REQUIRES").join(concepts.select(F.col("concept").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("concept"), F.col("src").alias("section"), "id", "confidence", "evidence")
    shared = (
        needs.select("concept", "section").join(held.withColumnRenamed("concept", "x"), "section").join(topics, ["concept", "x"])
        .groupBy("concept", "section").agg(F.array_sort(F.collect_set("x")).alias("shared_concepts"))
    )
    width = held.groupBy("section").agg(F.count("*").alias("width"))
    surety = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "low", 0).otherwise(1)
    best = W.partitionBy("concept").orderBy(F.coalesce(F.size("shared_concepts"), F.lit(0)).desc(), F.when(F.col("evidence.kind") == "prose", 1).otherwise(0).desc(), surety.desc(), F.col("width").desc(), "section")
    ranked = needs.join(shared, ["concept", "section"], "left").join(width, "section").withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return ranked.select("concept", "section", F.col("id").alias("requires_edge"), "evidence", F.coalesce("shared_concepts", F.array().cast("array<string>")).alias("shared_concepts"))


def ranked_askers(g: Graph, concepts: DataFrame) -> DataFrame:
    """Askers of each concept, those with a maintainer's and the fullest answer first: all ids, and of the first eight the titles.

    Only ids and their ranks are gathered for a concept; titles and evidence are joined to the eight that are shown.
    """
    asks = of_type(g.edges, "ASKS_ABOUT").join(concepts.select(F.col("concept").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("concept"), F.col("src").alias("q"), F.col("id").alias("ask"), "evidence")
    asked = asks.select("q").distinct()
    answered = of_type(g.edges, "ANSWERED_BY").select(F.col("src").alias("q"), F.col("dst").alias("answer")).join(asked, "q", "left_semi")
    weight = g.answers.select(F.col("id").alias("answer"), F.coalesce(F.col("is_maintainer").cast("int"), F.lit(0)).alias("m"), F.coalesce(F.length("body"), F.lit(0)).alias("size"))
    place = F.struct(-F.coalesce("m", F.lit(0)), -F.coalesce("size", F.lit(0)), F.col("q").alias("q"))
    ranked = asks.join(answered.join(weight, "answer"), "q", "left").select("concept", "q", "ask", "evidence", place.alias("place"))
    every = ranked.groupBy("concept").agg(F.array_sort(F.collect_list("place")).alias("places"), F.min_by(F.struct("q", "ask", "evidence"), "place").alias("lead"))
    every = every.select("concept", F.transform("places", lambda p: p["q"]).alias("questions"), "lead")
    shown = every.select("concept", F.posexplode(F.slice("questions", 1, 8)).alias("n", "q")).join(g.questions.select(F.col("id").alias("q"), "title"), "q", "left")
    titles = shown.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda t: t["title"]).alias("question_titles"))
    return every.join(titles, "concept")


def numbered(rows: DataFrame, prefix: str, *order) -> DataFrame:
    """Finding ids in rank order. Findings are a report of a size people read, so one ordering task is enough."""
    return rows.withColumn("id", F.format_string(f"{prefix}-%04d", F.row_number().over(W.orderBy(*order))))


def near_misses(g: Graph) -> DataFrame:
    concepts = materialize(near_miss_concepts(g), "concepts")
    chosen, askers = requiring_section(g, concepts), ranked_askers(g, concepts)
    total = g.sections.agg(F.count("*").alias("total"))
    others = of_type(g.edges, "REQUIRES").join(concepts.select(F.col("concept").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("concept")).agg(F.collect_set("src").alias("requiring"))
    about = g.sections.select(F.col("id").alias("section"), "heading", "doc_title", "url", F.col("path").alias("section_path"), F.col("lines").alias("section_lines"))
    rows = concepts.join(chosen, "concept").join(askers, "concept").join(others, "concept").join(about, "section", "left").crossJoin(F.broadcast(total))
    proof = F.array(
        hop("Question ASKS_ABOUT Concept", F.col("lead.ask"), F.col("lead.q"), F.col("concept"), evidence(F.col("lead.evidence"))),
        hop("Section REQUIRES Concept", F.col("requires_edge"), F.col("section"), F.col("concept"), evidence(F.col("evidence"))),
        hop("no Section DEFINES Concept", checked=F.col("total"), found=F.lit(0)),
    )
    made = rows.select(
        F.lit("near_miss").alias("type"), "demand", "concept", F.col("label").alias("concept_label"), F.col("kind").alias("concept_kind"), "section", F.col("heading").alias("section_heading"), "doc_title", F.col("url").alias("doc_url"), "section_path", "section_lines",
        proof.alias("proof_path"), "questions", "question_titles", F.slice("shared_concepts", 1, 12).alias("shared_concepts"),
        F.array_sort(F.array_remove("requiring", F.col("section"))).alias("other_requiring_sections"), "mentions_count", "requires_count",
        F.coalesce("evidence.kind", F.lit("prose")).alias("requires_evidence_kind"), (~F.col("in_prose")).alias("code_samples_only"),
    )
    return numbered(made, "F1", F.col("demand").desc(), F.col("requires_count").desc(), "concept")


def orphans(g: Graph, least: int = MIN_SECTIONS) -> DataFrame:
    """Concepts in scope that two or more sections use and none defines, near misses left out.

    Concepts are chosen by counts; only the edges of the chosen ones are then looked at, the first six in order by rank.
    """
    counts = concept_counts(g.edges).where("defines_count = 0 AND requires_count + mentions_count > 0 AND NOT (demand > 0 AND requires_count > 0)")
    named = g.concepts.select(F.col("id").alias("concept"), "label", "kind").where(~out_of_scope(F.col("label")))
    chosen = materialize(counts.join(named, "concept"), "concepts")
    mine = lambda *types: of_type(g.edges, *types).join(chosen.select(F.col("concept").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("concept"), "type", "src", "id", "evidence")
    into = mine("REQUIRES", "MENTIONS")
    used = into.groupBy("concept").agg(F.array_sort(F.collect_set("src")).alias("sections_referencing"), F.count("*").alias("in_edges_total")).where(F.size("sections_referencing") >= least)
    first = into.withColumn("r", F.row_number().over(W.partitionBy("concept").orderBy("type", "src"))).where("r <= 6")
    proof = first.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("r", "type", "src", "id", "evidence"))).alias("uses"))
    asked = mine("ASKS_ABOUT").groupBy("concept").agg(F.array_sort(F.collect_set("src")).alias("questions"))
    rows = chosen.join(used, "concept").join(proof, "concept").join(asked, "concept", "left")
    about = g.sections.select(F.col("id").alias("section"), F.col("heading").alias("section_heading"), "doc_title", F.col("url").alias("doc_url"))
    total = g.sections.agg(F.count("*").alias("total"))
    rows = rows.withColumn("section", F.col("uses")[0]["src"]).join(about, "section", "left").crossJoin(F.broadcast(total))
    steps = F.transform("uses", lambda e: hop(F.concat(F.lit("Section "), e["type"], F.lit(" Concept")), e["id"], e["src"], F.col("concept"), evidence(e["evidence"])))
    made = rows.select(
        F.lit("orphan_concept").alias("type"), "demand", "concept", F.col("label").alias("concept_label"), F.col("kind").alias("concept_kind"), "section", "section_heading", "doc_title", "doc_url",
        F.array_append(steps, hop("no Section DEFINES Concept", checked=F.col("total"), found=F.lit(0))).alias("proof_path"), "sections_referencing", "requires_count", "mentions_count",
        F.coalesce("questions", F.array().cast("array<string>")).alias("questions"), "in_edges_total", (~F.col("in_prose")).alias("code_samples_only"),
    )
    return numbered(made, "F2", F.col("demand").desc(), F.col("in_edges_total").desc(), "concept")


def asked_sets(edges: DataFrame) -> DataFrame:
    return of_type(edges, "ASKS_ABOUT").groupBy(F.col("src").alias("question")).agg(F.array_sort(F.collect_set("dst")).alias("question_concepts"))


def held_sets(edges: DataFrame) -> DataFrame:
    return of_type(edges, *TO_CONCEPT).groupBy(F.col("src").alias("section")).agg(F.array_sort(F.collect_set("dst")).alias("section_concepts"))


def meetings(asks: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """Rows of ``asks`` with ``question_concepts`` beside rows of ``held`` with ``section_concepts``, each pair that shares ``least`` or more once, with ``shared``.

    They meet under each pair of concepts (for ``least`` 1 each concept) both have, and only the first such
    pair counts: nothing is dropped as a repeat after the join. Pairs of concepts under which very many meet
    are dealt out by the hash of the question, and a task gets a counted number of meetings.
    """
    if least < 2:
        keys = lambda c: F.transform(c, lambda x: F.array(x))
    else:
        keys = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.array(x, y))))
    left = materialize(asks.withColumn("key", F.explode(keys("question_concepts"))), "asks")
    right = materialize(held.withColumn("key", F.explode(keys("section_concepts"))), "held")
    n = lambda df, c: df.groupBy("key").agg(F.count("*").alias(c))
    counts = materialize(n(left, "asking").join(n(right, "holding"), "key").select("key", (F.col("asking") * F.col("holding")).alias("meet")), "counts")
    tasks = -(-(counts.agg(F.sum("meet")).first()[0] or 1) // MEET_A_TASK)
    busy = F.broadcast(counts.where(F.col("meet") > MEET_A_TASK // 4).select("key", F.ceil(F.col("meet") / (MEET_A_TASK // 4)).alias("hands")))
    hands = F.coalesce("hands", F.lit(1))
    dealt = left.join(busy, "key", "left").withColumn("hand", F.pmod(F.xxhash64("question"), hands)).drop("hands")
    every = right.join(busy, "key", "left").withColumn("hand", F.explode(F.sequence(F.lit(0).cast("bigint"), hands - 1))).drop("hands")
    met = dealt.repartition(tasks, "key", "hand").join(every.repartition(tasks, "key", "hand").hint("shuffle_hash"), ["key", "hand"])
    met = met.withColumn("shared", F.array_intersect("question_concepts", "section_concepts"))
    return met.where((F.col("key") == F.slice("shared", 1, min(least, 2))) & (F.size("shared") >= least)).drop("key", "hand")


def overlaps(edges: DataFrame, least: int = MIN_OVERLAP) -> DataFrame:
    """``question, section, overlap`` of pairs sharing ``least`` concepts or more."""
    return meetings(asked_sets(edges), held_sets(edges), least).select("question", "section", "shared", F.size("shared").alias("overlap"))


def best_overlaps(edges: DataFrame, k: int, least: int = MIN_OVERLAP) -> DataFrame:
    """``question, section, shared, overlap, place``: of the sections sharing ``least`` concepts or more with a question the first ``k``, most shared first.

    Questions that ask about the same concepts have the same answer, and of sections that hold the
    same concepts only the first ``k`` can come in: one question for each set meets ``k`` sections
    for each set, ids alone are ranked, and the concepts are joined to what is left.
    """
    asks, held = materialize(asked_sets(edges), "asks"), materialize(held_sets(edges), "held")
    sets = asks.groupBy("question_concepts").agg(F.min("question").alias("question"))
    kinds = held.groupBy("section_concepts").agg(F.slice(F.array_sort(F.collect_list("section")), 1, k).alias("sections"))
    met = meetings(sets, kinds, least).select(F.col("question").alias("like"), F.explode("sections").alias("section"), F.size("shared").alias("overlap"))
    first = W.partitionBy("like").orderBy(F.col("overlap").desc(), "section")
    top = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    like = asks.join(sets.withColumnRenamed("question", "like"), "question_concepts").select("question", "question_concepts", "like")
    return like.join(top, "like").join(held, "section").select("question", "section", F.array_intersect("question_concepts", "section_concepts").alias("shared"), "overlap", "place")


def competing(edges: DataFrame) -> DataFrame:
    """Per question the first five sections within 0.8 of its best overlap, if there are two."""
    q = W.partitionBy("question")
    near = best_overlaps(edges, COMPETITORS).withColumn("best", F.max("overlap").over(q)).where(F.col("overlap") >= F.col("best") * COLLISION_RATIO)
    return near.withColumn("among", F.count("*").over(q)).where("among > 1").drop("best", "among")


def collisions(g: Graph, similarity: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    """Pairs of sections that look equally on topic to a question while only one matches its answer.

    ``rivals``: ``competing(g.edges)`` where it was worked out before.
    """
    q = W.partitionBy("question")
    rows = (competing(g.edges) if rivals is None else rivals).join(similarity.select(F.col("question_id").alias("question"), F.col("section_id").alias("section"), "sim"), ["question", "section"], "left")
    rows = rows.withColumn("unknown", F.bool_or(F.col("sim").isNull()).over(q)).where("NOT unknown")
    rows = rows.withColumn("h", F.row_number().over(q.orderBy(F.col("sim").desc(), "place")))
    rows = rows.withColumn("r", F.row_number().over(q.orderBy((F.col("h") == 1).cast("int"), F.col("overlap").desc(), "sim", "place")))
    rows = materialize(rows.where("h = 1 OR r = 1").select("question", "section", "overlap", "sim", "shared", "h", "r"), "sides")  # read twice; similarities are worked out once
    side = lambda c, n: rows.where(f"{c} = 1").select("question", *[F.col(x).alias(f"{n}_{x}") for x in ("section", "overlap", "sim", "shared")])
    pairs = side("h", "holder").join(side("r", "rival"), "question").where((F.col("rival_overlap") >= F.col("holder_overlap")) & (F.col("holder_sim") - F.col("rival_sim") >= MIN_GAP))
    pair = pairs.withColumns({"lo": F.least("holder_section", "rival_section"), "hi": F.greatest("holder_section", "rival_section")})
    # questions come newest first, by number as it is written; the pair keeps the first one's roles
    first = F.struct("question", "holder_section", "rival_section", "holder_sim", "rival_sim", "holder_shared", "rival_shared", "holder_overlap", "rival_overlap")
    grouped = pair.groupBy("lo", "hi").agg(F.min(first).alias("f"), F.array_sort(F.collect_set("question")).alias("questions"))
    about = lambda n: g.sections.select(F.col("id").alias(f"{n}_id"), F.struct("id", "heading", "doc_title", "url", "path", "lines").alias(n))
    made = grouped.join(about("answer_holder"), F.col("f.holder_section") == F.col("answer_holder_id"), "left").join(about("rival"), F.col("f.rival_section") == F.col("rival_id"), "left")
    made = made.select(
        F.lit("retrieval_collision").alias("type"), F.size("questions").cast("bigint").alias("demand"), F.col("f.rival_section").alias("section"), F.col("rival.heading").alias("section_heading"), F.col("rival.doc_title").alias("doc_title"), F.col("rival.url").alias("doc_url"),
        "answer_holder", "rival", F.col("f.holder_section").alias("holder_section"), F.round("f.holder_sim", 4).alias("holder_similarity"), F.round("f.rival_sim", 4).alias("rival_similarity"),
        F.col("f.holder_overlap").alias("holder_overlap"), F.col("f.rival_overlap").alias("rival_overlap"), F.col("f.holder_shared").alias("shared_with_holder"), F.col("f.rival_shared").alias("shared_with_rival"), F.col("f.question").alias("sample_question"), "questions",
    )
    return numbered(made, "F3", F.col("demand").desc(), "section", "sample_question", "holder_section")


def findings(g: Graph, similarity: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    return near_misses(g).unionByName(orphans(g), allowMissingColumns=True).unionByName(collisions(g, similarity, rivals), allowMissingColumns=True)


def malformed(found: DataFrame) -> DataFrame:
    """Findings without a proof or with an id that is no ``F<n>-<number>`` of their type or not their own; must be empty."""
    own = F.create_map(*[F.lit(x) for kv in (("near_miss", "F1"), ("orphan_concept", "F2"), ("retrieval_collision", "F3")) for x in kv])
    times = found.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id", F.lit(True).alias("repeated"))
    right = F.col("id").rlike(r"^F[123]-\d{4,}$") & (F.substring("id", 1, 2) == F.try_element_at(own, F.col("type"))) & (F.col("demand") >= 0)
    proven = (F.size("proof_path") > 0) | (F.col("type") == "retrieval_collision")
    return found.join(times, "id", "left").where(~F.coalesce(right & proven, F.lit(False)) | F.col("repeated")).select("id", "type")


def defined_near_misses(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Near misses whose concept some section defines; must be empty."""
    return found.where("type = 'near_miss'").join(of_type(edges, "DEFINES").select(F.col("dst").alias("concept")), "concept", "left_semi").select("id", "concept")


def unshown(found: DataFrame, payload: DataFrame) -> DataFrame:
    """Ids that stand in the findings or in the payload but not in both; must be empty."""
    a, b = found.select("id", F.lit(True).alias("found")), payload.select("id", F.lit(True).alias("shown"))
    return a.join(b, "id", "full").where("found IS NULL OR shown IS NULL").select("id")


def dashes(rows: DataFrame, *columns: str) -> DataFrame:
    """``id, column`` of texts a reader sees that hold an en or em dash."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns]))
    return rows.select("id", each.alias("e")).where(F.col("e.text").rlike("[\u2013\u2014]")).select("id", "e.column")