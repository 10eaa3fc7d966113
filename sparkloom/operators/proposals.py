"""From proposed relations to validated edges, with one reason for every one dropped.

``proposals``: ``batch_id, section_id, pos, type, concept, span, confidence``, one row each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, StringType, StructType

from sparkloom.functions.text import MIN_SPAN, clean_label, concept_id, locate, normalize, normalized, place, trimmed
from sparkloom.schema import TO_CONCEPT

AT = StructType().add("k", IntegerType()).add("path", StringType()).add("lines", StructType().add("start", IntegerType()).add("end", IntegerType()))
#: In order of precedence.
REASONS = ("unknown_section", "bad_type", "short_span", "heading_only", "span_not_found", "duplicate")
SCHEMA = "map<string,struct<concepts:array<struct<label:string,kind:string,aliases:array<string>>>,edges:array<struct<type:string,concept:string,span:string,confidence:string>>>>"


def exploded(replies: DataFrame) -> DataFrame:
    """Proposals of ``replies(batch_id, reply)``, whose replies are JSON objects keyed by section."""
    keyed = replies.select("batch_id", F.explode(F.from_json("reply", SCHEMA)).alias("section_id", "said"))
    return keyed.select("batch_id", "section_id", F.posexplode("said.edges").alias("pos", "e")).select("batch_id", "section_id", "pos", "e.*")


def confidence(said: Column) -> Column:
    low = F.lower(trimmed(said))
    return F.when(low.isin("high", "medium", "low"), low).otherwise("medium")


@F.pandas_udf(AT)
def first_place(spans: pd.Series, tried: pd.Series) -> pd.DataFrame:
    """The first of several texts that holds the span: its number, its path and the lines."""
    rows = []
    for span, texts in zip(spans, tried, strict=True):
        hit = None
        for k, t in enumerate(texts if span is not None and texts is not None else ()):
            if t["text"] is not None and (lines := place(span, t["text"], int(t["first"]), normalized)):
                hit = (k, t["path"], {"start": lines[0], "end": lines[1]})
                break
        rows.append(hit or (None, None, None))
    return pd.DataFrame(rows, columns=["k", "path", "lines"]).astype({"k": "Int32"})


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``at``: where the span stands in the section's text, else in the first code sample that has it; null where nowhere.

    A section's texts go to one function as they are, so no row is multiplied and nothing is shuffled.
    """
    own = F.array(F.struct(F.col("text").alias("text"), F.col("path").alias("path"), F.col("lines.start").alias("first")))
    code = F.coalesce(F.transform("code", lambda c: F.struct(c["text"].alias("text"), c["path"].alias("path"), c["lines"]["start"].alias("first"))), F.array())
    found = rows.withColumn("at", first_place(F.col("span"), F.concat(own, code)))
    return found.withColumn("at", F.when(F.col("at.lines").isNotNull(), F.col("at"))).drop("text", "code")


def judged(proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """Every proposal with ``drop_reason``, null where the edge is kept, and where its span stands."""
    known = sections.select(F.col("id").alias("section_id"), "text", "path", "lines", "code")
    rows = proposals.join(known, "section_id", "left")
    kind, label = F.upper(trimmed(F.col("type"))), clean_label(F.col("concept"))
    rows = rows.withColumns({"kind": F.when(kind.isin(*TO_CONCEPT) & (F.coalesce(label, F.lit("")) != ""), kind), "label": label, "concept_id": concept_id(label), "flat": normalize(F.col("span")), "head": normalize(F.split("text", "\n")[0])})
    early = (
        F.when(F.col("path").isNull(), "unknown_section").when(F.col("kind").isNull(), "bad_type")
        .when(F.length(F.coalesce("flat", F.lit(""))) < MIN_SPAN, "short_span").when(F.col("flat") == F.col("head"), "heading_only")
    )
    rows = rows.withColumn("early", early)
    tried = placed(rows.where("early IS NULL")).withColumn("late", F.when(F.col("at").isNull(), "span_not_found"))
    first = W.partitionBy("section_id", "concept_id", "kind", "late").orderBy("batch_id", "pos")
    tried = tried.withColumn("reason", F.coalesce("late", F.when(F.row_number().over(first) > 1, "duplicate")))
    out = ["batch_id", "section_id", "pos", "kind", "label", "concept_id", "span", F.col("confidence"), "path"]
    none = F.lit(None)
    done = rows.where("early IS NOT NULL").select(*out, none.cast("string").alias("found_in"), none.cast("struct<start:int,end:int>").alias("found_at"), F.col("early").alias("drop_reason"))
    return tried.select(*out, F.col("at.path").alias("found_in"), F.col("at.lines").alias("found_at"), F.col("reason").alias("drop_reason")).unionByName(done)


def edges_of(judged_rows: DataFrame, extractor: str = "model") -> DataFrame:
    kept = judged_rows.where("drop_reason IS NULL")
    proof = F.struct("span", F.col("found_in").alias("path"), F.col("found_at").alias("lines"), F.when(F.col("found_in") == F.col("path"), "prose").otherwise("code").alias("kind"))
    return kept.select(F.col("kind").alias("type"), F.col("section_id").alias("src"), F.col("concept_id").alias("dst"), proof.alias("evidence"), F.lit(extractor).alias("extractor"), confidence(F.col("confidence")).alias("confidence"))


def ledger(judged_rows: DataFrame) -> DataFrame:
    """``proposed, kept`` and one count for each reason; proposals for unknown sections are counted apart."""
    n = [F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in REASONS]
    return judged_rows.agg(F.count_if(F.coalesce(F.col("drop_reason") != "unknown_section", F.lit(True))).alias("proposed"), F.count_if(F.col("drop_reason").isNull()).alias("kept"), *n)


def not_found(judged_rows: DataFrame, most: int = 40) -> DataFrame:
    """The first spans that stand nowhere, as a report shows them: ``batch_id, section_id, pos, concept_id, span``."""
    return judged_rows.where("drop_reason = 'span_not_found'").select("batch_id", "section_id", "pos", "concept_id", "span").orderBy("batch_id", "section_id", "pos").limit(most)


def broken_ledger(ledger_row: DataFrame) -> DataFrame:
    """The ledger where what was dropped is not what is missing; must be empty."""
    inside = [F.col(f"dropped_{r}") for r in REASONS if r != "unknown_section"]
    return ledger_row.where(F.col("proposed") - F.col("kept") != sum(inside[1:], inside[0]))


def sweep_landed(edges: DataFrame) -> DataFrame:
    """How many definitions of the graph came from the sweep."""
    return edges.agg(F.count_if(F.col("extractor") == "definition-sweep").alias("landed"))


def voted_concepts(named: DataFrame) -> DataFrame:
    """Concepts from ``named(concept_id, label, kind, ordinal)``: the kind and label with the most votes.

    Ties: the greater kind; the shorter label, then the first. ``surface_forms`` are all labels.
    """
    kinds = named.groupBy("concept_id", "kind").agg(F.count("*").alias("n")).groupBy("concept_id").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    labels = named.groupBy("concept_id", "label").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    chosen = labels.groupBy("concept_id").agg(F.max_by("label", F.struct("n", -F.length("label"), -F.col("first"))).alias("label"), F.array_sort(F.collect_set("label")).alias("surface_forms"))
    return chosen.join(kinds, "concept_id").select(F.col("concept_id").alias("id"), "label", "kind", F.array_except("surface_forms", F.array("label")).alias("aliases"), "surface_forms")


def resolver(concepts: DataFrame) -> DataFrame:
    """``key, concept``: what a name means; a label beats other forms, the last label and the first other form win."""
    name = lambda c: F.lower(trimmed(c))
    labels = concepts.select(name(F.col("label")).alias("key"), "id", F.lit(0).alias("rank"))
    others = concepts.select(F.explode(F.concat("surface_forms", "aliases")).alias("f"), "id").select(name(F.col("f")).alias("key"), "id", F.lit(1).alias("rank"))
    ends = labels.unionByName(others).groupBy("key").agg(F.max(F.when(F.col("rank") == 0, F.col("id"))).alias("label_id"), F.min(F.when(F.col("rank") == 1, F.col("id"))).alias("other_id"))
    return ends.select("key", F.coalesce("label_id", "other_id").alias("concept"))


def asked_edges(asked: DataFrame, questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Judges ``asked(batch_id, question_id, pos, label, span, confidence)`` like proposals; a span is tried again without markdown marks."""
    known = questions.select(F.col("id").alias("question_id"), "body", "path")
    rows = asked.join(known, "question_id", "left").withColumn("key", F.lower(clean_label(F.col("label")))).join(resolver(concepts), "key", "left")
    rows = rows.withColumns({"flat": normalize(F.col("span")), "w": locate(F.col("span"), F.col("body"), F.lit(1), F.lit(True))})
    reason = F.when(F.col("path").isNull(), "unknown_question").when(F.col("concept").isNull(), "unknown_concept").when(F.length(F.coalesce("flat", F.lit(""))) < MIN_SPAN, "short_span").when(F.col("w.start").isNull(), "span_not_found")
    rows = rows.withColumn("early", reason)
    first = W.partitionBy("question_id", "concept", "early").orderBy("batch_id", "pos")
    rows = rows.withColumn("drop_reason", F.coalesce("early", F.when(F.row_number().over(first) > 1, "duplicate")))
    return rows.select("batch_id", "question_id", "pos", "label", "concept", "span", confidence(F.col("confidence")).alias("confidence"), F.struct(F.col("w.start").alias("start"), F.col("w.end").alias("end")).alias("lines"), F.col("w.stripped").alias("recovered"), "drop_reason")


def unknown_labels(judged_rows: DataFrame, most: int = 25) -> DataFrame:
    return judged_rows.where("drop_reason = 'unknown_concept'").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most)


def sweep_targets(edges: DataFrame) -> DataFrame:
    """Concepts to look for definitions of: none yet, and used in two sections or asked about."""
    per = edges.groupBy(F.col("dst").alias("concept")).agg(
        F.count_if(F.col("type") == "DEFINES").alias("d"), F.size(F.collect_set(F.when(F.col("type").isin("REQUIRES", "MENTIONS"), F.col("src")))).cast("bigint").alias("sections"), F.count_if(F.col("type") == "ASKS_ABOUT").alias("asked")
    )
    return per.where("d = 0 AND (sections >= 2 OR asked > 0) AND concept LIKE 'concept:%'").select("concept", "sections", "asked")


def sweep_edges(found: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions from ``found(path, concept, span, confidence)``: the first section of the page that has the span, if not yet an edge."""
    rows = found.join(sections.select(F.col("id").alias("section_id"), "text", "path", "lines", "code"), "path")
    hit = placed(rows).where("at IS NOT NULL")
    one = hit.withColumn("r", F.row_number().over(W.partitionBy("path", "concept", "span").orderBy("lines.start"))).where("r = 1")
    proof = F.struct("span", F.col("at.path").alias("path"), F.col("at.lines").alias("lines"), F.when(F.col("at.path") == F.col("path"), "prose").otherwise("code").alias("kind"))
    made = one.select(F.lit("DEFINES").alias("type"), F.col("section_id").alias("src"), F.col("concept").alias("dst"), proof.alias("evidence"), F.lit("definition-sweep").alias("extractor"), confidence(F.col("confidence")).alias("confidence"))
    first = made.withColumn("r", F.row_number().over(W.partitionBy("src", "dst").orderBy("evidence.lines.start", "evidence.span"))).where("r = 1").drop("r")
    return first.join(edges.where("type = 'DEFINES'").select("src", "dst"), ["src", "dst"], "left_anti")


def candidate_concepts(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts offered for mapping questions: defined or required somewhere, with the number of sections that touch them."""
    per = edges.where(F.col("type").isin(*TO_CONCEPT)).groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("type") != "MENTIONS").alias("strong"), F.countDistinct("src").alias("sections"))
    return concepts.select("id", "label").join(per.where("strong > 0"), "id").select("id", "label", "sections")
