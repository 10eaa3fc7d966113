"""The stages as one plan, and the one-row report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.shared import materialize
from sparkloom.operators import graph as gr
from sparkloom.operators import proposals
from sparkloom.schema import Graph


def build(docs: DataFrame, sections: DataFrame, concepts: DataFrame, questions: DataFrame, answers: DataFrame, *edge_sets: DataFrame, threads: DataFrame | None = None, found: DataFrame | None = None) -> Graph:
    """A graph of structural edges and the given ones; concepts without an edge are dropped, edges get dense ids.

    ``threads``: rendered threads ``(number, raw)``, for the edges from questions to answers.
    ``found``: definitions ``(path, concept, span, confidence)`` of the sweep; those of concepts
    that are still to be defined, and that stand where they say, become edges.
    """
    edges = gr.contains_edges(sections).unionByName(gr.link_edges(sections, docs))
    if threads is not None:
        edges = edges.unionByName(gr.answer_edges(questions.join(threads, "number"), answers))
    for e in edge_sets:
        edges = edges.unionByName(e.select(*gr.EDGE))
    if found is not None:
        edges = materialize(edges, "edges")
        wanted = found.join(proposals.sweep_targets(edges).select("concept"), "concept", "left_semi")
        edges = edges.unionByName(proposals.sweep_edges(wanted, sections, edges).select(*gr.EDGE))
    numbered = gr.with_ids(edges)
    return Graph(docs, sections, gr.used_concepts(concepts, numbered), questions, answers, numbered)


def manifest(g: Graph, found: DataFrame) -> DataFrame:
    """One row: sizes by kind as maps, findings by type, and the sanity counts."""
    by = lambda df, k, name: df.groupBy(k).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(name))
    return by(gr.nodes(g), "kind", "nodes").join(by(g.edges, "type", "edges")).join(by(found, "type", "findings")).join(gr.sanity(g))


def reached(found: DataFrame) -> DataFrame:
    """``type, threads``: distinct askers of each type of finding."""
    return found.select("type", F.explode("questions").alias("q")).groupBy("type").agg(F.countDistinct("q").alias("threads"))
