"""Building the graph's structural edges, its counts and its integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.shared import materialize
from sparkloom.functions.text import link_targets, resolve_link, strip_markers
from sparkloom.operators.findings import concept_counts, of_type
from sparkloom.schema import ENDS, EVIDENCE, TO_CONCEPT, Graph

EDGE = ["type", "src", "dst", "evidence", "extractor", "confidence"]


def structural(rows: DataFrame, type_: str, src, dst, span, path, start, end) -> DataFrame:
    lines = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    proof = F.struct(span.alias("span"), path.alias("path"), lines.alias("lines"), F.lit(None).cast("string").alias("kind")).cast(EVIDENCE)
    return rows.select(F.lit(type_).alias("type"), src.alias("src"), dst.alias("dst"), proof.alias("evidence"), F.lit("structural").alias("extractor"), F.lit("high").alias("confidence"))


def contains_edges(sections: DataFrame) -> DataFrame:
    first = F.split("text", "\n")[0]
    return structural(sections, "CONTAINS", F.col("doc_id"), F.col("id"), first, F.col("path"), F.col("lines.start"), F.col("lines.start"))


def link_edges(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """The first link from each section to each other known page."""
    lines = sections.select("id", "doc_id", "path", "lines", F.posexplode(F.split("text", "\n")).alias("n", "line")).where(F.col("line").contains("]("))
    links = lines.select("*", F.posexplode(link_targets(F.col("line"))).alias("k", "target"))
    page = F.regexp_replace("doc_id", "^doc:", "")
    found = links.withColumn("dst", F.concat(F.lit("doc:"), F.regexp_replace(resolve_link(F.col("target"), page), r"\.md$", ""))).where("dst IS NOT NULL AND dst <> doc_id")
    known = found.join(docs.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    first = known.withColumn("r", F.row_number().over(W.partitionBy("id", "dst").orderBy("n", "k"))).where("r = 1")
    at = F.col("lines.start") + F.col("n")
    return structural(first, "LINKS_TO", F.col("id"), F.col("dst"), F.trim("line"), F.col("path"), at, at)


def answer_edges(questions: DataFrame, answers: DataFrame, marker: str = "## Accepted answer") -> DataFrame:
    """Question to answer, at the line of the rendered thread that opens the answer, else its first."""
    both = questions.select("id", "number", "raw").join(answers.select(F.col("id").alias("answer"), F.col("question_id").alias("id")), "id")
    at = F.coalesce(F.array_position(F.transform(F.split("raw", "\n"), lambda x: x.startswith(marker)), True), F.lit(0))
    line = F.greatest(at, F.lit(1))
    return structural(both, "ANSWERED_BY", F.col("id"), F.col("answer"), F.split("raw", "\n")[line - 1], F.concat(F.lit("discussions/"), F.col("number"), F.lit(".md")), line, line)


def in_order(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """Adds ``ordinal``, dense from 1 in the order of the given columns, without a single-task window: sorted parts, then an offset for each."""
    spread = rows.repartitionByRange(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # written once: a second run could cut the ranges elsewhere
    marked = materialize(spread.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}), "ordered")
    sizes = marked.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(W.orderBy("_part")) - F.col("n")).select("_part", "_before")  # a row for each part
    return marked.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def with_ids(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Dense ids in the order of type, source, target."""
    return in_order(edges.select(*EDGE), "type", "src", "dst", parts=parts).select(F.format_string("e:%05d", "ordinal").alias("id"), "ordinal", *EDGE)


def replace_type(edges: DataFrame, type_: str, new: DataFrame) -> DataFrame:
    return edges.where(F.col("type") != type_).unionByName(new, allowMissingColumns=True)


def used_concepts(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts that some edge still touches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return concepts.join(ends, "id", "left_semi")


def sanity(g: Graph) -> DataFrame:
    """One row: concepts defined, required, orphan, in two sections or more, and nodes without edges."""
    counts = g.concepts.select(F.col("id").alias("concept")).join(concept_counts(g.edges), "concept", "left")
    spread = of_type(g.edges, *TO_CONCEPT).groupBy(F.col("dst").alias("concept")).agg(F.countDistinct("src").alias("sections"))
    n = lambda c: F.count_if(F.expr(c))
    concept = counts.join(spread, "concept", "left").agg(n("defines_count > 0").alias("defined"), n("requires_count > 0").alias("required"), n("coalesce(defines_count, 0) = 0").alias("orphan"), n("sections >= 2").alias("in_two_sections"))
    return concept.join(isolated(g).agg(F.count("*").alias("isolated")))


def nodes(g: Graph) -> DataFrame:
    kinds = (("Doc", g.docs), ("Section", g.sections), ("Concept", g.concepts), ("Question", g.questions), ("Answer", g.answers))
    made = [t.select("id", F.lit(k).alias("kind")) for k, t in kinds]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def isolated(g: Graph) -> DataFrame:
    return nodes(g).join(g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def dangling(g: Graph) -> DataFrame:
    ends = g.edges.select(F.col("id").alias("edge"), F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(nodes(g).select("id").distinct(), "id", "left_anti").select("edge", F.col("id").alias("missing"))


def without_evidence(edges: DataFrame) -> DataFrame:
    e = F.col("evidence")
    whole = (F.length(F.trim(e["span"])) > 0) & (F.length(e["path"]) > 0) & (e["lines"]["start"] >= 1) & (e["lines"]["start"] <= e["lines"]["end"])
    return edges.where(~F.coalesce(whole, F.lit(False))).select("id", "type")


def kind_of(node: Column) -> Column:
    return F.split_part(node, F.lit(":"), F.lit(1))


def wrong_ends(edges: DataFrame) -> DataFrame:
    right = F.create_map(*[F.lit(x) for t, (a, b) in ENDS.items() for x in (t, f"{a}>{b}")])
    ends = F.concat(kind_of(F.col("src")), F.lit(">"), kind_of(F.col("dst")))
    return edges.where(~F.coalesce(F.try_element_at(right, F.col("type")) == ends, F.lit(False))).select("id", "type")


def end_pairs(edges: DataFrame) -> DataFrame:
    """Ordered pairs of node kinds under each edge type."""
    return edges.groupBy("type").agg(F.countDistinct(F.struct(kind_of(F.col("src")), kind_of(F.col("dst")))).alias("pairs"))


def reciprocal(edges: DataFrame) -> DataFrame:
    one = edges.select("src", "dst").distinct()
    return one.where("src < dst").join(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def parallel(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("edges")).where("edges > 1")


def double_relations(edges: DataFrame) -> DataFrame:
    """Pairs that carry a definition beside another relation."""
    kinds = of_type(edges, *TO_CONCEPT).groupBy("src", "dst").agg(F.bool_or(F.col("type") == "DEFINES").alias("d"), F.countDistinct("type").alias("n"))
    return kinds.where("d AND n > 1").select("src", "dst")


def cited_texts(sections: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """``path, first, text`` of what edges cite: sections by their page, their code samples, and rendered threads ``(number, raw)``."""
    own = sections.select("path", F.col("lines.start").alias("first"), "text")
    code = sections.select(F.explode("code").alias("c")).select("c.path", F.col("c.lines.start").alias("first"), "c.text")
    held = own.unionByName(code)
    if threads is not None:
        held = held.unionByName(threads.select(F.concat(F.lit("discussions/"), F.col("number"), F.lit(".md")).alias("path"), F.lit(1).alias("first"), F.col("raw").alias("text")))
    return held.dropDuplicates(["path", "first", "text"])


def flat(c: Column) -> Column:
    """Single-spaced lower case."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def holds(text: Column, span: Column) -> Column:
    """Whether a text holds a span, as it is or without markdown marks on both."""
    return text.contains(span) | strip_markers(text).contains(strip_markers(span))


def lost_spans(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges whose span stands in no text of the path it cites; must be empty. ``texts``: ``path, first, text``."""
    cited = edges.select("id", F.col("evidence.path").alias("path"), flat(F.col("evidence.span")).alias("span"))
    found = cited.join(texts.select("path", flat(F.col("text")).alias("text")), "path").where(holds(F.col("text"), F.col("span"))).select("id").distinct()
    return cited.select("id", "path").distinct().join(found, "id", "left_anti")


def misplaced_spans(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges whose span does not stand in the lines it cites; must be empty. ``texts``: ``path, first, text``."""
    cited = edges.select("id", "src", F.col("evidence.path").alias("path"), F.col("evidence.lines.start").alias("lo"), F.col("evidence.lines.end").alias("hi"), flat(F.col("evidence.span")).alias("span"))
    lines = texts.select("path", "first", F.split("text", "\n").alias("all"))
    at = cited.join(lines, "path").where((F.col("lo") >= F.col("first")) & (F.col("hi") < F.col("first") + F.size("all")) & (F.col("hi") >= F.col("lo")))
    window = F.array_join(F.slice("all", F.col("lo") - F.col("first") + 1, F.col("hi") - F.col("lo") + 1), " ")
    right = at.where(holds(flat(window), F.col("span"))).select("id").distinct()
    return cited.select("id", "src").distinct().join(right, "id", "left_anti")


def aliased(path: Column, roots: dict[str, str]) -> Column:
    """A path under the first of the given roots it begins with, put under that root's place."""
    made = path
    for root, place in reversed(roots.items()):
        made = F.when(path.startswith(root), F.concat(F.lit(place), F.substr(path, F.lit(len(root) + 1)))).otherwise(made)
    return made
