"""Pages into line-addressed sections.

``pages(path, text)`` has one row a page. Headings come from a fold over the page's lines
that knows whether a fence is open; sections, titles and anchors are windows over headings.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkloom.functions.text import anchor_of, display_heading, fold_path, page_url, slugify

#: An include mark: braces with stars inside them around a path, then options up to the closing star.
INCLUDE = r"\{\*[ \t]*([^\s*]+)([^*]*)\*\}"
SPAN = r"\bln\[[ ]*([0-9]+)[ ]*:[ ]*([0-9]+)[ ]*\]"


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")


def heading_lines(lines: Column) -> Column:
    """Numbers, from 1, of heading lines outside fences.

    A fence of three marks or more opens; the next fence line that starts with three of the
    same mark closes it, whatever follows; others inside are text.
    """
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    kept = F.filter(numbered, lambda x: x["line"].rlike(r"^\s*(?:`{3,}|~{3,})|^#{1,6}\s+"))
    mark = lambda x: F.substring(F.ltrim(F.regexp_replace(x, r"^\s+", "")), 1, 1)

    def step(state: Column, x: Column) -> Column:
        fence = x["line"].rlike(r"^\s*(?:`{3,}|~{3,})")
        opened = F.when(fence & (state["open"] == ""), mark(x["line"])).when(fence & (state["open"] == mark(x["line"])), F.lit("")).otherwise(state["open"])
        found = F.when(~fence & (state["open"] == ""), F.array_append(state["at"], x["n"])).otherwise(state["at"])
        return F.struct(opened.alias("open"), found.alias("at"))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(kept, start, step, lambda s: s["at"])


@F.pandas_udf(ArrayType(StringType()))
def anchors(slugs: pd.Series) -> pd.Series:
    """Of a page's slugs, in order, an anchor each, no two alike: a repeat gets the first number from 2 that makes it new."""

    def distinct(page: list[str]) -> list[str]:
        taken, times, out = set(page), Counter(), []
        for slug in page:
            times[slug] += 1
            name = slug
            if times[slug] > 1:
                n = times[slug]
                while (name := f"{slug}-{n}") in taken:
                    n += 1
                times[slug] = n
                taken.add(name)
            out.append(name)
        return out

    return slugs.map(distinct)


def split_pages(pages: DataFrame, root: str = "docs", base: str = "") -> DataFrame:
    """Sections of all pages: a heading owns the lines up to the next one; a page without headings is one section."""
    page = pages.select("path", lines_of(F.col("text")).alias("all")).withColumn("at", heading_lines(F.col("all")))
    stem = F.regexp_replace("path", r"\.md$", "")
    named = F.initcap(F.replace(F.regexp_extract(stem, "([^/]*)$", 1), F.lit("-"), F.lit(" ")))
    page = page.withColumns({"stem": stem, "starts": F.when(F.size("at") > 0, F.col("at")).otherwise(F.array(F.lit(1))), "headed": F.size("at") > 0})
    cut = page.select("*", F.posexplode("starts").alias("k", "start"))
    cut = cut.withColumn("end", F.coalesce(F.try_element_at("starts", F.col("k") + 2) - 1, F.size("all")))
    raw = F.regexp_replace(F.regexp_replace(F.element_at("all", F.col("start")), r"^#{1,6}\s+", ""), r"\s+$", "")
    cut = cut.withColumns({"raw": F.when(F.col("headed"), raw).otherwise(named), "level": F.when(F.col("headed"), F.length(F.regexp_extract(F.element_at("all", F.col("start")), "^(#+)", 1))).otherwise(1), "text": F.array_join(F.slice("all", F.col("start"), F.col("end") - F.col("start") + 1), "\n")})
    cut = cut.withColumn("heading", F.when(F.col("headed"), display_heading(F.col("raw"))).otherwise(F.col("raw")))
    one = F.first(F.when(F.col("headed") & (F.col("level") == 1), F.col("heading")), True).over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    cut = cut.withColumn("doc_title", F.coalesce(one, named)).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    slug = F.when(F.col("headed"), F.coalesce(anchor_of(F.col("raw")), slugify(F.col("heading")))).otherwise(slugify(F.col("heading")))
    cut = cut.withColumn("slug", slug).withColumn("place", F.row_number().over(W.partitionBy("path").orderBy("start")))
    named = F.array_sort(F.collect_list(F.struct("place", "slug")).over(W.partitionBy("path")))
    cut = cut.withColumn("anchor", F.element_at(anchors(F.transform(named, lambda x: x["slug"])), F.col("place").cast("int")))
    url = page_url(F.col("path"), base)
    return cut.select(
        F.concat(F.lit("sec:"), "stem", F.lit("#"), "anchor").alias("id"), F.concat(F.lit("doc:"), "stem").alias("doc_id"), "doc_title", "heading", F.col("level").cast("int").alias("level"), F.concat(F.lit(f"{root}/"), "path").alias("path"),
        F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).alias("lines"), "anchor", F.when(F.col("level") > 1, F.concat(url, F.lit("#"), "anchor")).otherwise(url).alias("url"), "text", F.length("text").alias("chars"),
    )


def page_docs(sections: DataFrame, base: str = "") -> DataFrame:
    return sections.groupBy(F.col("doc_id").alias("id")).agg(F.first("doc_title").alias("title"), F.first("path").alias("path"), F.min_by(F.regexp_replace("url", "#.*$", ""), F.col("lines.start")).alias("url"))


def with_code(sections: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``code`` and ``embed_text``: the slices of ``files(path, text)`` that the section's include marks name, in order."""
    marks = F.regexp_extract_all("text", F.lit(INCLUDE), F.lit(0))
    each = sections.where(F.col("text").contains("{*")).select("id", F.posexplode(marks).alias("k", "mark"))
    each = each.select("id", "k", fold_path(F.regexp_extract("mark", INCLUDE, 1)).alias("file"), F.regexp_extract("mark", SPAN, 1).alias("a"), F.regexp_extract("mark", SPAN, 2).alias("b"))
    held = files.select(F.col("path").alias("file"), lines_of(F.col("text")).alias("all"))
    lo = F.greatest(F.coalesce(F.try_to_number("a", F.lit("999999999")).cast("int"), F.lit(1)), F.lit(1))
    hi = F.least(F.coalesce(F.try_to_number("b", F.lit("999999999")).cast("int"), F.size("all")), F.size("all"))
    cut = each.join(held, "file").withColumns({"lo": lo, "hi": hi}).where("hi >= lo")
    piece = F.struct("k", F.col("file").alias("path"), F.col("file").alias("raw_path"), F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")).alias("lines"), F.array_join(F.slice("all", F.col("lo"), F.col("hi") - F.col("lo") + 1), "\n").alias("text"))
    code = cut.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(piece)), lambda c: F.struct(c["path"].alias("path"), c["raw_path"].alias("raw_path"), c["lines"].alias("lines"), c["text"].alias("text"))).alias("code"))
    made = sections.join(code, "id", "left")
    parts = F.concat(F.array("heading", "text"), F.coalesce(F.transform("code", lambda c: c["text"]), F.array().cast("array<string>")))
    return made.withColumn("embed_text", F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n\n"))


def broken_cuts(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections whose text is not what stands in their lines; must be empty."""
    held = pages.select(F.concat(F.lit("doc:"), F.regexp_replace("path", r"\.md$", "")).alias("doc_id"), lines_of(F.col("text")).alias("all"))
    there = F.array_join(F.slice("all", F.col("lines.start"), F.col("lines.end") - F.col("lines.start") + 1), "\n")
    return sections.join(held, "doc_id").where(there != F.col("text")).select("id")


def size_stats(sections: DataFrame) -> DataFrame:
    """Count, upper median, largest, small and code-carrying sections. The median is a rank, found by counting, not by collecting."""
    ranked = sections.groupBy("chars").agg(F.count("*").alias("n"), F.count_if(F.size("code") > 0).alias("coded"))
    total = F.sum("n").over(W.partitionBy())
    ranked = ranked.withColumns({"upto": F.sum("n").over(W.orderBy("chars")), "total": total})
    return ranked.agg(F.sum("n").alias("sections"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("chars"))).alias("median_chars"), F.max("chars").alias("max_chars"), F.coalesce(F.sum(F.when(F.col("chars") < 200, F.col("n"))), F.lit(0)).alias("under_200"), F.sum("coded").alias("with_code"))
