"""Work units for an outside model: fixed-size and packed batches, their prompts, what is left to do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_SECTIONS, MOST_CHARS = 12, 18_000


def fixed(rows: DataFrame, size: int, group: str, *order: str) -> DataFrame:
    """Numbers of batches of ``size`` rows within each ``group``."""
    at = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((at - 1) / size).cast("int"))


def packed(sections: DataFrame, most: int = MOST_SECTIONS, chars: int = MOST_CHARS) -> DataFrame:
    """``doc_id, part, id``: each page's sections in order, a new part when one more section would break a limit."""

    def pack(pages: pd.DataFrame) -> pd.DataFrame:
        part, held, size, out = 1, 0, 0, []
        for n in pages.sort_values("start")["size"]:
            if held and (held >= most or size + n > chars):
                part, held, size = part + 1, 0, 0
            held, size = held + 1, size + n
            out.append(part)
        return pages.sort_values("start").assign(part=out)[["doc_id", "part", "id"]]

    rows = sections.select("doc_id", "id", F.col("lines.start").alias("start"), F.length("text").alias("size"))
    return rows.groupBy("doc_id").applyInPandas(pack, "doc_id string, part int, id string")


def prompts(batched: DataFrame, sections: DataFrame, head: str, most: int = 3000) -> DataFrame:
    """``doc_id, part, prompt``: the batch's sections, each cut to ``most`` characters, under one heading text."""
    text = F.format_string("## %s\n%s", F.coalesce("heading", F.lit("")), F.substring("text", 1, most))
    rows = batched.join(sections.select("id", "heading", "text", "lines"), "id").select("doc_id", "part", F.struct("lines.start", text.alias("t")).alias("s"))
    return rows.groupBy("doc_id", "part").agg(F.concat(F.lit(head + "\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n\n")).alias("prompt"))


def from_template(rows: DataFrame, batch: str, order: str, template: str, limits: dict[str, int] | None = None, head: str = "", between: str = "\n\n") -> DataFrame:
    """``batch, prompt``: each row as ``template`` with its ``{column}`` places filled, in order, under one heading text.

    The form of every prompt that lists records: questions to map, definitions to look for,
    contexts to answer from, answers to score, findings to describe and to validate. A column
    in ``limits`` is cut to so many characters, a null one is empty.
    """
    limits = limits or {}
    parts: list[Column] = []
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        value = F.lit(part) if k % 2 == 0 else F.coalesce(F.col(part).cast("string"), F.lit(""))
        parts.append(F.substring(value, 1, limits[part]) if k % 2 and part in limits else value)
    made = rows.select(batch, F.struct(F.col(order).alias("o"), F.concat(*parts).alias("t")).alias("s"))
    return made.groupBy(batch).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), between)).alias("prompt"))


def missing(batches: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    return batches.join(done.select(key).distinct(), key, "left_anti")


def progress(batches: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    marked = batches.select(key).distinct().join(done.select(key).distinct().withColumn("d", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("batches"), F.count_if("d").alias("done"), F.count_if(F.col("d").isNull()).alias("missing"))


def completed(prompts_: DataFrame, complete, key: str = "batch_id") -> DataFrame:
    """``key, reply`` by an injected ``complete(prompt) -> str``, called for a partition's rows in turn."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "reply": [complete(p) for p in f["prompt"]]})

    return prompts_.select(key, "prompt").mapInPandas(call, f"{key} string, reply string")
