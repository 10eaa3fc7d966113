"""Readers and writers of pages, threads, model replies, payloads and cached vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.text import repaired_json
from sparkloom.operators.graph import in_order
from sparkloom.schema import THREADS

MIN_ANSWER, MIN_QUESTION, PAGES = 120, 80, 60
MAINTAINERS = ("OWNER", "MEMBER", "COLLABORATOR")


def read_pages(spark: SparkSession, folder: str, suffix: str = ".md") -> DataFrame:
    """``path, text, bytes, lines`` of the files below ``folder``; line ends become line feeds."""
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").select("value", F.col("_metadata.file_path").alias("file"))
    root = folder.removeprefix("file://").rstrip("/") + "/"
    text = F.regexp_replace("value", r"\r\n?", "\n")
    path = F.replace(F.regexp_replace("file", "^file:/+", "/"), F.lit(root), F.lit(""))
    return raw.select(path.alias("path"), text.alias("text"), F.octet_length("value").alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"))


def nav_order(nav: DataFrame) -> DataFrame:
    """``path, rank`` of the pages under ``nav:`` in a configuration text ``(text)``; the first place of a page counts."""
    lines = nav.select(F.posexplode(F.split("text", "\n")).alias("n", "line"))
    top = F.when(F.col("line").rlike(r"^\S") & ~F.col("line").startswith("#"), F.col("line"))
    section = F.last(top, True).over(W.orderBy("n"))  # one small file
    inside = lines.withColumn("in", section).where(F.col("in").startswith("nav:")).withColumn("path", F.regexp_extract("line", r"([\w./-]+\.md)\s*['\"]?\s*$", 1)).where("path <> ''")
    return inside.groupBy("path").agg(F.min("n").alias("n")).select("path", F.row_number().over(W.orderBy("n")).alias("rank"))


def select_pages(pages: DataFrame, nav: DataFrame, most: int = PAGES) -> DataFrame:
    """The pages to read: tutorial first, then advanced, top level, the rest; within a group by navigation, then path."""
    group = F.when(F.col("path").startswith("tutorial/"), 0).when(F.col("path").startswith("advanced/"), 1).when(~F.col("path").contains("/"), 2).otherwise(3)
    rows = pages.join(F.broadcast(nav), "path", "left").withColumns({"group": group, "rank": F.coalesce("rank", F.lit(10000))})
    return rows.orderBy("group", "rank", "path").limit(most)


def is_maintainer(association: Column) -> Column:
    return F.coalesce(association.isin(*MAINTAINERS), F.lit(False))


def read_threads(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(THREADS).json(folder, multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json")


def substantial(threads: DataFrame, answer: int = MIN_ANSWER, question: int = MIN_QUESTION) -> DataFrame:
    """Threads whose answer and question are long enough to be about something."""
    size = lambda c: F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return threads.where((size("answer.body") >= answer) & (size("body") >= question))


def newest(threads: DataFrame) -> DataFrame:
    """Threads with their ``place``, the highest number first, as prompts and reports list them."""
    lowest = in_order(threads.withColumn("_back", -F.col("number")), "_back").drop("_back")
    return lowest.withColumnRenamed("ordinal", "place")


def fetch_report(pages: DataFrame, threads: DataFrame, commit: str, source: str) -> DataFrame:
    """One JSON text on what was read: the pinned commit, the pages with bytes and lines, and the threads by descending number."""
    if not re.fullmatch(r"[0-9a-f]{40}", commit):
        raise ValueError(f"{commit!r} is no full commit hash")
    page = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.array_sort(F.collect_list(F.struct("path", "bytes", "lines"))).alias("listed"))
    listed = F.sort_array(F.collect_list(F.struct("number", "title")), False)
    thread = threads.agg(F.count("*").alias("threads"), listed.alias("numbers"))
    return page.crossJoin(thread).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(source).alias("corpus"), F.lit(commit).alias("corpus_commit"), "*")).alias("json"))


def rendered(threads: DataFrame) -> DataFrame:
    """``number, raw``: a thread as a page whose lines can be cited."""
    head = F.format_string("# %s", F.coalesce("title", F.lit("")))
    parts = F.array(head, F.lit(""), F.concat(F.lit("Source: "), F.coalesce("url", F.lit(""))), F.lit(""), F.lit("## Question"), F.lit(""), F.coalesce("body", F.lit("")), F.lit(""))
    answer = F.array(F.concat(F.lit("## Accepted answer by "), F.coalesce("answer.author", F.lit("unknown"))), F.lit(""), F.coalesce("answer.body", F.lit("")), F.lit(""))
    whole = F.when(F.col("answer").isNotNull(), F.concat(parts, answer)).otherwise(parts)
    return threads.select("number", F.regexp_replace(F.array_join(whole, "\n"), r"\r\n?", "\n").alias("raw"))


def read_replies(spark: SparkSession, pattern: str) -> DataFrame:
    """``batch_id, reply`` of the files of a pattern; fenced or wrapped JSON is taken out of its wrapping, files without any are left out."""
    raw = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("batch_id"), F.col("value").alias("reply"))
    return raw.withColumn("reply", repaired_json(F.col("reply"))).where(F.try_parse_json("reply").isNotNull())


def last_wins(rows: DataFrame, key: str, order: str = "batch_id") -> DataFrame:
    """One row a key, that of the last file."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_prompts(prompts: DataFrame, path: str, key: str = "batch_id") -> None:
    prompts.select(key, F.col("prompt").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def payload(findings: DataFrame, keep: list[str], links: int = 12) -> DataFrame:
    """One JSON text a finding with the columns readers need; lists of questions are cut to ``links``."""
    shown = [F.slice(c, 1, links).alias(c) if c == "questions" else F.col(c) for c in keep]
    return findings.select("id", F.to_json(F.struct(*shown)).alias("json"))


def document(rows: DataFrame, version: int = 1) -> DataFrame:
    """A report of few rows as one JSON text."""
    return rows.agg(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.collect_list(F.struct("*")).alias("rows"))).alias("json"))


def stale_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts ``(id, text)`` without a vector for just that text, by ``(id, digest)``: what must be embedded again."""
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    return keyed.join(vectors.select("id", "digest"), ["id", "digest"], "left_anti")
