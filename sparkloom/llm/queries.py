"""The queries of this package for the driver, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, defects, leaks, lookalike, markup, nearcopies, pii, splitting, tokens
from .common import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.kinds_found(read_table(spark, d, "discussions"), "number", "body")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_rows(read_table(spark, d, "discussions"), "number", "body").select("number", "clean").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items_found(read_table(spark, d, "discussions"), "number", "body")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_rows(read_table(spark, d, "discussions"), "number", "body").select("number", "clean").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(read_table(spark, d, "discussions"), "number", read_table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_pairs(read_table(spark, d, "discussions"), "number", "title", "body_text", 0.6)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return nearcopies.near_classes(read_table(spark, d, "discussions"), "number", "title", "body_text", 0.6)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_reading(read_table(spark, d, "discussions"), "number", "body_text")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(read_table(spark, d, "discussions"), "number", "body_text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    made = splitting.split_rows(read_table(spark, d, "discussions"), "number", "body_text")
    return made.where("piece_no = 1").select("number").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_rows(read_table(spark, d, "discussions"), "number", "body_text").select("number", "piece_no", "piece")


def p6_contract(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized text put together again from its pieces, and whether every piece keeps the limit and the overlap."""
    made = p6_pieces(spark, d).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))).alias("p"))
    back, most = splitting.OVERLAP, splitting.LIMIT
    fresh = F.transform("p", lambda x: F.when(x["piece_no"] == 1, x["piece"]).otherwise(F.substring(x["piece"], back + 1, most)))
    follows = F.transform("p", lambda x, i: (i == 0) | F.startswith(x["piece"], F.right(F.get("p", i - 1)["piece"], F.lit(back))))
    return made.select("number", F.md5(F.array_join(fresh, "")).alias("digest"), F.forall("p", lambda x: F.length(x["piece"]) <= most).alias("within"), F.forall(follows, lambda x: x).alias("overlapping"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_rows(read_table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(F.col("run") >= leaks.RUN).select("doc_id", "item_id")


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rate_rows(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "labels"), keep=("source",))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).where("passages > 0").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select("doc_id", "score", "passages")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_rated(spark, d), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
    gram = f"unnest(list_transform(range(1, len(w) - {leaks.RUN} + 2), lambda i: array_to_string(w[i:i + {leaks.RUN - 1}], ' ')))"
    return {
        "p6_found": "SELECT DISTINCT number FROM discussions WHERE length(body_text) > 4000",
        "p6_contract": "SELECT DISTINCT number, md5(body_text) AS digest, true AS within, true AS overlapping FROM discussions WHERE length(body_text) > 4000",
        "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, {gram} AS g FROM (SELECT item_id, {words} AS w FROM benchmark)), d AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, {words} AS w FROM documents))
            SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i ON i.g = d.g""",
    }
