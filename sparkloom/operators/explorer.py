"""What a reader of findings asks: filter, search, sort, page, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import haystack, parsed_hash

PAGE = 25


def shown_id(concept: Column) -> Column:
    """A concept's id as readers see it."""
    return F.regexp_replace(concept, "^concept:", "")


def status(findings: DataFrame) -> DataFrame:
    return findings.withColumn("status", F.when(F.col("validated"), "held").when(~F.col("validated"), "failed").otherwise("unchecked"))


def searchable(findings: DataFrame, *fields: str) -> DataFrame:
    return findings.withColumn("hay", haystack(*[F.col(f) for f in fields]))


ORDERS = {
    "demand": (F.desc, "demand"),
    "demand-asc": (F.asc, "demand"),
    "concept": (F.asc, "concept"),
    "id": (F.asc, "id"),
}


def selected(findings: DataFrame, kind: str = "all", state: str = "all", text: str = "", order: str = "demand", page: int = 0, size: int = PAGE) -> DataFrame:
    """One page; ids decide ties. Names sort as people read them."""
    rows = findings
    if kind != "all":
        rows = rows.where(F.col("type") == kind)
    if state != "all":
        rows = rows.where(F.col("status") == state)
    if text.strip():
        rows = rows.where(F.col("hay").contains(text.strip().lower()))
    way, field = ORDERS[order]
    key = F.collate(field, "UNICODE") if field == "concept" else F.col(field)
    sort = key.desc() if way is F.desc else key.asc()
    return rows.orderBy(sort, "id").offset(page * size).limit(size)


def facets(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type", "status").agg(F.count("*").alias("n"))


def lookup(findings: DataFrame, address: DataFrame) -> DataFrame:
    """Findings named by fragments ``address(hash)`` of the form ``F1-0001``."""
    named = address.select(F.regexp_extract("hash", r"^#?(F[123]-\d+)$", 1).alias("id")).where("id <> ''")
    return findings.join(named, "id", "left_semi")


def hash_fields(address: DataFrame) -> DataFrame:
    return address.withColumn("fields", parsed_hash(F.col("hash")))
