"""Ballots over findings: samples, majorities, rates."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import rate, wilson
from sparkloom.operators.graph import in_order

CENSUS, SEED, FLOOR = 50, 20260906, 0.70


def sample(findings: DataFrame, key: str = "id", most: int = CENSUS, seed: int = SEED) -> DataFrame:
    """All findings up to ``most``, beyond that a seeded draw by position in the order of ids."""
    total = findings.count()
    if total <= most:
        return findings
    chosen = sorted(random.Random(seed).sample(range(1, total + 1), most))
    placed = in_order(findings.select(key), key).where(F.col("ordinal").isin(chosen))
    return findings.join(F.broadcast(placed.select(key)), key, "left_semi")


def majorities(ballots: DataFrame) -> DataFrame:
    """``finding_id, readers, votes_valid, verdict, unanimous, reason``: valid needs more than half; without votes unchecked.

    ``reason`` is that of the first reader who agrees with the verdict.
    """
    legal = F.col("verdict").isin("valid", "invalid")
    per = ballots.groupBy("finding_id").agg(F.count_if(legal).alias("readers"), F.count_if(F.col("verdict") == "valid").alias("votes_valid"), F.min_by("reason", F.when(F.col("verdict") == "valid", F.col("reader"))).alias("yes"), F.min_by("reason", F.when(F.col("verdict") == "invalid", F.col("reader"))).alias("no"))
    verdict = F.when(F.col("readers") == 0, "unchecked").when(F.col("votes_valid") * 2 > F.col("readers"), "valid").otherwise("invalid")
    per = per.withColumn("verdict", verdict)
    return per.select("finding_id", "readers", "votes_valid", "verdict", ((F.col("readers") > 0) & F.col("votes_valid").isin(F.lit(0), F.col("readers"))).alias("unanimous"), F.when(F.col("verdict") == "valid", F.col("yes")).when(F.col("verdict") == "invalid", F.col("no")).alias("reason"))


def summary(verdicts: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row: findings checked, valid, rate with its interval, and whether the rate is under the floor."""
    n = verdicts.agg(F.count_if(F.col("verdict") != "unchecked").alias("n"), F.count_if(F.col("verdict") == "valid").alias("valid"), F.coalesce(F.max("readers"), F.lit(0)).alias("max_readers"))
    made = n.withColumns({"invalid": F.col("n") - F.col("valid"), "rate": rate(F.col("valid"), F.col("n")), "interval": wilson(F.col("valid"), F.col("n"))})
    return made.select("n", "valid", "invalid", "rate", F.col("interval.low").alias("low"), F.col("interval.high").alias("high"), "max_readers", (F.col("rate") < floor).alias("stop"))


def merged(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with ``validated`` (null while unchecked) and the note."""
    v = verdicts.where("verdict <> 'unchecked'").select(F.col("finding_id").alias("id"), (F.col("verdict") == "valid").alias("validated"), F.col("reason").alias("validation_note"))
    return findings.join(v, "id", "left")


def described(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings with what is missing; ``confirming_answer`` only where an excerpt and a lead question exist."""
    n = notes.select(F.col("finding_id").alias("id"), "missing", "gap_note", "excerpt")
    rows = findings.drop("missing", "gap_note").join(n, "id", "left")
    lead = F.try_element_at("questions", F.lit(1))
    answer = F.when((F.length("excerpt") > 0) & lead.isNotNull(), F.struct(lead.alias("question"), F.col("excerpt").alias("excerpt")))
    return rows.withColumn("confirming_answer", answer).drop("excerpt").fillna("", ["missing", "gap_note"])


def inconsistent(summary_rows: DataFrame) -> DataFrame:
    """Summaries whose parts do not make the whole, or whose interval does not hold the rate; must be empty."""
    whole = F.col("n") == F.col("valid") + F.col("invalid")
    return summary_rows.where(~(whole & (F.col("low") <= F.col("rate")) & (F.col("rate") <= F.col("high"))))


def too_few_readers(outside: DataFrame, least: int = 3) -> DataFrame:
    """Boundary verdicts ``id, readers, votes_outside, outside`` with too few readers or against their majority; must be empty."""
    return outside.where((F.col("readers") < least) | (F.col("outside") != (F.col("votes_outside") * 2 > F.col("readers")))).select("id")


def boundary(findings: DataFrame, outside: DataFrame) -> DataFrame:
    """Counts of validated against found outside the corpus, by a strict majority of readers."""
    o = outside.select("id", (F.col("votes_outside") * 2 > F.col("readers")).alias("outside"))
    return findings.join(o, "id").groupBy("validated", "outside").agg(F.count("*").alias("n"))
