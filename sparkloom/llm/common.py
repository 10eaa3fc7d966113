"""Small helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.shared import materialize, shared_folder

__all__ = ["bounded_sample", "materialize", "read_table", "shared_folder", "splitmix", "unit"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows, chosen by the hash of the whole row: all of them where they are that few.

    Rows are thinned where they are read, by a share of the distinct ones, so what is sorted,
    and what any task sends, is at most about twice ``most`` rows in all, and rows that are
    often repeated leave the sample as large as it is.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*rows.columns))
    share = max(1, int(hashed.agg(F.approx_count_distinct("_h", 0.02)).first()[0] / (1.1 * most)))
    return hashed.where(F.pmod("_h", F.lit(share)) == 0).distinct().orderBy("_h", *rows.columns).limit(most).drop("_h")


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
