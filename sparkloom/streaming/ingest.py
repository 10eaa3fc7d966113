"""Proposals as a stream: each micro-batch is judged like a batch and its edges added once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.proposals import edges_of, judged
from sparkloom.schema import PROPOSALS


def read_proposals(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PROPOSALS).option("maxFilesPerTrigger", most_files).json(folder)


def start(proposals: DataFrame, sections: DataFrame, out: str, checkpoint: str):
    """Writes the new edges of each micro-batch under its number, so a repeated batch overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        new = edges_of(judged(batch, sections))
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(out).where(F.col("batch") < number).select("type", "src", "dst")
            new = new.join(old, ["type", "src", "dst"], "left_anti")
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return proposals.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
