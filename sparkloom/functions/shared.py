"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this process has written.
WRITTEN: list[tuple[SparkSession, str]] = []


def forget() -> None:
    """Delete the tables written so far; those of a session that has ended are left to the folder's owner."""
    while WRITTEN:
        spark, path = WRITTEN.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone
            WRITTEN.clear()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a local folder, if all executors are on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'sparkloom-checkpoints')}"
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages neither recompute it nor need the executors that made it.

    ``by``: a column whose values become folders, for readers that want one of them. The
    tables of a session are deleted when its driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/sparkloom-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if not WRITTEN:
        atexit.register(forget)
    WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
