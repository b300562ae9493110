"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="tidymesh-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there as Parquet and read back.

    It cuts the lineage, so a lost executor costs no more than its running tasks, and a frame that is used twice is
    computed once. The folder's owner clears it (the results are lazy, so this module can't).
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
