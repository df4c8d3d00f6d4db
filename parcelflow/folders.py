"""Folders that driver and executors share, and tables in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a temporary one for a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='shared-')}/{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """df, computed once: written to a folder of its own and read again."""
    path = f"{work_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
