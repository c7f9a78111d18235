"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset and the master is local
    does a temporary folder of this machine take its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-work")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
