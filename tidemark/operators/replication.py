"""Incremental replication: which objects and manifests one warehouse fetches from another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_set(needed: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """Distinct needed hashes that the remote has and the local side lacks."""
    return needed.select("hash").distinct().join(remote, "hash", "left_semi").join(local, "hash", "left_anti")


def pull_counts(needed: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """One row: needed, fetched, skipped (all others) and, of these, remote_missing."""
    there = remote.select("hash").distinct().withColumn("r", F.lit(True))
    here = local.select("hash").distinct().withColumn("l", F.lit(True))
    x = needed.select("hash").distinct().join(there, "hash", "left").join(here, "hash", "left")
    fetched = F.col("r").isNotNull() & F.col("l").isNull()
    return x.agg(F.count("*").alias("needed"), F.count_if(fetched).alias("fetched"), F.count_if(~fetched).alias("skipped"), F.count_if(F.col("r").isNull() & F.col("l").isNull()).alias("remote_missing"))


def peers(beacons: DataFrame) -> DataFrame:
    """One row for each address, the first to arrive."""
    return beacons.groupBy("addr").agg(F.min_by("secured", "arrival").alias("secured"), F.min("arrival").alias("arrival"))
