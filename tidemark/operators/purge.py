"""Tombstones and certified erasure.

tombstones: path, content; an entry is purged if its path or its content is tombstoned.
Two equi joins stand for the OR, which would be a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surviving(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries that no tombstone names, by path or by content."""
    by_path = tombstones.select("path").distinct()
    by_content = tombstones.select("content").distinct()
    return entries.join(by_path, "path", "left_anti").join(by_content, "content", "left_anti").select(entries.columns)


def purged(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries that a tombstone names; materialising a manifest with any is refused."""
    by_path = entries.join(tombstones.select("path").distinct(), "path", "left_semi").select(entries.columns)
    by_content = entries.join(tombstones.select("content").distinct(), "content", "left_semi").select(entries.columns)
    return by_path.union(by_content).distinct()


def first_refused(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: the path that a refusal names, the first by pos, and how many entries are purged."""
    return purged(entries, tombstones).agg(F.min_by("path", "pos").alias("path"), F.count("*").alias("n"))


def sweep(occurrences: DataFrame, path: str) -> DataFrame:
    """(hash, action) of the chunks that any version of path uses: delete, or keep where another path shares them."""
    uses = occurrences.groupBy("hash").agg(F.bool_or(F.col("path") == path).alias("here"), F.bool_or(F.col("path") != path).alias("elsewhere")).where("here")
    return uses.select("hash", F.when(F.col("elsewhere"), "retained_shared").otherwise("delete").alias("action"))


def purge_counts(occurrences: DataFrame, existing: DataFrame, path: str) -> DataFrame:
    """One row: chunks_removed (of those that exist), chunks_retained_shared, manifests_touched."""
    swept = sweep(occurrences, path).join(existing.select("hash").distinct().withColumn("exists", F.lit(True)), "hash", "left")
    chunks = swept.agg(F.count_if((F.col("action") == "delete") & F.col("exists")).alias("chunks_removed"), F.count_if(F.col("action") == "retained_shared").alias("chunks_retained_shared"))
    touched = occurrences.where(F.col("path") == path).agg(F.count_distinct("snapshot_id").alias("manifests_touched"))
    return chunks.withColumn("one", F.lit(1)).join(touched.withColumn("one", F.lit(1)), "one").drop("one")


def certified(certificates: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Certificates whose path and content a tombstone has, both."""
    return certificates.join(tombstones.select("path", "content").distinct(), ["path", "content"], "left_semi")
