"""Manifests kept as JSON documents, in and out of the snapshot tables.

Hashes in these documents are arrays of 32 integers; here they are lower-case hex.
Versions 2 and 3 are read; version 2 lacks ``unstable`` and ``actor``. Unknown fields are
ignored. A document that can't be read is an error, not a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import from_bytes

VERSIONS = (2, 3)
LONGEST = 256 << 20
SCHEMA = (
    "version int, parent array<int>, timestamp_secs decimal(20,0), message string, actor string, unstable array<string>, "
    "files array<struct<path:string,mode:bigint,size:decimal(20,0),mtime_secs:decimal(20,0),mtime_nanos:bigint,content:array<int>,chunks:array<array<int>>>>"
)


class BadManifest(ValueError):
    """A manifest document that can't be read or breaks a constraint."""


def decoded(documents: DataFrame, body: str = "value", key: str = "snapshot_id") -> DataFrame:
    """(key, version, parent_id, timestamp_secs, message, actor, unstable, files) of JSON documents.

    Raises BadManifest for the first document that is too long, no manifest, of another
    version, or has numbers beyond 63 bits, which Spark's integers can't hold.
    """
    rows = documents.select(key, F.octet_length(body).alias("bytes"), F.from_json(body, SCHEMA).alias("m"))
    most = F.lit(2**63 - 1).cast("decimal(20,0)")
    too_large = (F.col("m.timestamp_secs") > most) | F.exists("m.files", lambda f: (f["size"] > most) | (f["mtime_secs"] > most))
    bad = F.when(F.col("bytes") > LONGEST, "too long").when(F.col("m").isNull() | F.col("m.version").isNull() | F.col("m.files").isNull(), "unreadable").when(~F.col("m.version").isin(*VERSIONS), "version").when(too_large, "number out of range")
    first = rows.select(key, bad.alias("bad")).where("bad IS NOT NULL").first()
    if first:
        raise BadManifest(f"{first[key]}: {first['bad']}")

    def entry(f: Column, pos: Column) -> Column:
        chunks = F.transform(f["chunks"], from_bytes)
        return F.struct(pos.cast("long").alias("pos"), f["path"].alias("path"), f["mode"].cast("int").bitwiseAND(511).alias("mode"), f["size"].cast("long").alias("size"), f["mtime_secs"].cast("long").alias("mtime_secs"), f["mtime_nanos"].cast("int").alias("mtime_nanos"), from_bytes(f["content"]).alias("content"), chunks.alias("chunks"))

    m = F.col("m")
    return rows.select(key, m["version"].alias("version"), F.when(m["parent"].isNotNull(), from_bytes(m["parent"])).alias("parent_id"), m["timestamp_secs"].cast("long").alias("timestamp_secs"), m["message"].alias("message"), m["actor"].alias("actor"), F.coalesce(m["unstable"], F.array().cast("array<string>")).alias("unstable"), F.transform(m["files"], entry).alias("files"))


def entries(manifests: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """One row for each file of decoded manifests."""
    return manifests.select(key, F.explode("files").alias("f")).select(key, "f.*")


def encoded(snapshots: DataFrame, files: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """(key, value): snapshots and their entries as such JSON documents, files in order of pos."""
    numbers = lambda h: F.transform(F.filter(F.split(F.regexp_replace(h, "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    one = F.struct("pos", "path", "mode", "size", "mtime_secs", "mtime_nanos", numbers(F.col("content")).alias("content"), F.transform("chunks", numbers).alias("chunks"))
    lists = files.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda f: F.struct(*[f[c].alias(c) for c in ("path", "mode", "size", "mtime_secs", "mtime_nanos", "content", "chunks")])).alias("files"))
    body = F.struct("version", numbers(F.col("parent_id")).alias("parent"), "timestamp_secs", "message", F.coalesce("files", F.array()).alias("files"), "unstable", "actor")
    return snapshots.join(lists, key, "left").select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
