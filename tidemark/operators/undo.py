"""Per-actor undo: the manifest that history would have without one actor's changes.

entries: seq, path, content, actor (and other columns of the entry); snapshots: seq,
actor. The sequential fold over history becomes joins and aggregates:

    touched    paths the actor's snapshots changed or deleted, with the entry before the first
    effective  the newest entry by anyone else whose bytes the actor hadn't brought in before
    result     touched ? coalesce(effective, before) : head's entry; null means no file
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NoChanges(ValueError):
    """The actor has changed nothing."""


def is_actor(name: str) -> Column:
    """Exactly that name; entries without an actor are someone else's."""
    return F.coalesce(F.col("actor") == name, F.lit(False))


def touched(entries: DataFrame, snapshots: DataFrame, name: str) -> DataFrame:
    """(path, before): before is the content ahead of the actor's first change, null if there was none."""
    prev = entries.select((F.col("seq") + 1).alias("seq"), "path", F.col("content").alias("before"))
    mine = entries.where(is_actor(name))
    changed = mine.join(prev, ["path", "seq"], "left").where(~F.col("content").eqNullSafe(F.col("before"))).select("path", "seq", "before")
    actor_seqs = snapshots.where(is_actor(name)).select("seq")
    deleted = prev.join(actor_seqs, "seq", "left_semi").join(entries.select("path", "seq"), ["path", "seq"], "left_anti").select("path", "seq", "before")
    return changed.unionByName(deleted).groupBy("path").agg(F.min_by("before", "seq").alias("before"))


def effective(entries: DataFrame, name: str) -> DataFrame:
    """(path, content, seq) of the newest entry by others that doesn't repeat bytes the actor had brought in earlier."""
    first = entries.where(is_actor(name)).groupBy("path", "content").agg(F.min("seq").alias("since"))
    others = entries.where(~is_actor(name)).join(first, ["path", "content"], "left")
    kept = others.where(F.col("since").isNull() | (F.col("since") > F.col("seq")))
    return kept.groupBy("path").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def manifest(entries: DataFrame, snapshots: DataFrame, name: str, head_seq: Column | int) -> DataFrame:
    """(path, content, source) of the undone manifest."""
    head = entries.where(F.col("seq") == head_seq).select("path", F.col("content").alias("head"))
    t = touched(entries, snapshots, name).withColumn("is_touched", F.lit(True))
    e = effective(entries, name).select("path", F.col("content").alias("kept"))
    x = head.join(t, "path", "full_outer").join(e, "path", "left")
    content = F.when(F.col("is_touched"), F.coalesce("kept", "before")).otherwise(F.col("head"))
    source = F.when(F.col("is_touched").isNull(), "head").when(F.col("kept").isNotNull(), "effective").otherwise("before")
    return x.select("path", content.alias("content"), source.alias("source")).where(F.col("content").isNotNull())


def removed(entries: DataFrame, snapshots: DataFrame, name: str, head_seq: Column | int) -> DataFrame:
    """(path): touched paths that the undone manifest lacks; reverting unlinks them."""
    return touched(entries, snapshots, name).select("path").join(manifest(entries, snapshots, name, head_seq), "path", "left_anti")
