"""Diff, drift and revert plans over manifests.

A manifest is a relation with one row for each path: path, mode, size, mtime_secs,
mtime_nanos, content. Where a path comes more than once, the last position wins
(``last_wins``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metadata that lets drift skip a file without reading it.
STAMP = ("size", "mtime_secs", "mtime_nanos")


def last_wins(entries: DataFrame, *keys: str) -> DataFrame:
    """Of rows that repeat a path, the one of the highest pos; combined before the shuffle."""
    keys = keys or ("path",)
    rest = [c for c in entries.columns if c not in keys]
    kept = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("kept"))
    return kept.select(*keys, "kept.*").select(entries.columns)


def diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, status): added, modified or deleted by content; paths without a change are left out."""
    a = new.select("path", F.col("content").alias("a"), F.lit(True).alias("in_a"))
    b = old.select("path", F.col("content").alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where(F.col("status").isNotNull())


def counts(changes: DataFrame) -> DataFrame:
    """One row: added, modified, deleted."""
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")])


def drift(live: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """(path, status): added, deleted, modified or touched against a manifest.

    Without ``full``, files whose stamp agrees are skipped unread. The stamps are compared
    first; contents are looked at for the rest only.
    """
    m = manifest.select("path", *[F.col(c).alias(f"m_{c}") for c in (*STAMP, "content")], F.lit(True).alias("in_manifest"))
    x = live.withColumn("in_live", F.lit(True)).join(m, "path", "full_outer")
    matched = F.col("in_live") & F.col("in_manifest")
    same_stamp = F.lit(True)
    for c in STAMP:
        same_stamp = same_stamp & (F.col(c) == F.col(f"m_{c}"))
    x = x.where(~F.coalesce(matched & same_stamp, F.lit(False))) if not full else x
    content = F.col("content").eqNullSafe(F.col("m_content"))  # a file that can't be read counts as modified
    status = F.when(F.col("in_manifest").isNull(), "added").when(F.col("in_live").isNull(), "deleted").when(~content, "modified").when(~same_stamp, "touched")
    return x.select("path", status.alias("status")).where(F.col("status").isNotNull())


def is_clean(changes: DataFrame) -> bool:
    """No drift at all; a touched file counts."""
    return changes.isEmpty()


def is_dirty(changes: DataFrame) -> Column:
    """Aggregate of the revert gate: whether anything but touched files differs."""
    return F.coalesce(F.bool_or(F.col("status") != "touched"), F.lit(False))


def write_set(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Manifest entries that have to be written: missing live, not a regular file there, or of another content."""
    x = live.select("path", F.col("content").alias("l_content"), F.col("kind").alias("l_kind"))
    need = F.col("l_content").isNull() | (F.col("l_kind") != "file") | (F.col("l_content") != F.col("content"))
    return manifest.join(x, "path", "left").where(need).drop("l_content", "l_kind")


def extras(live: DataFrame, manifest: DataFrame, keep_extra: bool = False) -> DataFrame:
    """(path, action) for live paths that the manifest lacks."""
    return live.join(manifest, "path", "left_anti").select("path", F.lit("skipped_extra" if keep_extra else "removed").alias("action"))


def revert_plan(manifest: DataFrame, live: DataFrame, keep_extra: bool = False) -> DataFrame:
    """(path, action): restored, removed or skipped_extra."""
    return write_set(manifest, live).select("path", F.lit("restored").alias("action")).unionByName(extras(live, manifest, keep_extra))


def directories(paths: DataFrame) -> DataFrame:
    """(dir, depth) of all ancestors of paths."""
    parts = F.split("path", "/")
    dirs = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, n), "/")))).alias("dir"))
    return dirs.where(F.col("dir").isNotNull()).distinct().withColumn("depth", F.size(F.split("dir", "/")))


def empty_directories(before: DataFrame, after: DataFrame) -> DataFrame:
    """(dir, depth) of the directories that hold nothing any more; order by depth, deepest first, to remove them."""
    return directories(before).join(directories(after), "dir", "left_anti")


def violations(entries: DataFrame, safe: Column, longest_chunks: int = 8_000_000, most_files: int | None = None, key: str | None = None) -> DataFrame:
    """(constraint, path) of manifest entries that break a constraint. Limits hold for each manifest, which key tells apart."""
    checks = {"unsafe_path": ~safe, "no_chunks": (F.col("size") > 0) & (F.size("chunks") == 0), "negative_size": F.col("size") < 0}
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    each = entries.select("path", F.explode(found).alias("constraint")).select("constraint", "path")
    totals = entries.groupBy(*([key] if key else [])).agg(F.sum(F.size("chunks")).alias("n"), F.count("*").alias("files"))
    limits = {"too_many_chunks": F.col("n") > longest_chunks} | ({"too_many_files": F.col("files") > most_files} if most_files else {})
    over = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in limits.items()]))
    return each.unionByName(totals.select(F.explode(over).alias("constraint"), F.lit(None).cast("string").alias("path")))

