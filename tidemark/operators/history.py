"""History: parent chains, orphans, listings and reference resolution over snapshots.

snapshots: snapshot_id, parent_id (null for a root), timestamp_secs, message, actor, ...
Each snapshot has at most one parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Links of a history that the driver walks by itself, at most.
WALKED = 100_000


def chain(snapshots: DataFrame, head: str | DataFrame) -> DataFrame:
    """(snapshot_id, depth) from head to the root, depth 0 at the head.

    Of at most ``WALKED`` snapshots the links are walked in one go. Beyond, by pointer
    doubling: a step table maps each snapshot to its ancestor 2**k steps up, and the
    reached set joins it once for each k until nothing is added, so a chain of n snapshots
    takes log2(n) joins of written tables. In a cycle each snapshot keeps its least depth.
    """
    spark = snapshots.sparkSession
    start = spark.createDataFrame([(head,)], "snapshot_id string") if isinstance(head, str) else head.select("snapshot_id")
    links = snapshots.select("snapshot_id", "parent_id").limit(WALKED + 1).collect()
    if len(links) <= WALKED:
        return spark.createDataFrame(walked(dict(links), [head] if isinstance(head, str) else [r[0] for r in start.distinct().collect()]), "snapshot_id string, depth long")
    return doubled(snapshots, start)


def walked(parents: dict, heads: list) -> list[tuple[str, int]]:
    """(id, least depth) of what is reached from the heads."""
    found, at, depth = {}, set(heads) & parents.keys(), 0
    while at:
        found |= dict.fromkeys(at, depth)
        at = {parents[x] for x in at} & parents.keys() - found.keys()
        depth += 1
    return list(found.items())


def doubled(snapshots: DataFrame, start: DataFrame) -> DataFrame:
    """The chain by pointer doubling over written tables."""
    known = stored(snapshots.select("snapshot_id", "parent_id"), "chain-known")
    reached = start.join(known.select("snapshot_id"), "snapshot_id", "left_semi").withColumn("depth", F.lit(0).cast("long"))
    steps = known.where(F.col("parent_id").isNotNull()).select(F.col("snapshot_id").alias("at"), F.col("parent_id").alias("up"))
    steps = steps.join(known.select(F.col("snapshot_id").alias("up")), "up", "left_semi")
    count = reached.count()
    for k in range(64):
        above = reached.join(steps, F.col("snapshot_id") == F.col("at")).select(F.col("up").alias("snapshot_id"), (F.col("depth") + 2**k).alias("depth"))
        reached = stored(reached.union(above).groupBy("snapshot_id").agg(F.min("depth").alias("depth")), "chain-reached")
        before, count = count, reached.count()
        if count == before:
            break
        steps = stored(steps.alias("a").join(steps.alias("b"), F.col("a.up") == F.col("b.at")).select(F.col("a.at").alias("at"), F.col("b.up").alias("up")), "chain-steps")
    return reached


def orphans(snapshots: DataFrame, in_chain: DataFrame) -> DataFrame:
    return snapshots.join(in_chain, "snapshot_id", "left_anti")


def missing_parents(snapshots: DataFrame, in_chain: DataFrame) -> DataFrame:
    """Parents named in the chain that don't exist: the chain is strict, so any row is an error."""
    named = snapshots.join(in_chain, "snapshot_id", "left_semi").where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("snapshot_id"))
    return named.join(snapshots, "snapshot_id", "left_anti")


def listing(snapshots: DataFrame, in_chain: DataFrame) -> DataFrame:
    """Chain and orphans with depth and in_chain; order them with ``newest_first``."""
    here = snapshots.join(in_chain, "snapshot_id").withColumn("in_chain", F.lit(True))
    return here.unionByName(orphans(snapshots, in_chain).withColumns({"depth": F.lit(None).cast("long"), "in_chain": F.lit(False)}))


def newest_first() -> list:
    """Sort keys of a listing: seconds descending; ties in chain order, then orphans by id."""
    return [F.col("timestamp_secs").desc(), F.col("in_chain").desc(), F.col("depth").asc_nulls_last(), F.col("snapshot_id").asc()]


def log(listed: DataFrame, limit: int = 20) -> DataFrame:
    return listed.orderBy(*newest_first()).limit(limit)


class AmbiguousReference(ValueError):
    """No snapshot, or more than one, begins with a reference."""


def matching(snapshots: DataFrame, prefix: str) -> DataFrame:
    """Snapshots whose id begins with a prefix of at least 4 digits, in any case."""
    if len(prefix) < 4:
        raise AmbiguousReference(f"a reference needs 4 digits: {prefix!r}")
    return snapshots.where(F.col("snapshot_id").startswith(prefix.lower()))


def resolve(snapshots: DataFrame, reference: str, head: str | None) -> str:
    """head or HEAD, a full id (whose existence isn't checked), or a unique prefix."""
    if reference in ("head", "HEAD"):
        if head is None:
            raise AmbiguousReference("no snapshot yet")
        return head
    if len(reference) == 64:
        return reference.lower()
    found = [r[0] for r in matching(snapshots, reference).select("snapshot_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise AmbiguousReference(f"{len(found)} snapshots begin with {reference!r}")
    return found[0]
