"""Hash chains: audit logs, checkpoints over them, signed documents in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import audit_body


def checked(log: DataFrame, *keys: str, order: str = "line_no") -> DataFrame:
    """log with ``pos`` and ``ok``: seq counts from 0, prev is the stored hash before, the hash fits the body.

    Before the first bad entry every stored hash is its body's, so comparing with stored
    predecessors finds the same first bad entry as following the chain does.
    """
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    pos = (F.row_number().over(w) - 1).cast("long")
    linked = (F.col("seq") == pos) & (F.col("prev") == F.lag("hash", 1, "").over(w))
    body = audit_body(F.col("seq"), F.col("ts"), F.col("event"), F.col("detail"), F.col("prev"))
    return log.withColumns({"pos": pos, "ok": linked & (F.col("hash") == F.sha2(body, 256))})


def verdicts(log: DataFrame, *keys: str) -> DataFrame:
    """For each chain: entries, valid, first_bad (the seq that the first bad entry claims) and valid_prefix."""
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    out = checked(log, *keys).groupBy(*keys).agg(
        F.count("*").alias("entries"),
        (F.count_if(bad) == 0).alias("valid"),
        F.min_by(F.when(bad, F.col("seq")), F.when(bad, F.col("pos"))).alias("first_bad"),
        F.coalesce(F.min(F.when(bad, F.col("pos"))), F.count("*")).alias("valid_prefix"),
    )
    return out


def tips(log: DataFrame, *keys: str) -> DataFrame:
    """For each log: entries (the last seq and one) and the last hash; the chain isn't verified."""
    last = F.max_by(F.struct("seq", "hash"), "line_no")
    return log.groupBy(*keys).agg(last.alias("t")).select(*keys, (F.col("t.seq") + 1).alias("entries"), F.col("t.hash").alias("tip"))


def anchored(log: DataFrame, anchors: DataFrame, *keys: str) -> DataFrame:
    """anchors (audit_len, audit_tip) with ``ok``: the log's first audit_len entries chain and end in audit_tip. Length 0 always holds."""
    rows = checked(log, *keys).select(*keys, "pos", "ok", "hash")
    ahead = anchors.join(rows, list(keys), "left").where((F.col("audit_len") == 0) | (F.col("pos") < F.col("audit_len")))
    names = [c for c in anchors.columns]
    got = ahead.groupBy(*names).agg(F.count_if("ok").alias("good"), F.max_by("hash", "pos").alias("end"))
    ok = (F.col("audit_len") == 0) | ((F.col("good") == F.col("audit_len")) & (F.col("end") == F.col("audit_tip")))
    marked = got.select(*names, ok.alias("ok"))
    return anchors.join(marked, names, "left").select(*names, F.coalesce("ok", F.lit(False)).alias("ok"))


def links(anchors: DataFrame, *keys: str) -> DataFrame:
    """anchors ordered by (millis, n) with ``linked``: prev_anchor is the hash of the file before; null for the first."""
    w = Window.partitionBy(*keys).orderBy("millis", "n")
    before = F.lag("file_hash").over(w)
    return anchors.withColumn("linked", F.when(before.isNotNull(), F.coalesce(F.col("prev_anchor") == before, F.lit(False))))


def anchor_names(moments: DataFrame, millis: Column, *tie: str) -> DataFrame:
    """moments with the file name each gets: within one millisecond a number is added from the second on."""
    n = F.row_number().over(Window.partitionBy("millis").orderBy(*tie)) - 1
    named = moments.withColumn("millis", millis).withColumn("n", n)
    return named.withColumn("name", F.concat(F.lit("anchor-"), F.col("millis").cast("string"), F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(".json")))


def accepted(orders: DataFrame, *keys: str, ts: str = "ts", arrival: str = "arrival") -> DataFrame:
    """orders with ``accepted``: none older than the newest one accepted before; equal times are accepted again."""
    w = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return orders.withColumn("accepted", F.coalesce(F.col(ts) >= F.max(ts).over(w), F.lit(True)))
