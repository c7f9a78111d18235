"""Numbering rows in a total order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import stored


def numbered(rows: DataFrame, *order: Column | str, name: str, stable: bool = False) -> DataFrame:
    """rows with their number from 0 in this order.

    The rows are sorted by ranges and written; a partition's first number is the count of
    the rows in those before it, of which there is one for each partition. stable: rows
    of equal keys keep the order they came in.
    """
    if stable:
        rows = rows.withColumn("__came", F.monotonically_increasing_id())
        order = (*order, "__came")
    sorted_ = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted(sorted_.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __start long"))  # a row for each partition
    number = F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__start")
    return sorted_.join(starts, part == F.col("__part")).withColumn(name, number.cast("long")).drop("__at", "__part", "__start", "__came")
