"""Debounced change windows over recorded events: the batch form of the change stream.

A window opens at the first event that no window covers, lasts a fixed time from it, and
later events neither extend nor align it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(events: DataFrame, key: str, secs: str, length: int) -> DataFrame:
    """(key, opened): opening time of each window of each key."""
    times = events.groupBy(key).agg(F.array_sort(F.collect_set(secs)).alias("times"))
    none = F.array().cast("array<bigint>")
    opened = F.aggregate("times", none, lambda a, t: F.when((F.size(a) == 0) | (t >= F.try_element_at(a, F.lit(-1)) + length), F.concat(a, F.array(t))).otherwise(a))
    return times.select(key, F.explode(opened).alias("opened"))
