"""Shared plumbing: Arrow row mapping with bounded batches, and the shared work folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.shared import shared_dir, stored

#: Rows and bytes of one Arrow batch that goes to a Python worker, at most (a single row may be longer).
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_LIMITS, as one row can hold a very long text.

    Plans are lazy and read these settings when they run, so they stay set. A session's
    own smaller limits are kept.
    """
    for key, most in BATCH_LIMITS.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """One pass over df without a shuffle.

    ``make()`` runs once for each task and returns ``f(*columns) -> columns``: lists of
    the values of one batch in, lists of output values (any number of rows) out. It may
    also return a generator function that takes an iterator of column lists, if its
    attribute ``streaming`` is true.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def to_batch(cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        read = ([c.to_pylist() for c in b.columns] for b in batches)
        if getattr(f, "streaming", False):
            for cols in f(read):
                yield to_batch(cols)
        else:
            for cols in read:
                yield to_batch(f(*cols))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, out)


class Known(dict):
    """A table of what ``make`` gives for each key, in two generations of at most ``limit`` keys: the older goes when the newer is full."""

    LONGEST = 64

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.LONGEST:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Known", "bounded_batches", "documents", "map_batches", "shared_dir", "stored", "text_of"]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
