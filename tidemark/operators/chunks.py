"""Chunk tables: fixed and content-defined cutting, deduplication, reassembly, object checks.

chunks: hash, length, data; occurrences: path, pos, hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of content-defined chunks in bytes, and how far the cut condition is normalised.
LEAST, AVERAGE, MOST, LEVEL = 16 << 10, 64 << 10, 256 << 10, 2


def fixed(files: DataFrame, size: int, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, piece, hash) of pieces of ``size`` characters; empty texts have none."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    pos = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    cut = files.select(key, text_col, pos.alias("pos"))
    piece = F.substring(F.col(text_col), F.col("pos") * size + 1, F.lit(size))
    return cut.select(key, "pos", piece.alias("piece")).withColumn("hash", F.sha2("piece", 256))


def absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of new to insert: one for each hash that isn't there. What exists is not looked at again."""
    return new.dropDuplicates(["hash"]).join(existing, "hash", "left_anti")


def verified(claimed: DataFrame, data: Column, claim: Column) -> DataFrame:
    """claimed with ``ok``: whether the data have the hash that is claimed."""
    return claimed.withColumn("ok", F.sha2(data, 256) == claim)


#: Bytes of an object, at most.
LONGEST = 16 << 20


def point_read(objects: DataFrame, hash_: str, longest: int = LONGEST) -> bytes | None:
    """The data of one object, null if it isn't there; ValueError if it is too long or doesn't have its hash. Its length is known before it is read."""
    row = objects.where(F.col("hash") == hash_.lower()).select(F.when(F.octet_length("data") <= longest, F.col("data")).alias("data"), (F.sha2("data", 256) == F.col("hash")).alias("ok")).first()
    if row is None:
        return None
    if row["data"] is None or not row["ok"]:
        raise ValueError(f"object {hash_[:12]} is too long or damaged")
    return bytes(row["data"])


def object_counts(objects: DataFrame, data: Column) -> DataFrame:
    """One row: objects whose data have their name's hash, and others."""
    ok = F.sha2(data, 256) == F.col("hash")
    return objects.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("corrupt"))


def reassembled(occurrences: DataFrame, chunks: DataFrame, key: str = "path", piece: str = "piece") -> DataFrame:
    """(key, whole, n_chunks): the pieces of each key in order of pos."""
    rows = occurrences.select(key, "pos", "hash").join(chunks.select("hash", piece), "hash")
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", piece))).alias("parts"))
    return parts.select(key, F.array_join(F.transform("parts", lambda p: p[piece]), "").alias("whole"), F.size("parts").cast("long").alias("n_chunks"))


def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(0)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each position over the 64 bytes up to it, by doubling the window six times."""
    h = GEAR[data]
    width = 1
    while width < 64:
        if len(h) > width:
            # the right side is made anew before the addition, so the shift reads old values
            h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    return h


def cut_points(data: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST, level: int = LEVEL) -> list[int]:
    """Ends of content-defined chunks: a stricter mask up to the average size, a laxer one beyond.

    A hash counts only bytes since the chunk's first ``least``, so positions whose window
    would reach before them are judged on the shorter window.
    """
    n = len(data)
    if n == 0:
        return []
    bytes_ = np.frombuffer(data, np.uint8)
    h = rolling(bytes_)
    bits = average.bit_length() - 1
    top = lambda k: np.uint64(((1 << k) - 1) << (64 - k))
    strict, lax = top(bits + level), top(bits - level)
    strict_at, lax_at = np.flatnonzero((h & strict) == 0), np.flatnonzero((h & lax) == 0)
    ends, start = [], 0
    while n - start > least:
        first, middle, last = start + least, min(start + average, n), min(start + most, n)
        end = None
        head = min(first + 63, last)
        if head > first:
            g = rolling(bytes_[first:head].copy())
            masks = np.where(np.arange(first, head) < middle, strict, lax)
            hit = np.flatnonzero((g & masks) == 0)
            end = first + int(hit[0]) + 1 if len(hit) else None
        for at, low, high in ((strict_at, max(head, first), middle), (lax_at, max(head, middle), last)):
            if end is None and low < high:
                k = np.searchsorted(at, low)
                if k < len(at) and at[k] < high:
                    end = int(at[k]) + 1
        end = end if end is not None else last
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def cut_stream(read, block: int = 8 << 20) -> Iterator[bytes]:
    """Content-defined chunks of what ``read(n)`` gives, with a block and a chunk held at a time.

    Where a chunk ends depends on its own bytes only, ``MOST`` of them at most, so all ends
    are as if the whole were cut at once.
    """
    held = b""
    while True:
        new = read(block)
        held, start = held + new, 0
        for end in cut_points(held):
            if new and start + MOST > len(held):
                break
            yield held[start:end]
            start = end
        if not new:
            return
        held = held[start:]


def content_defined(files: DataFrame, key: str = "doc_id", data_col: str = "text", least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> DataFrame:
    """(key, pos, start, length, hash) of content-defined chunks, in Arrow batches of Python workers."""
    kind = files.schema[key].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for frame in batches:
            rows = []
            for k, data in zip(frame["key"], frame["data"], strict=True):
                data, start = data or b"", 0
                for pos, end in enumerate(cut_points(data, least, average, most)):
                    rows.append((k, pos, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            yield pd.DataFrame(rows, columns=[key, "pos", "start", "length", "hash"])

    return files.select(F.col(key).alias("key"), F.col(data_col).cast("binary").alias("data")).mapInPandas(cut, f"{key} {kind}, pos int, start long, length long, hash string")
