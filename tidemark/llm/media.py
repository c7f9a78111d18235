"""Media columns: PNG files in binary columns, read back through zlib chunks and numpy unfiltering.

``write_png`` and ``read_png`` handle 8-bit greyscale. The writer filters each row by
None, Sub or Up, whichever has the least sum of absolute differences; the reader undoes
all five filter types, tests the checksum of every chunk and the sizes, and raises on
damage; it never inflates more than the header's size asks for. The feature is a
perceptual hash: block means to 32 x 32, a two-dimensional cosine transform, the 8 x 8
low-frequency corner against its median.

Null texts count as empty; an empty text is one row of padding. Very long texts become
tall pictures. Rows that repeat are stored and read each, with equal values. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, CORNER = 32, 8
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_K = np.arange(SIDE)
#: Cosine basis of the lowest frequencies.
COSINE = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(CORNER)[:, None] / (2 * SIDE))


class DamagedMedia(ValueError):
    """A PNG file that can't be read back whole."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """pixels: uint8, rows x columns."""
    h, w = pixels.shape
    sub = pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    options = np.stack([pixels, sub, up])
    weight = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = weight.argmin(axis=0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = options[kind, np.arange(h)]
    header = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise DamagedMedia("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise DamagedMedia("the file ends inside a chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            raise DamagedMedia("the file ends inside a chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise DamagedMedia(f"checksum of chunk {kind!r}")
        yield kind, body
        at += 12 + n


def unfilter(rows: np.ndarray) -> np.ndarray:
    """rows: filter byte and filtered samples of each row; one byte a sample."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if len(out) and kinds.max() > 4:
        raise DamagedMedia("unknown filter type")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint64).astype(np.uint8)
    for y in np.flatnonzero(kinds >= 2):
        row, above = out[y], out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kinds[y] == 2:
            row += above
        else:
            up, line = above.tolist(), row.tolist()
            left = corner = 0
            for x, b in enumerate(up):
                if kinds[y] == 3:
                    guess = (left + b) >> 1
                else:
                    p = left + b - corner
                    pa, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if pa <= pb and pa <= pc else b if pb <= pc else corner
                left = line[x] = (line[x] + guess) & 255
                corner = b
            out[y] = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG; DamagedMedia if anything doesn't fit."""
    header, body, ended = None, [], False
    for kind, part in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended:
        raise DamagedMedia("header or end is missing")
    w, h, *rest = header
    if rest != [8, 0, 0, 0, 0]:
        raise DamagedMedia("only 8-bit greyscale without interlacing is read")
    size, inflate = h * (w + 1), zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise DamagedMedia(str(e)) from e
    if len(raw) != size or not (inflate.eof or inflate.decompress(inflate.unconsumed_tail, 1) == b"" and inflate.eof):
        raise DamagedMedia("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(h, w + 1))


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits of the 64 low-frequency signs."""
    h, w = pixels.shape
    rows = np.add.reduceat(pixels, np.arange(SIDE) * h // SIDE, axis=0, dtype=np.int64) if h >= SIDE else pixels[np.arange(SIDE) * h // SIDE].astype(np.int64)
    small = np.add.reduceat(rows, np.arange(SIDE) * w // SIDE, axis=1).astype(float)
    per_row = np.diff(np.append(np.arange(SIDE) * h // SIDE, h)) if h >= SIDE else np.ones(SIDE)
    small /= per_row[:, None] * np.diff(np.append(np.arange(SIDE) * w // SIDE, w))[None, :]
    low = np.round(COSINE @ small @ COSINE.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def pad_payload(data: bytes, width: int = WIDTH) -> bytes:
    """Bytes 255 up to a positive multiple of the width."""
    return data + b"\xff" * (width - len(data) if not data else -len(data) % width)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, media binary) of each row: the text as pixels of a PNG. Null texts count as empty."""

    def make():
        def f(doc_ids, texts):
            raw = [t.encode() for t in texts]
            return doc_ids, [len(r) for r in raw], [write_png(np.frombuffer(pad_payload(r, width), np.uint8).reshape(-1, width)) for r in raw]

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the stored bytes: see SCHEMA. Takes what store_texts gives."""

    def make():
        def f(doc_ids, sizes, files):
            out = []
            for doc_id, n, data in zip(doc_ids, sizes, files, strict=True):
                pixels = read_png(data)
                payload = pixels.tobytes()
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            return list(zip(*out, strict=True)) if out else [[]] * 8

        return f

    return map_batches(media.select("doc_id", "n_bytes", "media"), make, SCHEMA)
