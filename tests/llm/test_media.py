import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media


def filtered(pixels: np.ndarray, kind: int) -> bytes:
    """PNG filters by their definition, byte by byte."""
    h, w = pixels.shape
    p = pixels.astype(int)
    out = bytearray()
    for y in range(h):
        out.append(kind)
        for x in range(w):
            a, b, c = (p[y, x - 1] if x else 0), (p[y - 1, x] if y else 0), (p[y - 1, x - 1] if x and y else 0)
            q = a + b - c
            paeth = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2]
            out.append((p[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_all_filters_are_undone(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (5, 9), dtype=np.uint8)
    header = (9).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    file = media.SIGNATURE + media.chunk(b"IHDR", header) + media.chunk(b"IDAT", zlib.compress(filtered(pixels, kind))) + media.chunk(b"IEND", b"")
    assert (media.read_png(file) == pixels).all()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.pad_payload(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(data)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 576)
    back = media.read_png(media.write_png(pixels))
    assert back.tobytes() == payload
    assert len(media.cosine_hash(back)) == 16


def test_damage_is_found():
    file = media.write_png(np.arange(576, dtype=np.uint8).reshape(1, 576))
    for at in (0, 20, 45, len(file) - 1):
        bad = bytearray(file)
        bad[at] ^= 1
        with pytest.raises(media.DamagedMedia):
            media.read_png(bytes(bad))
    with pytest.raises(media.DamagedMedia):
        media.read_png(file[:-5])
    with pytest.raises(media.DamagedMedia):
        media.read_png(file[:60])


def test_hash_follows_low_frequencies():
    # a coarse random picture: a separable one has most coefficients at 0, whose signs are noise
    smooth = np.kron(np.random.default_rng(1).integers(20, 230, (8, 8)), np.ones((8, 72))).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(0).integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = np.flip(smooth, 1).copy()
    bits = lambda a, b: bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1")
    assert bits(smooth, noisy) < 12 < bits(smooth, other)


def test_small_files_that_inflate_to_much_are_refused():
    """The header says 576 samples, the data hold a hundred million."""
    bomb = zlib.compress(b"\0" * 100_000_000, 9)
    data = media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 576, 1, 8, 0, 0, 0, 0)) + media.chunk(b"IDAT", bomb) + media.chunk(b"IEND", b"")
    with pytest.raises(media.DamagedMedia):
        media.read_png(data)
    cut = zlib.compress(b"\0" * 577, 9)[:-4]
    with pytest.raises(media.DamagedMedia):
        media.read_png(media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 576, 1, 8, 0, 0, 0, 0)) + media.chunk(b"IDAT", cut) + media.chunk(b"IEND", b""))
