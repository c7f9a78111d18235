import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
WORDS = packing.tokenizer(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab tE's.,!?_-\n'éß²½ſİ<|endoftext|>09")), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_ids_as_the_library(text):
    assert WORDS.ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def brute_cost(at, penalty, window):
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min((best[i] + window - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= window), default=float("inf"))
    return best[-1]


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.randint(5, 40)
        at = np.cumsum([0] + [rng.randint(1, window) for _ in range(rng.randint(1, 30))])
        penalty = np.array([rng.choice((0, 2, 8)) for _ in at])
        cuts = [0, *packing.best_cuts(at, penalty, window)]
        cost = sum(window - (at[b] - at[a]) + penalty[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert all(at[b] - at[a] <= window for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[-1] == len(at) - 1 and cost == brute_cost(at, penalty, window)


def test_tail():
    for n in (0, 1, 5, 2047, 1500):
        lengths = packing.tail_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths)


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["alpha", "Beta.", "gamma,", "delta!", "x" * 30]) for _ in range(rng.choice((0, 3, 200, 9000)))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (packing.BLOCK_TOKENS, 5000):
        rows = packing.pack(docs, PATH, block=block).collect()
        seen = {}
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
            ids = [*LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids, packing.END_ID]
            assert r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
            piece = np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
            seen[r["doc_id"]] = r["start"] + r["length"]
        total = sum(seen.values())
        assert all(seen[i] == len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items())
        ends, padding = {}, 0
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        for n in ends.values():
            assert n <= 2048
            padding += 0 if n & (n - 1) == 0 else 2048 - n
        assert padding < 0.03 * total
        # order is kept
        by_sequence = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
        assert by_sequence == sorted(by_sequence)
