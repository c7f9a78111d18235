"""Packing: order-preserving dynamic programming over cut points, with a monotone queue.

The token stream of a partition is cut into windows of at most ``window`` tokens. A cut
may fall at a document's end, at a sentence's end or, inside of sentences longer than
that, at every ``HARD_GRID``-th token; the optimum is that over these cut points. Let S(j) be the stream position of cut j and p(j) its truncation penalty.

    f(j) = min over i with S(j) - window <= S(i) < S(j) of  f(i) + window - (S(j) - S(i)) + p(j)

``f(i) + S(i)`` decides the choice of i alone, so a monotone queue over the window of
admissible i gives each transition in amortised constant time. Nothing is dropped and
documents keep their order. Input partitions are packed on their own, in one pass and
without a shuffle; what is held at a time is bounded by ``block`` tokens plus the longest
text. The rest of a partition that fills no window is split into powers of two, which
need no padding.

Null texts count as empty: such a document is its end token alone. Repeated rows are
packed once for each row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, map_batches, text_of

WINDOW = 2048
END_ID = 1
#: Penalty, in tokens of padding, of a cut at a document's end, at a sentence's end and elsewhere.
PENALTIES = (0, 2, 8)
#: Distance of hard cut points, taken only inside sentences longer than this.
HARD_GRID = 32
BLOCK_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts. at: ascending stream positions from 0, gaps at most window; the last one is always cut."""
    pos, pen = at.tolist(), penalty.tolist()
    n = len(pos)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])
    for j in range(1, n):
        s = pos[j]
        low = s - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        cost[j] = c = key + window - s + pen[j]
        back[j] = i
        key = c + s
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int) -> list[int]:
    """Lengths of the sequences for the last n tokens of a partition: powers of two, which need no padding."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Packer:
    """Packs a stream of (doc_id, ids); emits rows of SCHEMA."""

    def __init__(self, first_sequence: int, sentence_ends: np.ndarray, window: int = WINDOW, block: int = BLOCK_TOKENS):
        self.sequence, self.ends, self.window, self.block = first_sequence, sentence_ends, window, block
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, ids not yet placed, how many are placed
        self.held = 0
        self.is_end = np.zeros(1 << 17, dtype=bool)
        self.is_end[sentence_ends] = True

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool):
        if not self.held:
            return
        stream = np.concatenate([d[1][d[2] :] for d in self.docs])
        n = len(stream)
        doc_ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        kind = np.full(n + 1, 3, dtype=np.int8)
        kind[1:][self.is_end[stream]] = 1
        kind[doc_ends] = 0
        kind[0] = 0
        soft = np.flatnonzero(kind < 3)
        gaps = np.flatnonzero(np.diff(soft) > HARD_GRID)
        if len(gaps):
            hard = np.concatenate([np.arange(soft[g] + HARD_GRID, soft[g + 1], HARD_GRID) for g in gaps])
            kind[hard] = 2
        at = np.flatnonzero(kind < 3)
        penalty = np.asarray(PENALTIES)[kind[at]]
        cuts = self.windows(at, penalty, n)
        if last:
            used = cuts[-1] if cuts else 0
            for length in tail_lengths(n - used):
                used += length
                cuts.append(used)
        yield from self.place(stream, cuts)

    def windows(self, at: np.ndarray, penalty: np.ndarray, n: int) -> list[int]:
        """Positions of the cuts of all windows but the last one, which the stream may go on to fill."""
        if n < self.window:
            return []
        chosen = best_cuts(at, penalty, self.window)
        return [int(at[i]) for i in chosen[:-1]]

    def place(self, stream: np.ndarray, cuts: list[int]):
        raw, at, k = stream.tobytes(), 0, 0
        out: list[tuple] = []
        for end in cuts:
            offset = 0
            while at < end:
                doc_id, ids, placed = self.docs[k]
                take = min(len(ids) - placed, end - at)
                out.append((doc_id, placed, take, zlib.crc32(raw[4 * at : 4 * (at + take)]), len(ids), self.sequence, offset))
                at, offset, placed = at + take, offset + take, placed + take
                if placed == len(ids):
                    self.docs[k] = None
                    k += 1
                else:
                    self.docs[k] = (doc_id, ids, placed)
            self.sequence += 1
        self.docs = self.docs[k:]
        self.held -= at
        if out:
            yield tuple(zip(*out, strict=True))


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of a word-split BPE file for the tokenizers library, through a table of known words.

    Texts of plain Latin letters, digits and marks are cut at white space and then by the
    file's own pattern; a new word goes through the library's merges. All other texts (and
    those with strings of special tokens) go to the library whole. Tests compare both
    ways. The table has a bounded number of keys of a bounded length.
    """

    KNOWN = 400_000

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # all code points below U+0250 but controls that count as white space in one library only, and numerals that are no digits
        self.odd = re.compile("[^\\t\\n\\r\\x20-\\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ſ–—‘-„…€]|<\\|")
        split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+").findall
        merge, letters = self.library.model.tokenize, byte_letters()

        def of_chunk(chunk: str) -> bytes:
            if not chunk.isalpha() and len(parts := split(chunk)) > 1:
                return b"".join([known[w] for w in parts])
            ids = [t.id for t in merge(chunk.encode().decode("latin-1").translate(letters))]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.known = known = Known(of_chunk, self.KNOWN)

    def ids(self, text: str) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.odd.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.lower().split())), dtype="<u4")

    def sentence_ends(self) -> np.ndarray:
        """Ids of the marks that end a sentence."""
        marks = [".", "!", "?", "...", "!!", "??", '."', '!"', '?"', ".)", "…"]
        found = [self.library.encode(m, add_special_tokens=False).ids for m in marks]
        return np.asarray(sorted({x[0] for x in found if len(x) == 1}), dtype=np.int64)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents packed into sequences: see SCHEMA.

    sequence_id is unique: the partition's number in the high bits, a count below.
    A sequence that is shorter than ``window`` is padded to it, but for powers of two.
    """

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = tokenizer(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4")

        def stream(batches):
            packer = Packer(part << 40, words.sentence_ends(), window, block)
            for doc_ids, texts in batches:
                for doc_id, text in zip(doc_ids, texts, strict=True):
                    yield from packer.add(doc_id, np.concatenate([words.ids(text), end]))
            yield from packer.flush(last=True)

        stream.streaming = True
        return stream

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, SCHEMA)
