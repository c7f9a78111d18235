"""SentencePiece BPE encoding and decoding by a table of last tokens for each prefix.

For a valid token sequence of a prefix there is exactly one last token. The table holds
it for each prefix end: candidates are the tokens that an automaton finds to end there,
and a candidate t is the one if the last token before it and t are compatible, that is,
if merging the text of the pair gives exactly the pair. Compatibility of neighbours is
enough for a whole sequence to be what merging by rank would give. The ids are then read
off backwards, from the last prefix.

No piece holds a space mark behind another character (checked on loading), so no merge
crosses from a word to the next space. Marks that no piece has behind a letter (found on
loading) part a word in the same way. Each part, with its leading space, is encoded on
its own and kept in a bounded table. Characters without a
piece split a word and become byte pieces. Words with runs of space marks, whose merges
tie in score, are merged directly. Loading also checks that the model doesn't rewrite
texts, by a text of characters that the usual normalisations change.

Null and empty texts give the end id alone, and decode to an empty text. Very long texts
are encoded whole. Rows that repeat get equal results each; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, map_batches, text_of

MARK = "▁"
#: What normalisations would change: ligature, full width, combining mark, runs of spaces, line end, no-break space.
ODD = "ﬁ Ａ e\u0301  x \n\u00a0y "
#: ASCII marks, in order.
MARKS = tuple(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Encoder and decoder for one BPE model file with byte fallback and identity normalisation."""

    KNOWN = 400_000
    PAIRS = 1_000_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        if library.normalize(ODD) != MARK + ODD.replace(" ", MARK):
            raise ValueError("the model rewrites texts; it must take them as they are, with a leading space")
        self.piece = [library.id_to_piece(i) for i in range(n)]
        self.eos = library.eos_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if library.is_byte(i)}
        special = {i for i in range(n) if library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)}
        self.score = {self.piece[i]: library.get_score(i) for i in range(n) if i not in special}
        self.id_of = {self.piece[i]: i for i in range(n) if i not in special}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has a space mark behind another character; words can't be encoded on their own")
        self.surface = [b"" if i in special else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        for value, i in self.byte_id.items():
            self.surface[i] = bytes([value])
        self.is_byte = [False] * n
        for i in self.byte_id.values():
            self.is_byte[i] = True
        self.printed = {str(i): x for i, x in enumerate(self.surface)}
        # tokens that merging their own text gives back; others never come up
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.piece]
        self.pairs: dict[int, bool] = {}
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.words = Known(lambda w: "".join([f"{i} " for i in self.encode_word(w)]), self.KNOWN)
        marks = re.escape("".join(MARKS))
        apart = re.escape(self.apart()) or MARK
        self.split = re.compile(f"{MARK}*[^{MARK}{marks}]++(?=[{apart}])|{MARK}*[^{MARK}]+|{MARK}+")

    def apart(self) -> str:
        """The ASCII marks that stand in no piece right behind a character that is no mark: a word may be cut there."""
        behind = {b for p in self.id_of for a, b in zip(p, p[1:], strict=False) if a != MARK and a not in MARKS}
        return "".join(c for c in MARKS if c not in behind)

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the pair of highest score first, the leftmost of equals."""
        symbols, score = list(text), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def merged_long(self, text: str) -> list[str]:
        """The same by a heap, for long runs."""
        import heapq

        symbols: list[str | None] = list(text)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(pair := symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-s, a, b, pair))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != pair:
                continue
            symbols[a], symbols[b] = pair, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s is not None]

    def edges(self, i: int, right: bool) -> list[tuple[str, float, float]]:
        """The symbols at one edge of token i while it is merged, the last first: text, rank it came at, rank it went at."""
        known = self.right_edges if right else self.left_edges
        if (found := known.get(i)) is None:
            found, text, gone = [], self.piece[i], float("inf")
            while True:
                came = self.rank(text) if len(text) > 1 else float("-inf")
                found.append((text, came, gone))
                if len(text) == 1:
                    break
                text, gone = self.halves(text)[right], came
            known[i] = found
        return found

    def rank(self, text: str) -> float:
        return -self.score[text]

    def halves(self, text: str) -> tuple[str, str]:
        """The two symbols whose merge makes this token: what merging gives if that last step is not allowed."""
        score = self.score.pop(text)
        try:
            left, right = self.merged(text)
        finally:
            self.score[text] = score
        return left, right

    def compatible(self, a: int, b: int) -> bool:
        """Whether no symbol at a's right edge would ever merge with one at b's left edge.

        Two edge symbols that exist at the same time merge if their union ranks before the
        merges that end them; of equal ranks the left one goes first.
        """
        key = a << 32 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > self.PAIRS:
                self.pairs.clear()
            xs, ys, score = self.edges(a, True), self.edges(b, False), self.score
            i = j = 0
            while True:
                x, x_came, x_gone = xs[i]
                y, y_came, y_gone = ys[j]
                s = score.get(x + y)
                if s is not None and -s < x_gone and -s <= y_gone:
                    found = False
                    break
                if x_came > y_came:
                    i += 1
                elif j + 1 < len(ys):
                    j += 1
                else:
                    found = True
                    break
            self.pairs[key] = found
        return found

    def encode_run(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces, by the prefix table."""
        last = [-1] * (len(text) + 1)
        pairs = self.pairs
        for end, (i, length) in self.automaton.iter(text):
            if last[end + 1] < 0:  # there is only one
                before = end + 1 - length
                if before:
                    prev = last[before]
                    if prev < 0:
                        continue
                    if (ok := pairs.get(prev << 32 | i)) is None:
                        ok = self.compatible(prev, i)
                    if not ok:
                        continue
                last[end + 1] = i
        out, end = [], len(text)
        while end:
            if last[end] < 0:
                raise ValueError(f"no token ends at {end} of {text!r}")
            out.append(last[end])
            end -= self.length[last[end]]
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        run: list[str] = []

        def close() -> None:
            if run:
                text = "".join(run)
                run.clear()
                if MARK * 2 in text:
                    ids.extend(self.id_of[s] for s in self.merged_long(text))
                else:
                    ids.extend(self.encode_run(text))

        if MARK * 2 not in word and all(c in self.id_of for c in word):
            return self.encode_run(word)
        for c in word:
            if c in self.id_of:
                run.append(c)
            else:
                close()
                ids.extend(self.byte_id[b] for b in c.encode())
        close()
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids, without the end id."""
        return [int(x) for x in self.encode_joined(text).split()]

    def encode_joined(self, text: str) -> str:
        """The same as decimal ids with a space behind each."""
        if not text:
            return ""
        return "".join(map(self.words.__getitem__, self.split.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids: list[int]) -> str:
        return self.decode_printed([str(i) for i in ids])

    def decode_printed(self, ids: list[str]) -> str:
        """As the library does: pieces joined, the space of the first piece dropped, bytes as UTF-8."""
        raw = b"".join(map(self.printed.__getitem__, ids))
        first = next((i for i in ids if self.printed[i]), None)
        if first is not None and not self.is_byte[int(first)] and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", errors="replace")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One for each worker process, kept between tasks."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded text) of each row, with the end id."""

    def make():
        m = model(model_path)

        def f(doc_ids, texts):
            ids = [[*m.encode(t), m.eos] for t in texts]
            return doc_ids, ids, [m.decode(x) for x in ids]

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as digests: see SCHEMA. Ids don't leave the worker."""

    def make():
        m = model(model_path)
        end = str(m.eos)

        def f(doc_ids, texts):
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                joined = m.encode_joined(t) + end
                ids = joined.split(" ")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(m.decode_printed(ids).encode()).hexdigest())
            return doc_ids, n, ids_sha, text_sha

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, SCHEMA)
