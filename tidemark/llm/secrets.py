"""Secret scans: pattern spans, and a linear-chain conditional random field over tokens.

The field tags tokens as secret begin (B), inside (I) or outside (O). Features are the
token's shape (kinds of characters, length, entropy), the neighbouring words (keywords,
assignment marks, quotes) and file features (how code-like the text is). It is trained
here: on windows of ``SAMPLE`` texts that hold a base match and as many that hold none,
the first of all distinct texts by a hash, with the base spans as tags, and on the same
windows with the secrets replaced by random ones of other shapes, so that it learns
context and shape rather than the patterns. Hashes choose the texts and executors cut the
windows, so that the driver gets a bounded number of short windows from any corpus.

Decoding is exact Viterbi. A token is calm if it is a plain word or mark away from
keywords and unusual tokens. Training ends with the constraint that a calm token's score
for O beats the others by more than any neighbours could make up for, so calm tokens are
O on every best path, and a text is decoded only around the other tokens. A field without
the constraint decodes whole texts.

Null texts count as empty. Rows that repeat keep their own results, equal ones. An empty
table gives no rows. Long texts are scanned whole. Extra columns are ignored. Of equal
hashes in the sample the smaller text counts.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The same three patterns in one, for finding sample documents in SQL.
ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "api")
#: Documents of each class to learn from.
SAMPLE = 150
BLANKS = " \t\n\r\f\v"
WORD_BEHIND = re.compile(r"\s*\S*", re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[+/_.=-]+[A-Za-z0-9]+)*={0,2}|[^\sA-Za-z0-9]|[A-Za-z0-9]+", re.ASCII)
KEYWORDS = ("passw", "pwd", "secret", "token", "api_?key", "access_?key", "private", "credential", "auth", "bearer", "signature")
KEYWORD = re.compile("|".join(KEYWORDS), re.IGNORECASE | re.ASCII)
#: What each match of a keyword holds, in lower case.
KEY_STEMS = tuple(k.rpartition("?")[2] for k in KEYWORDS)
#: Letters from which on a token counts as long.
LONG = 16
#: Where a token may lie that is not calm: one search each, as each is fast alone.
UNUSUAL_MARK = re.compile(r"[0-9_+/=]", re.ASCII)
UNUSUAL_CASE = re.compile(r"[a-z][A-Z]|[A-Z][A-Z][a-z]", re.ASCII)
UNUSUAL_LENGTH = re.compile(rf"[A-Za-z.-]{{{LONG},}}", re.ASCII)
#: Digits of other scripts, by the definition that shapes use.
OTHER_DIGIT = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isdigit()) + "]")
#: Tokens before and behind such a place that are decoded with it: what sees a keyword lies up to four behind it.
BEFORE, BEHIND = 2, 6
LABELS = ("O", "B", "I")
O, B, I = 0, 1, 2
SHAPES = ("plain", "capital", "upper", "digits", "alnum", "mixed", "hex", "marks", "joined", "long20", "long32", "entropy3", "entropy4", "decimal")
NEAR = ("key-1", "key-2", "key-3", "key-4", "mark-1", "quote-1", "quote+1", "unusual-1", "unusual+1", "start", "self-key", "calm")
FILE = ("file-code", "file-digits")
PLAIN = ("plain", "capital", "marks", "upper")
FEATURES = (*SHAPES, *NEAR, *FILE, "bias")
INDEX = {f: k for k, f in enumerate(FEATURES)}
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then by kind as in KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves inside the base spans, without overlaps: what the field learns to tag."""
    parts = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    parts += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    parts += [m.span() for m in HEX.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(parts):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in set(token)))


_shape_cache: dict[str, tuple[int, ...]] = {}


def shape(token: str) -> tuple[int, ...]:
    """Indices of the shape features of a token."""
    found = _shape_cache.get(token)
    if found is None:
        if len(_shape_cache) > 100_000:
            _shape_cache.clear()
        digit, alpha = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
        upper, lower = any(c.isupper() for c in token), any(c.islower() for c in token)
        names = []
        if alpha and not digit and token.isalpha():
            names.append("plain" if not upper else "capital" if token[1:].islower() or len(token) == 1 else "mixed" if lower else "upper")
        elif digit and not alpha:
            names.append("digits" if token.isdigit() else "decimal")
        elif digit and alpha:
            names.append("alnum")
            if upper and lower:
                names.append("mixed")
            if len(token) >= 8 and all(c in "0123456789abcdefABCDEF" for c in token):
                names.append("hex")
        else:
            names.append("marks")
        if len(token) > 1 and alpha and not token.isalnum():
            names.append("joined")
        if len(token) >= 32:
            names.append("long32")
        elif len(token) >= LONG:
            names.append("long20")
        if digit and alpha and len(token) >= 8:
            h = entropy(token)
            if h >= 4:
                names.append("entropy4")
            elif h >= 3:
                names.append("entropy3")
        found = tuple(INDEX[x] for x in names)
        if len(token) <= 128:
            _shape_cache[token] = found
    return found


def file_features(text: str) -> list[int]:
    out = []
    n = max(1, len(text))
    if sum(text.count(c) for c in "={};<>") * 100 > n:
        out.append(INDEX["file-code"])
    if sum(text.count(c) for c in "0123456789") * 20 > n:
        out.append(INDEX["file-digits"])
    return out


PLAIN_FEATURES = frozenset(INDEX[f] for f in (*PLAIN, "joined"))


def features(tokens: list[str], file: list[int]) -> list[list[int]]:
    """Active features of each token of a run of tokens."""
    shapes = [shape(t) for t in tokens]
    keys = [len(t) > 2 and KEYWORD.search(t) is not None for t in tokens]
    alnum, calm = INDEX["alnum"], INDEX["calm"]
    out = []
    for k, t in enumerate(tokens):
        f = [*shapes[k], *file, INDEX["bias"]]
        near = [back for back in (1, 2, 3, 4) if k >= back and keys[k - back]]
        f += [INDEX[f"key-{back}"] for back in near]
        if keys[k]:
            f.append(INDEX["self-key"])
        if k and tokens[k - 1] in "=:":
            f.append(INDEX["mark-1"])
        if k and tokens[k - 1] in "\"'`":
            f.append(INDEX["quote-1"])
        if k + 1 < len(tokens) and tokens[k + 1] in "\"'`":
            f.append(INDEX["quote+1"])
        before = k > 0 and alnum in shapes[k - 1]
        behind = k + 1 < len(tokens) and alnum in shapes[k + 1]
        if before:
            f.append(INDEX["unusual-1"])
        if behind:
            f.append(INDEX["unusual+1"])
        if not k:
            f.append(INDEX["start"])
        if not (near or keys[k] or before or behind) and PLAIN_FEATURES.issuperset(shapes[k]):
            f.append(calm)
        out.append(f)
    return out


class Field:
    """Weights of the chain: emission (feature x label) and transition (label x label)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition
        self.sparse = self.calm_is_outside()

    def lacking(self) -> float:
        """How much a calm token lacks to be O on every best path, whatever its neighbours; below 0 if it is."""
        t = self.transition
        gain = max(t[a, x] - t[a, O] for a in range(3) for x in (B, I)) + max(t[x, b] - t[O, b] for b in range(3) for x in (B, I))
        optional = [INDEX[f] for f in (*FILE, "start", "quote-1", "quote+1", "mark-1", "joined")]
        e = self.emission
        least = max(e[INDEX[name], x] - e[INDEX[name], O] for name in PLAIN for x in (B, I))
        rest = max(sum(e[f, x] - e[f, O] for f in (INDEX["bias"], INDEX["calm"])) + sum(max(0.0, e[f, x] - e[f, O]) for f in optional) for x in (B, I))
        return least + rest + gain

    def with_calm_outside(self) -> Field:
        """The same field under the constraint that calm tokens are never secrets."""
        emission = self.emission.copy()
        emission[INDEX["calm"], O] += max(0.0, self.lacking() + 1e-3)
        return Field(emission, self.transition)

    def calm_is_outside(self) -> bool:
        return self.lacking() < 0

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.stack([self.emission[r].sum(axis=0) for r in rows])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        best, back = scores[0], []
        for row in scores[1:]:
            options = best[:, None] + self.transition
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of the decoded secrets; a run that begins with I counts too."""
        out = []
        file = None
        for low, high in self.regions(text):
            found = [(m.start() + low, m[0]) for m in TOKEN.finditer(text[low:high])]
            if not found:
                continue
            file = file_features(text) if file is None else file
            tags = self.viterbi(self.scores(features([t for _, t in found], file)))
            for (start, t), tag, before in zip(found, tags, [O, *tags], strict=False):
                if tag == B or tag == I and before == O:
                    out.append([start, start + len(t)])
                elif tag == I:
                    out[-1][1] = start + len(t)
        return [(s, e) for s, e in out]

    def regions(self, text: str) -> list[tuple[int, int]]:
        """Parts of the text to decode, cut where tokens are; between them lie only calm tokens."""
        if not self.sparse:
            return [(0, len(text))] if text else []
        out: list[list[int]] = []
        for start, end in unusual(text):
            if out and end <= out[-1][2]:
                continue
            low = token_before(text, start, BEFORE)
            mid = token_behind(text, end, 1)
            high = token_behind(text, mid, BEHIND)
            if out and low <= out[-1][1]:
                out[-1][1:] = [max(high, out[-1][1]), mid]
            else:
                out.append([low, high, mid])
        return [(a, b) for a, b, _ in out]


def token_before(text: str, at: int, count: int) -> int:
    """Where the count-th word before the one at ``at`` begins; words end at blanks, so that no token is cut."""
    for _ in range(count + 1):
        while at and text[at - 1] in BLANKS:
            at -= 1
        at = max(text.rfind(c, 0, at) for c in BLANKS) + 1
    return at


def token_behind(text: str, at: int, count: int) -> int:
    """Where the count-th word ends that begins at or behind ``at``, or goes on there."""
    for _ in range(count):
        m = WORD_BEHIND.match(text, at)
        at = m.end()
    return at


def unusual(text: str) -> list[tuple[int, int]]:
    """Places, in order, outside of which a text has only tokens of plain shapes that are no keywords."""
    found = [m.span() for m in UNUSUAL_MARK.finditer(text)]
    found += [m.span() for m in UNUSUAL_CASE.finditer(text)]
    if max(map(len, text.split()), default=0) >= LONG:
        found += [m.span() for m in UNUSUAL_LENGTH.finditer(text)]
    if not text.isascii():
        found += [m.span() for m in OTHER_DIGIT.finditer(text)]
    low = text.lower()
    if any(w in low for w in KEY_STEMS):
        found += [m.span() for m in KEYWORD.finditer(text)]
    return sorted(found)


def random_secret(rng: random.Random) -> str:
    kind = rng.randrange(5)
    if kind == 0:
        return "".join(rng.choices("0123456789abcdef", k=rng.choice((18, 24, 32, 40, 64))))
    if kind == 1:
        return "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(16, 48)))
    if kind == 2:
        return "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.randint(16, 32)))
    if kind == 3:
        return rng.choice(("ghp_", "sk_", "xoxb-", "glpat-")) + "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(20, 40)))
    return "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.randint(24, 44))) + "=="


def windows(text: str, side: int = 120) -> list[tuple[list[str], list[int], list[int]]]:
    """(tokens, tags, file features) around a text's first secrets or, without any, around unusual tokens and plain ones."""
    rng, out = random.Random(hashlib.sha256(text.encode()).digest()), []
    contexts = ('password="{}"', "secret: {}", "token={}", "api_key = '{}'", "Authorization: Bearer {}", "{}", "key {}")
    parts = secret_parts(text)
    file = file_features(text)
    centres = [s for s, _ in parts[:4]] or [start for start, _ in unusual(text)[:3]]
    for c in [*centres, rng.randrange(len(text) + 1)]:
        low, high = max(0, c - side), min(len(text), c + side)
        for new in (False, True):
            piece, spans = text[low:high], [(max(s, low) - low, min(e, high) - low) for s, e in parts if s < high and e > low]
            if new:
                at = spans[0] if spans else None
                made = random_secret(rng)
                if at:
                    piece = piece[: at[0]] + made + piece[at[1] :]
                    spans = [(at[0], at[0] + len(made)), *[(s + len(made) - at[1] + at[0], e + len(made) - at[1] + at[0]) for s, e in spans[1:]]]
                else:
                    put = piece.find(" ", len(piece) // 2)
                    if put < 0:
                        continue
                    frame = rng.choice(contexts)
                    head = frame.index("{}")
                    piece = f"{piece[:put]} {frame.format(made)} {piece[put + 1 :]}"
                    spans = [(put + 1 + head, put + 1 + head + len(made))]
            found = [(m.start(), m[0]) for m in TOKEN.finditer(piece)]
            if not found:
                continue
            tags = []
            for start, t in found:
                inside = next((s for s, e in spans if start < e and start + len(t) > s), None)
                tags.append(O if inside is None else B if start <= inside or not tags or tags[-1] == O else I)
            out.append(([t for _, t in found], tags, file))
    return out


def train(texts: list[str], **how) -> Field:
    return train_windows([w for t in sorted(texts) for w in windows(t)], **how)


def train_windows(data: list[tuple[list[str], list[int], list[int]]], epochs: int = 50, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by forward and backward passes over all windows at once."""
    data = data or windows("deploy with password=Tr0ub4dor3x and id 12 on host")
    longest, m = max(len(t) for t, _, _ in data), len(data)
    x = np.zeros((m, longest, len(FEATURES)), np.float32)
    y, real = np.zeros((m, longest), np.int64), np.zeros((m, longest), bool)
    for k, (tokens, tags, file) in enumerate(data):
        for j, f in enumerate(features(tokens, file)):
            x[k, j, f] = 1
        y[k, : len(tags)], real[k, : len(tags)] = tags, True
    flat = x.reshape(-1, len(FEATURES))
    one = np.eye(3)
    e, t = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    t[O, I] = -4
    ge, gt = np.full_like(e, 1e-8), np.full_like(t, 1e-8)
    target_e = flat.T @ (one[y] * real[..., None]).reshape(-1, 3)
    both = real[:, 1:] & real[:, :-1]
    target_t = np.einsum("kja,kjb->ab", one[y[:, :-1]] * both[..., None], one[y[:, 1:]])
    for _ in range(epochs):
        s = (flat @ e.astype(np.float32)).reshape(m, longest, 3).astype(float)
        a, b = np.zeros((m, longest, 3)), np.zeros((m, longest, 3))
        a[:, 0] = s[:, 0]
        for j in range(1, longest):
            z = a[:, j - 1, :, None] + t
            top = z.max(axis=1)
            a[:, j] = np.where(real[:, j, None], top + np.log(np.exp(z - top[:, None]).sum(axis=1)) + s[:, j], a[:, j - 1])
        for j in range(longest - 2, -1, -1):
            z = t[None] + (s[:, j + 1] + b[:, j + 1])[:, None, :]
            top = z.max(axis=2)
            b[:, j] = np.where(real[:, j + 1, None], top + np.log(np.exp(z - top[..., None]).sum(axis=2)), 0)
        last = a[:, -1]
        norm = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
        p = np.exp(a + b - norm[:, None, None]) * real[..., None]
        pair = np.exp(a[:, :-1, :, None] + t + (s + b)[:, 1:, None, :] - norm[:, None, None, None]) * both[..., None, None]
        de = (target_e - flat.T @ p.reshape(-1, 3)) / m - l2 * e
        dt = (target_t - pair.sum(axis=(0, 1))) / m - l2 * t
        ge += de**2
        gt += dt**2
        e += rate * de / np.sqrt(ge)
        t += rate * dt / np.sqrt(gt)
    return Field(np.round(e, 6), np.round(t, 6)).with_calm_outside()


def sample(docs: DataFrame, text_col: str = "text", size: int = SAMPLE) -> list[tuple[list[str], list[int], list[int]]]:
    """Windows of at most 2 * size texts: the first by hash of the distinct ones with and of those without base matches."""
    text = text_of(text_col)
    marked = docs.select(F.xxhash64(text).alias("h"), text.rlike(ANY_BASE).alias("hit"), (text != "").alias("some")).where("some")
    marked = stored(marked.groupBy("h").agg(F.max("hit").alias("hit")), "secrets-hashes")
    chosen = [r["h"] for hit in (True, False) for r in marked.where(F.col("hit") == hit).orderBy("h").limit(size).collect()]
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).where(F.col("h").isin(chosen) if chosen else F.lit(False))
    texts = texts.groupBy("h").agg(F.min("text").alias("text"))

    def make():
        def f(hashes, texts):
            return hashes, [json.dumps(windows(t)) for t in texts]

        return f

    got = sorted((r["h"], r["windows"]) for r in map_batches(texts, make, "h long, windows string").collect())  # at most 2 * size rows of a few windows
    return [tuple(w) for _, found in got for w in json.loads(found)]


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, base_sha256 and all spans of each row: see RESULT. The field's spans have the kind ``crf``."""
    field = field or train_windows(sample(docs, text_col))

    def make():
        def f(doc_ids, texts):
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                spans = base_spans(text)
                n = [sum(1 for s in spans if s[0] == k) for k in KINDS]
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                more = [("crf", s, e) for s, e in field.spans(text)]
                every = sorted([*spans, *more], key=lambda s: (s[1], (*KINDS, "crf").index(s[0]))) if more else spans
                rows.append((doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in every)))
            return list(zip(*rows, strict=True)) if rows else [[]] * 6

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, RESULT)
