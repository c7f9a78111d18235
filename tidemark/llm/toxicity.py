"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned from labelled rows: words and word beginnings that occur, in
varied contexts, in toxic texts and hardly ever in others. Its trie is intersected with
the Levenshtein automaton of distance 1; the product is made deterministic state by state
as texts need it, so a token costs one table step for each character, and most die early.
A term's misspellings count only if they stay pure in the labelled rows too.

Each hit is weighed by its window: quotation marks around it or words of reporting near
it make it a quotation; pronouns of address make it abuse. A logistic regression over the
summed weights of exact, misspelled and quoted hits gives the score.

The fit uses a bounded sample, ``TRAIN_ROWS`` labelled ids, the first by a hash, with one
text each. Scores depend on the text alone. Null texts count as empty, and get the score
of a text without hits. Very long texts are scored whole. Rows that repeat get equal
scores; an empty table gives no rows. Extra columns are ignored, and kept by
``keep_clean``. With no labelled rows of both classes the lexicon is empty and all scores
are the base rate.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, text_of

TRAIN_ROWS = 4000
#: Occurrences in different contexts, and toxic documents, that a term needs.
MIN_CONTEXTS, MIN_DOCS = 3, 3
#: A term must be so many times as frequent in toxic texts, with a likelihood ratio above what the best of as many random terms would have.
LEAST_RATIO, SURPLUS = 5, 4
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
#: Letters of the shortest terms; a quotation that isn't closed ends after so many tokens.
LEAST_LETTERS, QUOTE_TOKENS = 2, 200
#: Misspellings are looked for in terms of at least so many letters.
FUZZY_LETTERS = 5
THRESHOLD = 0.3
WINDOW = 8
QUOTES = "\"“”„«»‹›"
#: Fixed word lists for the windows.
REPORTING = frozenset("said says say called calls quote quoted quotes term word wrote writes sagte nannte zitat wort dit mot cita dijo palabra llamó".split())
ADDRESS = frozenset("you your you're u du dich dein ihr tu te toi vous usted ustedes tú".split())
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
SCHEMA = "doc_id long, score double, predicted int"


def clean(token: str) -> str:
    """A token without marks at its edges; marks inside stay, as letters are disguised by them."""
    return EDGE.sub("", token)


class Lexicon:
    """Terms with their weights. A term that ends in ``*`` stands for all words that begin with it."""

    def __init__(self, terms: dict[str, float], fuzzy: frozenset[str] = frozenset()):
        self.terms, self.fuzzy = dict(sorted(terms.items())), fuzzy
        self.names = list(self.terms)

    def automaton(self) -> Automaton:
        return Automaton(self.names, self.fuzzy)


class Automaton:
    """The product of the trie of terms with the distance-1 Levenshtein automaton, made deterministic on demand."""

    CACHE = 400_000

    def __init__(self, names: list[str], fuzzy: frozenset[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.open: list[bool] = [False]  # the term that ends here stands for a beginning
        self.may_err: list[bool] = [False]  # some term below may be misspelled
        for k, name in enumerate(names):
            node, is_fuzzy = 0, name in fuzzy
            self.may_err[0] |= is_fuzzy
            for c in name.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.open.append(False)
                    self.may_err.append(False)
                node = self.children[node][c]
                self.may_err[node] |= is_fuzzy
            self.ends[node], self.open[node] = k, name.endswith("*")
        self.fuzzy_term = [n in fuzzy for n in names]
        self.alphabet = {c for kids in self.children for c in kids}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.passing: list[tuple[int, int] | None] = []
        self.start = self.state(self.closed({(0, 0)}))
        self.cache: dict[str, tuple[int, int] | None] = {}

    def closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that a missing letter reaches; of equal nodes the one with fewer errors stays."""
        full = set(states)
        for node, errors in states:
            if errors == 0:
                full.update((kid, 1) for kid in self.children[node].values() if self.may_err[kid])
        exact = {n for n, e in full if e == 0}
        return frozenset((n, e) for n, e in full if e == 0 or n not in exact)

    def state(self, states: frozenset) -> int:
        if (found := self.ids.get(states)) is None:
            found = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            hits = [(e, self.ends[n], self.open[n]) for n, e in states if self.ends[n] is not None and (e == 0 or self.fuzzy_term[self.ends[n]])]
            self.at_end.append(min(((e, t) for e, t, _ in hits), default=None))
            self.passing.append(min(((e, t) for e, t, is_open in hits if is_open), default=None))
        return found

    def step(self, state: int, c: str) -> int:
        key = c if c in self.alphabet else ""
        if (found := self.steps[state].get(key)) is None:
            after: set[tuple[int, int]] = set()
            for node, errors in self.sets[state]:
                kid = self.children[node].get(c)
                if kid is not None and (errors == 0 or self.may_err[kid]):
                    after.add((kid, errors))
                if errors == 0 and self.may_err[node]:
                    after.add((node, 1))
                    after.update((k, 1) for k in self.children[node].values() if self.may_err[k])
            found = self.steps[state][key] = self.state(self.closed(after))
        return found

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, errors) of the best match of a lower-case token, exact ones before misspelled ones."""
        try:
            return self.cache[token]
        except KeyError:
            pass
        word, state, best = clean(token), self.start, None
        for c in word:
            state = self.step(state, c)
            if not self.sets[state]:
                break
            if (hit := self.passing[state]) is not None and (best is None or hit < best):
                best = hit
        else:
            if word and (hit := self.at_end[state]) is not None and (best is None or hit < best):
                best = hit
        found = None if best is None else (best[1], best[0])
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        if len(token) <= 64:
            self.cache[token] = found
        return found


def hits(text: str, automaton: Automaton) -> list[tuple[int, int, float, bool]]:
    """(term, errors, address weight, quoted) for each hit of a text."""
    tokens = text.lower().split()
    match = automaton.match
    found = {t: h for t in set(tokens) if (h := match(t)) is not None}
    if not found:
        return []
    out, open_quote, opened = [], False, 0
    for k, t in enumerate(tokens):
        if open_quote and k - opened > QUOTE_TOKENS:  # a mark that never closes doesn't turn the rest of a text into a quotation
            open_quote = False
        marks = sum(t.count(q) for q in QUOTES)
        if t in found:
            near = [clean(x) for x in tokens[max(0, k - WINDOW) : k + WINDOW + 1]]
            quoted = open_quote or t[0] in QUOTES or t[0] == "'" or any(x in REPORTING for x in near)
            address = 1.25 if any(x in ADDRESS for x in near) else 1.0
            out.append((*found[t], address, quoted))
        if marks % 2:
            open_quote, opened = not open_quote, k
    return out


#: Weights before any data: bias, exact, misspelled and quoted hits, density. Kinds of hits that the sample lacks keep them.
PRIOR = np.array([-2.0, 1.5, 1.5, 0.3, 0.5])


class Model:
    """Lexicon and regression."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights
        self.strength = list(lexicon.terms.values())

    def sums(self, text: str, automaton: Automaton) -> tuple[float, float, float, float]:
        exact = wrong = quoted = 0.0
        strength = self.strength
        for term, errors, address, is_quoted in hits(text, automaton):
            w = strength[term] * address
            if is_quoted:
                quoted += w
            elif errors:
                wrong += w
            else:
                exact += w
        density = (exact + wrong) / (text.count(" ") + 20) * 100 if exact or wrong else 0.0
        return math.log1p(exact), math.log1p(wrong), math.log1p(quoted), math.log1p(density)

    def score(self, text: str, automaton: Automaton) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.sums(text, automaton), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def beginnings(word: str):
    yield word
    for n in PREFIX_LENGTHS:
        if len(word) > n:
            yield word[:n] + "*"


def likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """G squared of a term in a of n_a toxic and b of n_b clean texts."""
    total = 0.0
    for got, n in ((a, n_a), (b, n_b)):
        for seen, rate in ((got, (a + b) / (n_a + n_b)), (n - got, 1 - (a + b) / (n_a + n_b))):
            if seen:
                total += 2 * seen * math.log(seen / (n * rate))
    return total


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """rows: text and label."""
    toxic, fine = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not toxic or not fine:
        return Lexicon({})
    around: dict[str, set] = defaultdict(set)
    in_toxic: Counter = Counter()
    for text in toxic:
        tokens = [clean(t) for t in text.lower().split()]
        seen = set()
        for before, t, after in zip(["", *tokens], tokens, [*tokens[1:], ""], strict=False):
            if len(t) >= LEAST_LETTERS and t.isalpha():
                context = hash((before, after))
                for b in beginnings(t):
                    seen.add(b)
                    around[b].add(context)
        in_toxic.update(seen)
    # copies of a text repeat contexts, so a term counts as often as its contexts differ
    in_toxic = Counter({b: min(n, len(around[b])) for b, n in in_toxic.items() if n >= MIN_DOCS and len(around[b]) >= MIN_CONTEXTS})
    in_fine: Counter = Counter()
    for text in fine:
        seen = set()
        for t in {clean(t) for t in text.lower().split()}:
            seen.update(b for b in beginnings(t) if b in in_toxic)
        in_fine.update(seen)
    limit = 2 * math.log(max(2, len(around))) + SURPLUS
    gain, weight = {}, {}
    for b, n in in_toxic.items():
        p, q = (n + 0.5) / (len(toxic) + 1), (in_fine[b] + 0.5) / (len(fine) + 1)
        if p > LEAST_RATIO * q and (g := likelihood_ratio(n, in_fine[b], len(toxic), len(fine))) >= limit:
            gain[b], weight[b] = g, math.log(p / q)
    kept: dict[str, float] = {}
    for b in sorted(gain, key=lambda b: (-gain[b], b.endswith("*"), len(b), b)):
        stem = b.rstrip("*")
        if not any(stem.startswith(k.rstrip("*")) or k.rstrip("*").startswith(stem) for k in kept):
            kept[b] = weight[b]
    fuzzy = frozenset(b for b in kept if len(b.rstrip("*")) >= FUZZY_LETTERS)
    return prune_fuzzy(Lexicon(kept, fuzzy), toxic, fine)


def prune_fuzzy(lexicon: Lexicon, toxic: list[str], fine: list[str]) -> Lexicon:
    """Only terms whose misspellings hardly occur in clean documents keep them."""
    automaton, wrong = lexicon.automaton(), Counter()
    for text in fine:
        wrong.update({h[0] for t in set(text.lower().split()) if (h := automaton.match(t)) is not None and h[1]})
    limit = max(0.0, 0.0005 * len(fine))
    return Lexicon(lexicon.terms, frozenset(n for k, n in enumerate(lexicon.names) if n in lexicon.fuzzy and wrong[k] <= limit))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Lexicon, then weights by Newton steps of a penalised logistic regression."""
    lexicon = learn_lexicon(rows)
    model, automaton = Model(lexicon, np.zeros(5)), lexicon.automaton()
    if not rows:
        return Model(lexicon, PRIOR.copy())
    x = np.array([(1.0, *model.sums(t, automaton)) for t, _ in rows])
    y = np.array([1.0 if y else 0.0 for _, y in rows])
    w = PRIOR.copy()
    penalty = np.diag([1e-3, 0.1, 0.1, 0.1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 2)
    return Model(lexicon, np.round(w, 9))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that must not teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """At most ``size`` labelled texts outside the held-out part, the first by hash of the id."""
    ids = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = ids.orderBy(F.xxhash64("__id"), "__id").limit(size)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id")  # at most ``size`` rows
    rows = rows.groupBy("__id", "__y").agg(F.min("text").alias("text"))  # one text for an id that rows repeat
    got = sorted((r["__id"], r["text"], r["__y"]) for r in rows.collect())
    return [(unicodedata.normalize("NFC", t), y) for _, t, y in got]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, score and prediction in one pass."""

    def make():
        automaton = model.lexicon.automaton()

        def f(doc_ids, texts):
            scores = [round(model.score(unicodedata.normalize("NFC", t), automaton), 9) for t in texts]
            return doc_ids, scores, [int(s >= THRESHOLD) for s in scores]

        return f

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), make, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; same columns."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def is_clean(texts):
        import pandas as pd

        automaton = _automaton_of(model)
        return pd.Series([model.score(unicodedata.normalize("NFC", t), automaton) < THRESHOLD for t in texts], dtype=bool)

    return docs.where(is_clean(text_of(text_col)))


_automata: dict[tuple, Automaton] = {}


def _automaton_of(model: Model) -> Automaton:
    """One for each lexicon and worker process."""
    key = (tuple(model.lexicon.names), model.lexicon.fuzzy)
    if key not in _automata:
        _automata.clear()
        _automata[key] = model.lexicon.automaton()
    return _automata[key]
