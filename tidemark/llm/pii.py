"""PII: pattern spans, and terms that disclose them by corpus co-occurrence.

Base spans (email, ip, card, phone) come from fixed patterns. Protected entities are the
values of these spans and their parents (an address's domain, the first parts of an ip,
the first digits of a card or a phone number), as most values are too rare to say much.
The corpus estimates how strongly a term t reveals an entity c:

    PMI(c; t) = log2( n(c,t) * N / (n(c) * n(t)) )        IC(c) = log2( N / n(c) )

All four count distinct texts: N all, n(c) those that hold c, n(c,t) those that have t
within ``REACH`` terms of c, n(t) those that hold t anywhere. So copies of a document are
one witness, repetitions inside one too, and PMI never exceeds IC. A term near c in at
least ``min_support`` texts discloses c where PMI >= generalise * IC(c); it is removed
rather than generalised from ``remove`` on. All its occurrences in texts that hold c
become spans of kind ``term``; generalised, a term becomes the class of words of its
shape and of its frequency, as in [WORD:Aa:4] for a capitalised word that one text in
10,000 to 100,000 has.

Terms are runs of three letters or more, of any script, with their marks; two in scripts
without spaces. How often candidates occur is counted over all texts, by one pass that
looks at the terms in a table of ``SLOTS`` bits only; a term's texts near any entity bound
its count from below, which rules most candidates out before that pass. Nothing that
grows with the corpus reaches the driver or is broadcast unchecked: joins are left to the
planner, which broadcasts only what is stored and small.

Null texts count as empty and have no spans. Rows that repeat keep their own results;
equal texts have equal spans. Very long texts are scanned whole. An empty table gives no
rows. Extra columns are passed through by ``sanitise`` only.
"""

from __future__ import annotations

import bisect
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Known, bounded_batches, map_batches, stored, text_of

KINDS = ("email", "ip", "card", "phone")
#: Context terms on either side of a span.
REACH = 6
MIN_SUPPORT = 3
GENERALISE, REMOVE = 0.75, 0.95
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Scripts that are written without spaces: Han, kana, Thai to Myanmar, Khmer.
UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff"
TERM = re.compile(rf"[{UNSPACED}]{{2,}}|[^\W\d_{UNSPACED}]{{3,}}")
#: The same with combining marks, for texts that have some beyond the ones of composed letters.
MARKED_TERM = rf"[{UNSPACED}]{{2,}}|(?![{UNSPACED}])\p{{L}}(?:(?![{UNSPACED}])[\p{{L}}\p{{M}}]){{2,}}"
MAY_HAVE_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u0dff\u135d-\u135f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]")
#: Bits of the table of candidate terms.
SLOTS = 1 << 20
RESULT = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ so that long runs of letters cost nothing."""
    found, free = [], 0
    for m in EMAIL_RIGHT.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in EMAIL_LEFT:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            free = m.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then by start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def terms_of(text: str):
    """Matches of the terms of a text."""
    if MAY_HAVE_MARKS.search(text):
        import regex

        return regex.finditer(MARKED_TERM, text)
    return TERM.finditer(text)


def entities(kind: str, value: str) -> tuple[str, str]:
    """The entity a span names, and its parent; hashed, as values are personal data."""
    if kind == "email":
        value, parent = value.lower(), value.lower().rpartition("@")[2]
    elif kind == "ip":
        parent = value.rpartition(".")[0]
    else:
        value = "".join(c for c in value if c.isdigit())
        parent = value[: 6 if kind == "card" else 5]
    return tuple(hashlib.sha256(f"{kind}:{level}:{v}".encode()).hexdigest()[:32] for level, v in (("value", value), ("parent", parent)))


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms outside of the spans."""
    taken, free, k = sorted((s, e) for _, s, e in spans), [], 0
    reach = 0
    for m in terms_of(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            free.append((m.start(), m.end(), m[0].lower()))
    return free


def contexts(text: str, spans: list[tuple[str, int, int]]) -> dict[str, set[str]]:
    """The terms near each entity of a text; an entity without any is there too."""
    if not spans:
        return {}
    free = free_terms(text, spans)
    starts = [s for s, _, _ in free]
    near: dict[str, set[str]] = {}
    for kind, start, end in spans:
        low = bisect.bisect_left(starts, start)
        terms = {t for _, _, t in free[max(0, low - REACH) : low + REACH]}
        for entity in entities(kind, text[start:end]):
            near.setdefault(entity, set()).update(terms)
    return near


def hashed_text(text_col: str):
    return F.xxhash64(text_of(text_col)).alias("text_hash")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One pass: each row's text_hash, and the entities of its text with the terms near them."""

    def make():
        def f(hashes, texts):
            near = [contexts(text, base_spans(text)) for text in texts]
            return hashes, [[{"entity": c, "terms": sorted(t)} for c, t in n.items()] for n in near]

        return f

    read = docs.select(hashed_text(text_col), text_of(text_col).alias("text"))
    return map_batches(read, make, "text_hash long, contexts array<struct<entity:string,terms:array<string>>>")


def counted_terms(docs: DataFrame, candidates: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): in how many distinct texts a term occurs, for all candidates (term) and what shares their slots."""
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)) + 1
    parts = candidates.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = bytearray(SLOTS // 8)
    for r in parts.collect():  # SLOTS / 8 bytes at most
        table[(r["part"] - 1) * 4096 : r["part"] * 4096] = r["bits"]
    bits = bytes(table)

    def make():
        import xxhash

        def wanted(term: str) -> bool:
            k = xxhash.xxh64_intdigest(term.encode(), 42) % SLOTS
            return bits[k >> 3] >> (k & 7) & 1 == 1

        known = Known(wanted, 200_000)

        def f(hashes, texts):
            return hashes, [[t for t in {m[0].lower() for m in terms_of(text)} if known[t]] for text in texts]

        return f

    read = docs.select(hashed_text(text_col), text_of(text_col).alias("text"))
    found = map_batches(read, make, "text_hash long, terms array<string>").where(F.size("terms") > 0)
    return found.dropDuplicates(["text_hash"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def held_entities(scanned: DataFrame) -> DataFrame:
    """(text_hash, entity, terms): the entities of each distinct text."""
    held = scanned.where(F.size("contexts") > 0).dropDuplicates(["text_hash"]).select("text_hash", F.explode("contexts").alias("c"))
    return held.select("text_hash", "c.entity", "c.terms")


def disclosing(held: DataFrame, total: int, docs: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, share, band, action): the terms whose PMI reaches the thresholds. held: stored; total: how many distinct texts there are."""
    n = F.lit(float(total))
    n_c = held.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= min_support)
    near = held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= min_support)
    # a term occurs in at least as many texts as have it near an entity
    least = held.select("text_hash", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_t"))

    def scored(pairs: DataFrame) -> DataFrame:
        pmi, ic = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))), F.log2(n / F.col("n_c"))
        # equal counts must not miss a threshold by rounding
        return pairs.withColumn("share", F.when(ic > 0, F.round(pmi / ic, 9)).otherwise(F.lit(0.0))).where(F.col("share") >= generalise)

    candidates = stored(scored(near.join(n_c, "entity").join(least, "term")).select("entity", "term", "n_ct", "n_c"), "pii-candidates")
    found = scored(candidates.join(counted_terms(docs, candidates, text_col), "term"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    return found.select("entity", "term", "share", F.floor(F.log10(n / F.col("n_t"))).cast("int").alias("band"), action.alias("action"))


def terms_by_text(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text_hash, terms): what is to be done with which terms of a text."""
    # remove outranks generalise
    hits = held.select("text_hash", "entity").join(pairs, "entity").groupBy("text_hash", "term").agg(F.max("action").alias("action"), F.max("band").alias("band"))
    return hits.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("term", "action", "band"))).alias("terms"))


def with_terms(docs: DataFrame, text_col: str, **limits) -> DataFrame:
    """docs with __terms: what disclosing terms of each row's text there are."""
    scanned = stored(scan(docs, text_col), "pii-scan")
    held = stored(held_entities(scanned), "pii-held")
    total = scanned.select("text_hash").distinct().count()
    terms = stored(terms_by_text(held, stored(disclosing(held, total, docs, text_col, **limits), "pii-pairs")), "pii-terms")
    terms = terms.select(F.col("text_hash").alias("__hash"), F.col("terms").alias("__terms"))
    return docs.join(terms, F.xxhash64(text_of(text_col)) == F.col("__hash"), "left")


def term_spans(text: str, spans: list[tuple[str, int, int]], terms) -> list[tuple[int, int, str, int]]:
    """(start, end, action, band) of the places of a text's disclosing terms."""
    if not terms:
        return []
    what = {t["term"]: (t["action"], t["band"]) for t in terms}
    return [(s, e, *what[t]) for s, e, t in free_terms(text, spans) if t in what]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of each row: see RESULT."""

    def make():
        def f(doc_ids, texts, terms):
            rows = []
            for doc_id, text, own in zip(doc_ids, texts, terms, strict=True):
                spans = base_spans(text)
                n = [sum(1 for s in spans if s[0] == k) for k in KINDS]
                base = joined(spans)
                more = [("term", s, e) for s, e, _, _ in term_spans(text, spans, own)]
                rows.append((doc_id, *n, hashlib.sha256(base.encode()).hexdigest(), joined([*spans, *more])))
            return list(zip(*rows, strict=True)) if rows else [[]] * len(RESULT)

        return f

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    read = with_terms(read, "text", **limits).select("doc_id", "text", "__terms")
    return map_batches(read, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with the same columns and rows; spans in the text are replaced by their kind or class, or removed."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text_of(text_col).alias("__text"))
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts, terms):
        import pandas as pd

        return pd.Series([mask(t, own) for t, own in zip(texts, terms, strict=True)], dtype=object)

    lines = F.transform("__terms", lambda t: F.concat_ws("\t", t["term"], t["action"], t["band"].cast("string")))
    new = with_terms(kept, "__text", **limits).withColumn("__new", masked("__text", F.array_join(lines, "\n")))
    own = F.when(F.col("__row")[text_col].isNotNull(), F.col("__new")).cast(docs.schema[text_col].dataType)
    return new.select(*[own.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns])


def shape(term: str) -> str:
    return "AA" if term.isupper() else "Aa" if term[:1].isupper() else "aa"


def mask(text: str, lines: str | None = None) -> str:
    """Base spans become [KIND], terms their class or nothing; of overlapping spans the first, then the longer one counts.

    lines: term, action and band of disclosing terms, a line each.
    """
    base = base_spans(text)
    terms = [dict(zip(("term", "action", "band"), x.split("\t"), strict=True)) for x in (lines or "").split("\n") if x]
    spans = [(s, -e, f"[{k.upper()}]") for k, s, e in base]
    spans += [(s, -e, f"[WORD:{shape(text[s:e])}:{band}]" if action == "generalise" else "") for s, e, action, band in term_spans(text, base, terms)]
    if not spans:
        return text
    out, at = [], 0
    for s, e, label in sorted(spans):
        if s >= at:
            out += [text[at:s], label]
            at = -e
    return "".join([*out, text[at:]])
