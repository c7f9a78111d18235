"""HTML extraction: markup, and a suffix array of each host that decides on what markup leaves open.

Markup names a page's text: what an ``article`` (else a ``main``) element holds, without
menus, headers, footers, asides, forms, scripts, styles, adverts, notices and comments,
which go by their elements, classes, ids and roles. On pages without such an element all
unmarked blocks are open.

A host's token streams are the blocks outside of its pages' texts, and its open blocks.
Their suffixes of at least ``DEPTH`` tokens are sorted, with the pages they stand on: a
suffix array over the host, range-partitioned by host and prefix (``PREFIX`` tokens of
each suffix are kept), so that a host's array may lie on many machines. Equal prefixes
are summed before the sort, so that a line of every page is one row. One scan over
neighbours finds the intervals whose common prefix is long, ``DEPTH`` tokens or more, and
the pages they span. An interval that a partition's border cuts is put together again.

- Open tokens covered by a substring that also stands on another page of the host go; a
  page's unique runs stay.
- A block inside an article goes if it has at least ``DEPTH`` tokens, and substrings that
  other pages of the host have outside of their texts cover it from end to end: there the
  markup was silent. Passages that articles share with each other stay.

Tags are found by a scanner that takes linear time on any input.

Null html gives an empty text, a null url a host of its own. Rows that repeat are kept,
each with its own result; equal page ids count as one page. Very long pages are taken
whole. An empty table gives no rows. Extra columns are ignored. Pages of equal text are
told apart by id only, so which of them come first doesn't matter.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

#: Tokens of a substring that counts as long, and tokens of each suffix that are kept.
DEPTH, PREFIX = 8, 16
#: Longer tokens take part by their hash.
LONG_TOKEN = 64
SCHEMA = "page_id long, url string, text string, n_chars long"
NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"=\s*([\"'])|>")
#: A character reference with more digits than any code point has.
TOO_LONG = re.compile(r"&#[0-9]{8,};?")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.IGNORECASE)
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "head", "svg", "object", "dialog", "menu", "audio", "video", "canvas", "math", "fieldset", "label"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of classes, ids and roles that mark what is no article text.
MARKED = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header menu masthead modal nav navbar navigation newsletter notice notices popup promo promoted recommended related reader-comments share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())
WORD = re.compile(r"[a-z]+|[0-9]+")


def is_marked(attributes: str) -> bool:
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() != "itemprop" and any(not MARKED.isdisjoint(WORD.findall(part)) for part in value.split()):
            return True
    return False


class Scanner:
    """Tags of a page, in linear time: what a failed search has shown isn't searched for again."""

    def __init__(self, page: str):
        self.page, self.missing, self.quotes = page, set(), True

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``; -1 if it doesn't."""
        start = at
        while self.quotes:
            m = STOP.search(self.page, at)
            if m is None:
                self.quotes = False  # from here to the end quotes hide each >
            elif m[1] is None:
                return m.end()
            else:
                close = self.find(m[1], m.end())
                at = close + 1 if close >= 0 else m.end()
        return self.find(">", start) + 1 or -1

    def tag(self, at: int) -> tuple[int, bool, str, str] | None:
        """(end, closing, name, attributes) of what < at ``at`` begins; name is empty for comments and the like; None if it is text."""
        page = self.page
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), False, "", ""
        if page.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return (end + 1, False, "", "") if end >= 0 else None
        closing = page.startswith("/", at + 1)
        m = NAME.match(page, at + 1 + closing) if ">" not in self.missing else None
        if m is None:
            return None
        end = self.tag_end(m.end())
        return (end, closing, m[0].lower(), page[m.end() : end - 1]) if end >= 0 else None


def plain(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    if "&" in text:
        text = html_lib.unescape(TOO_LONG.sub("\ufffd", text) if "&#" in text else text)
    return " ".join(text.split())


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of each block in page order; place: article, main, open or, for marked parts, outside."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # element, place, dropped
    open_at: dict[str, int] = {}  # how many elements of a name are open
    block_depths: list[int] = []
    place, dropped, at, looked = "open", False, 0, 0
    pieces: list[str] = []
    side: list[str] = []  # of dropped parts

    def close(held: list[str], where: str) -> None:
        if held:
            text = plain("".join(held))
            if text:
                out.append((where, text))
            held.clear()

    def pop_to(depth: int) -> None:
        nonlocal place, dropped
        if block_depths and block_depths[-1] >= depth:
            close(side, "outside")
            close(pieces, place)
        while block_depths and block_depths[-1] >= depth:
            block_depths.pop()
        for name, _, _ in stack[depth:]:
            open_at[name] -= 1
        del stack[depth:]
        _, place, dropped = stack[-1] if stack else ("", "open", False)

    scanner = Scanner(page)
    while (lt := page.find("<", looked)) >= 0:
        found = scanner.tag(lt)
        if found is None:
            looked = lt + 1
            continue
        if lt > at:
            (side if dropped else pieces).append(page[at:lt])
        at, closing, name, attributes = found
        looked = at
        if not name:
            continue
        if closing:
            if open_at.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                pop_to(depth)
            elif (name == "p" or name in HEADINGS) and not dropped:
                close(pieces, place)
            continue
        if name in BLOCK:
            if dropped:
                close(side, "outside")
            else:
                close(pieces, place)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = looked = end.end() if end else len(page)
            continue
        if name in CLOSES_P and block_depths and stack[block_depths[-1]][0] == "p":
            pop_to(block_depths[-1])
        if attributes.endswith("/") and name not in BLOCK:
            continue
        gone = dropped or name in DROPPED or bool(attributes) and is_marked(attributes)
        inside = place
        if not gone and name in ("article", "main") and place != "article":
            inside = name
        if name in BLOCK:
            block_depths.append(len(stack))
        open_at[name] = open_at.get(name, 0) + 1
        stack.append((name, inside, gone))
        place, dropped = inside, gone
    (side if dropped else pieces).append(page[at:])
    close(side, "outside")
    close(pieces, place)
    return out


def text_place(found: list[tuple[str, str]]) -> str:
    """Where the text is: article, main or open."""
    places = {p for p, _ in found}
    return next((p for p in ("article", "main") if p in places), "open")


def article_text(found: list[tuple[str, str]]) -> str | None:
    """The text where markup shows it, else None."""
    place = text_place(found)
    return None if place == "open" else " ".join([t for p, t in found if p == place])


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def stream(text: str) -> list[str]:
    """A block's tokens as they are compared."""
    import xxhash

    return [t if len(t) <= LONG_TOKEN else xxhash.xxh128_hexdigest(t) for t in text.lower().split(" ")]


def key_of(tokens: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(tokens)) - (1 << 63)


def suffixes(tokens: list[str]):
    """(position, prefix) of each suffix of DEPTH tokens or more; of the whole where there are fewer."""
    for k in range(max(1, len(tokens) - DEPTH + 1)):
        yield k, "\x1f".join(tokens[k : k + PREFIX])


def cover(tokens: list[str]) -> list[int]:
    """Keys of substrings of DEPTH tokens that cover a block from end to end."""
    last = len(tokens) - DEPTH
    return [key_of(tokens[k : k + DEPTH]) for k in [*range(0, last, DEPTH), last]]


#: Rows of the streams: kinds of rows.
OUTSIDE, OPEN, BLOCK_OF_TEXT = 0, 1, 2
STREAMS = "kind int, host long, page long, row long, pos int, prefix string, cover array<long>"


def row_key():
    return F.xxhash64("page_id", "url", "html")


def columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def streams(pages: DataFrame) -> DataFrame:
    """One pass: suffixes of what is outside of texts and of open blocks, and the blocks of texts."""

    def rows_of(host, page, row, html):
        found = blocks(html or "")
        place = text_place(found)
        if place == "open":
            tokens = [t for p, b in found if p == "open" for t in stream(b)]
            if tokens:
                for k, prefix in suffixes(tokens):
                    yield OPEN, host, page, row, k, prefix, None
        at = 0
        for where, text in found:
            if where == place != "open":
                if text.count(" ") >= DEPTH - 1:
                    yield BLOCK_OF_TEXT, host, page, row, at, None, cover(stream(text))
                at += 1
            elif where != place and text.count(" ") >= DEPTH - 1:
                for _, prefix in suffixes(stream(text)):
                    yield OUTSIDE, host, page, None, None, prefix, None

    def every(batches):
        out = []
        for ids, rows, urls, html in batches:
            for page, row, url, text in zip(ids, rows, urls, html, strict=True):
                for made in rows_of(key_of([host_of(url)]), -1 if page is None else page, row, text):
                    out.append(made)
                    if len(out) >= 4096:
                        yield zip(*out, strict=True)
                        out.clear()
        if out:
            yield zip(*out, strict=True)

    every.streaming = True
    return map_batches(columns(pages).select("page_id", row_key().alias("row"), "url", "html"), lambda: every, STREAMS)


def suffix_array(rows: DataFrame) -> DataFrame:
    """host, prefix, first and last page, first and last page that has it outside of its text: sorted by host and prefix."""
    outside = F.when(F.col("kind") == OUTSIDE, F.col("page"))
    sums = [F.min("page").alias("first"), F.max("page").alias("last"), F.min(outside).alias("out_first"), F.max(outside).alias("out_last")]
    return rows.where(F.col("kind") != BLOCK_OF_TEXT).groupBy("host", "prefix").agg(*sums).orderBy("host", "prefix")


def common(a: list[str], b: list[str]) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def long_intervals(array: DataFrame) -> DataFrame:
    """(host, head, pages): the array's intervals of a common prefix of DEPTH tokens, or of equal shorter suffixes; head is that prefix's key."""

    def scan(batches):
        host, before, held = None, None, None
        for cols in batches:
            out = []
            for h, prefix, *span in zip(*cols, strict=True):
                tokens = prefix.split("\x1f")
                same = h == host and (tokens == before or common(before, tokens) >= DEPTH)
                if same:
                    held = [f(x for x in (a, b) if x is not None) if (a, b) != (None, None) else None for f, a, b in zip((min, max, min, max), held, span, strict=True)]
                else:
                    if before is not None:
                        out.append((host, key_of(before[:DEPTH]), *held))
                    held = list(span)
                host, before = h, tokens
            yield zip(*out, strict=True) if out else [[]] * 6
        if before is not None:
            yield zip((host, key_of(before[:DEPTH]), *held), strict=True)

    scan.streaming = True
    found = map_batches(array, lambda: scan, "host long, head long, first long, last long, out_first long, out_last long")
    return found.groupBy("host", "head").agg(*[f(c).alias(c) for f, c in ((F.min, "first"), (F.max, "last"), (F.min, "out_first"), (F.max, "out_last"))])


def decisions(pages: DataFrame) -> DataFrame:
    """(row, blocks, starts): the numbers of the blocks of text that go, and where covered substrings of open streams start."""
    rows = stored(streams(pages), "html-streams")
    intervals = stored(long_intervals(suffix_array(rows)), "html-intervals")
    repeated = intervals.where("first != last").select("host", "head")
    starts = rows.where(F.col("kind") == OPEN).select("row", "host", "pos", "prefix")
    starts = map_batches(starts, heads, "row long, host long, pos int, head long").join(repeated, ["host", "head"])
    starts = starts.groupBy("row").agg(F.collect_set("pos").alias("starts"))
    # a block's first substring decides whether the others are looked up at all
    outside = intervals.where("out_first IS NOT NULL").select("host", "head", "out_first", "out_last")
    elsewhere = (F.col("out_first") != F.col("page")) | (F.col("out_last") != F.col("page"))
    texts = rows.where(F.col("kind") == BLOCK_OF_TEXT).withColumn("head", F.col("cover")[0])
    likely = texts.join(outside, ["host", "head"]).where(elsewhere).select("host", "page", "row", "pos", "cover")
    parts = likely.distinct().select("host", "page", "row", "pos", F.size(F.array_distinct("cover")).alias("n"), F.explode(F.array_distinct("cover")).alias("head"))
    covered = parts.join(outside, ["host", "head"]).where(elsewhere).groupBy("row", "pos", "n").agg(F.count_distinct("head").alias("got")).where("got = n")
    gone = covered.groupBy("row").agg(F.collect_set("pos").alias("blocks"))
    return stored(gone.join(starts, "row", "full").select("row", "blocks", "starts"), "html-decisions")


def heads():
    def f(rows, hosts, places, prefixes):
        return rows, hosts, places, [key_of(p.split("\x1f")[:DEPTH]) for p in prefixes]

    return f


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""

    def make():
        def f(ids, urls, pages_html, gone, starts):
            texts = [kept_text(blocks(h or ""), set(g or ()), s or ()) for h, g, s in zip(pages_html, gone, starts, strict=True)]
            return ids, urls, texts, [len(t) for t in texts]

        return f

    marked = columns(pages).withColumn("row", row_key()).join(decisions(pages), "row", "left")
    return map_batches(marked.select("page_id", "url", "html", "blocks", "starts"), make, SCHEMA)


def kept_text(found: list[tuple[str, str]], gone: set[int], starts) -> str:
    """A page's text without the blocks and the substrings that go."""
    place = text_place(found)
    texts = [t for p, t in found if p == place]
    if place != "open":
        return " ".join([t for k, t in enumerate(texts) if k not in gone])
    tokens = [t for b in texts for t in b.split(" ")]
    covered = bytearray(len(tokens))
    for s in starts:
        n = min(DEPTH, len(tokens) - s)
        covered[s : s + n] = b"\x01" * n
    return " ".join([w for w, c in zip(tokens, covered, strict=True) if not c])
