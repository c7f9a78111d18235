import html
import random
import time

from tidemark.llm import html_extract
from tidemark.llm.html_extract import article_text, blocks


def text(page):
    return article_text(blocks(page))


def test_parts_that_are_no_text():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>
    <header>site</header><nav><ul><li><a href="/">menu</a></ul></nav><div class="cookie-notice">cookies</div><!-- <article>no</article> -->
    <article><h1>Title &amp; more</h1><p>One <b>two</b>three&#33;<p>four<br>five <aside>side</aside><form>send</form>
    <div class='ad'>buy</div><section id="comments"><p>me too</p></section><ul><li>six</li><li>sev\n en</li></ul></article><footer>end &copy;</footer></body></html>"""
    assert text(page) == "Title & more One twothree! four five six sev en"


def test_broken_markup():
    assert text("<article><p>a < b &amp c<p>d") == "a < b & c d"
    assert text('<article><p title="x>y">q</p></b></article>') == "q"
    assert text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert text("<main><p>m</main><p>n") == "m"
    assert text("<p>no article") is None and text("") is None


def test_classes_that_only_look_marked():
    assert text('<article class="post shadow"><p class="headline lead">a</p><p class="readable">b</p></article>') == "a b"


def test_pages_of_the_test_data(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        for tag in ("<p>", "</p>", "<br>", "<h1>", "</h1>"):
            inside = inside.replace(tag, " ")
        for tag in ("<b>", "</b>", "<i>", "</i>"):
            inside = inside.replace(tag, "")
        assert text(r["html"]) == " ".join(html.unescape(inside).split())


def test_repeated_runs_of_a_host(spark):
    """Without an article, token runs that other pages of the host share go; the same run on another host stays."""
    shared = "all rights reserved by this site since long ago and ever"
    pages = [(k, f"http://one.example/{k}", f"<div>{shared}</div><p>own text number n{k} of this page only {'x' * k}</p>") for k in range(1, 4)]
    pages.append((9, "http://two.example/", f"<div>{shared}</div>"))
    got = extracted(spark, pages)
    assert all(shared not in got[k] and f"n{k}" in got[k] for k in (1, 2, 3))
    assert got[9] == shared
    assert brute(pages) == got


def test_silent_markup_inside_an_article(spark):
    """A block of an article goes if other pages of the host have it outside of their texts; what only articles share stays."""
    notice = "this site uses small files to remember what you have chosen before"
    passage = "a passage of some length that several articles of this host quote in full"
    pages = [
        (1, "http://a.example/1", f"<article><p>first text</p><p>{notice}</p><p>{passage}</p></article>"),
        (2, "http://a.example/2", f"<article><p>second text</p><p>{passage}</p></article><footer>see also: {notice} and more</footer>"),
        (3, "http://b.example/3", f"<article><p>third text</p><p>{notice}</p></article>"),
        (4, "http://a.example/4", f"<article><p>{notice} but here it goes on in the article's own words</p></article>"),
        (5, "http://c.example/5", f"<article><p>{notice}</p></article><aside>{notice}</aside>"),  # on no other page
    ]
    got = extracted(spark, pages)
    assert got == {1: f"first text {passage}", 2: f"second text {passage}", 3: f"third text {notice}", 4: f"{notice} but here it goes on in the article's own words", 5: notice}
    assert brute(pages) == got


def test_generated_hosts(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("ab cd ef gh ij kl mn op qr st uv wx".split(), k=rng.choice((3, 8, 9, 14, 30)))) for _ in range(40)]
    pages = []
    for k in range(160):
        tags = lambda name: "".join(f"<p>{rng.choice(lines)}" for _ in range(rng.randrange(4))).join((f"<{name}>", f"</{name}>"))
        body = "".join(tags(rng.choice(("article", "div", "footer", "nav", "section"))) for _ in range(rng.randrange(5)))
        pages.append((k // 2 * 2 if k % 9 == 0 else k, f"http://h{rng.choice((0, 0, 0, 1, 2))}.example/{k}", body if k % 11 else None))
    pages.append((None, None, f"<p>{lines[0]}"))
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect())
    assert got == sorted((str(p[0]), str(p[1]), t, len(t)) for p, t in zip(pages, brute_texts(pages), strict=True))


def test_sorted_suffixes_and_their_intervals(spark):
    """The array is sorted, and neighbours with a long common prefix make one interval."""
    pages = [(k, "http://a.example/", f"<footer>{' '.join('one two three four five six seven eight'.split() + [f'end{k}', 'x', 'y'])}</footer><article>text</article>") for k in range(30)]
    rows = html_extract.streams(spark.createDataFrame(pages, "page_id long, url string, html string"))
    array = html_extract.suffix_array(rows)
    prefixes = [r["prefix"] for r in array.collect()]
    assert prefixes == sorted(prefixes) and len(prefixes) == 30 * 4
    spans = {(r["first"], r["last"]) for r in html_extract.long_intervals(array).collect()}
    assert (0, 29) in spans and len(spans) == 31


def test_hostile_pages_take_linear_time():
    n = 250_000
    pages = ["<a" * n, '<a href="' * n, "<a b='c\" " * n, "<div>" * n + "</p>" * n, "<p><b>" * n + "</i>" * n, "<!--" * n, "<a b=" + "\"x'" * n, "</" * n, "&#" + "9" * n + ";", "<a " + "class=" * n + ">", "<" * n + ">", "<script>" * n]
    for page in pages:
        began = time.process_time()
        blocks(page)
        assert time.process_time() - began < 8, page[:20]


def extracted(spark, pages):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def brute(pages):
    return {k: t for (k, _, _), t in zip(pages, brute_texts(pages), strict=True)}


def brute_texts(pages):
    """All token runs compared with those of all other pages of the host."""
    n = html_extract.DEPTH

    def grams(tokens):
        return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()

    facts = []
    for k, url, page in pages:
        found = blocks(page or "")
        place = next((p for p in ("article", "main") if any(q == p for q, _ in found)), "open")
        open_tokens = [t for p, b in found if p == place == "open" for t in b.lower().split(" ")]
        outside = {g for p, b in found if p != place and b.count(" ") >= n - 1 for g in grams(b.lower().split(" "))}
        facts.append((-1 if k is None else k, html_extract.host_of(url), place, found, grams(open_tokens) | outside, outside))
    out = []
    for k, host, place, found, _, _ in facts:
        every = {g for j, h, _, _, e, _ in facts if j != k and h == host for g in e}
        outside = {g for j, h, _, _, _, o in facts if j != k and h == host for g in o}
        texts = [b for p, b in found if p == place]
        if place == "open":
            tokens = [t for b in texts for t in b.split(" ")]
            low, gone = [t.lower() for t in tokens], set()
            for s in range(max(1, len(low) - n + 1)):
                if tuple(low[s : s + n]) in every:
                    gone.update(range(s, s + n))
            out.append(" ".join(t for i, t in enumerate(tokens) if i not in gone))
        else:
            kept = []
            for b in texts:
                low = b.lower().split(" ")
                at = [*range(0, len(low) - n, n), len(low) - n]
                if len(low) < n or not all(tuple(low[i : i + n]) in outside for i in at):
                    kept.append(b)
            out.append(" ".join(kept))
    return out
