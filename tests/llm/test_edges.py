"""Null, empty, repeated, very long and clashing rows through every operator."""

import public_tokenizers
import pytest

from tidemark.llm import html_extract, ibloom, media, minhash, packing, pieces, pii, secrets, token_rollup, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, digest string, `row` int"
LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 40000
ROWS = [(i, t, "en", "s", len(t or ""), 7, 0.5, "d", 1) for i, t in [(1, None), (2, ""), (3, "  \n "), (4, LONG), (5, "same text here, again and again."), (6, "same text here, again and again."), (6, "same text here, again and again."), (7, "mail a.b@c.de now"), (None, "no id")]]
MODEL = toxicity.fit([("you idiot " + w, 1) for w in "abcdefghij"] + [("fine words " + w, 0) for w in "abcdefghijklmnopqrst"])
FIELD = secrets.train(['password="abcdef123456"', "plain words only here"], epochs=5)
OPERATORS = {
    "pii": pii.find,
    "secrets": lambda d: secrets.find(d, FIELD),
    "minhash": minhash.near_duplicates,
    "packing": lambda d: packing.pack(d, WORDS),
    "toxicity": lambda d: toxicity.score(d, MODEL),
    "media": lambda d: media.read_media(media.store_texts(d)),
    "fingerprints": ibloom.fingerprints,
    "pieces": lambda d: pieces.encode_digests(d, PIECES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = OPERATORS[name](docs).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, None}
        assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 6)
    else:
        assert sorted(ids, key=str) == sorted([r[0] for r in ROWS], key=str)
        same = {tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "component_id", "kept")) for r in rows if r["doc_id"] in (5, 6)}
        assert len(same) == 1, "equal texts must have equal results"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_minhash_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 2, 5, True), (6, 2, 5, False), (None, 1, None, True)} <= got


def test_stages_keep_columns_and_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert toxicity.keep_clean(docs, MODEL).columns == docs.columns
    masked = pii.sanitise(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert [r["text"] for r in masked.where("doc_id = 7").collect()] == ["mail [EMAIL] now"]
    assert masked.where("doc_id = 1 AND text IS NULL").count() == 1
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1 and kept.where("doc_id = 6").count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "http://h/a", "", "x"), (None, "http://h/b", "<p>a", "x"), (2, "http://h/a", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "", 0), (None, "a", 1)], key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_rollup_of_odd_rows(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    rollup.insert("a", spark.createDataFrame(ROWS, SCHEMA))
    rollup.insert("none", spark.createDataFrame([], SCHEMA))
    assert {r["n_docs"] for r in rollup.totals().collect()} == {len(ROWS)}
