import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.model(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("the and ing  ▁\n\t.,<s>'0123")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_as_the_library(text):
    ids = LIBRARY.encode(text)
    assert MODEL.encode(text) == ids
    assert MODEL.decode([*ids, MODEL.eos]) == LIBRARY.decode([*ids, MODEL.eos])


def test_pairs_by_definition():
    some = [i for i in MODEL.id_of.values() if i < 1500 and "▁▁" not in MODEL.piece[i]]
    for k, a in enumerate(some[::3]):
        for b in some[k % 7 :: 97]:
            if not MODEL.piece[b].startswith("▁"):
                x, y = MODEL.piece[a], MODEL.piece[b]
                assert MODEL.compatible(a, b) == (MODEL.merged(x + y) == [x, y]), (x, y)


def test_long_runs():
    for text in (" " * 5000 + "a", "a" * 3000, "é" * 500 + " " * 33, "的" * 400):
        assert MODEL.encode(text) == LIBRARY.encode(text)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode_documents(docs, PATH).collect()}
    assert got == {1: ([*LIBRARY.encode("Hello  world"), 2], "Hello  world"), 2: ([2], "")}
