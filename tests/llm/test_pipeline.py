"""The pipeline from end to end against a chain of brute-force stages."""

import itertools
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(12)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(260)]
    texts = []
    for k in range(24):
        body = rng.choices(words, k=rng.choice((6, 30, 90)))
        if k % 3 == 0:
            body.insert(3, f"user{k}@mail{k}.org" if k % 2 else "+1 (200) 555-01" + str(10 + k))
        texts.append(" ".join(body))
        if k % 4 == 0:
            texts.append(" ".join(body))  # a copy
        if k % 5 == 0 and len(body) > 60:
            texts.append(" ".join([*body[:40], "changed", *body[41:]]))  # a near copy
    toxic = [" ".join([*rng.choices(words, k=9), "zogwort", *rng.choices(words, k=9)]) for _ in range(30)]
    fine = [" ".join(rng.choices(words, k=19)) for _ in range(60)]
    every = [*texts, *toxic, *fine, None, "", "long " + " ".join(rng.choices(words, k=5000))]
    rng.shuffle(every)
    docs = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(every)]
    labels = [(i, 1, int("zogwort" in (t or ""))) for i, t, *_ in docs if i % 2 == 0 or "zogwort" in (t or "")]
    return docs, labels


def clean(docs, labels):
    """The classifier of the operator, applied in a plain loop."""
    label = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    texts = {i: unicodedata.normalize("NFC", t or "") for i, t, *_ in docs}
    model = toxicity.fit([(texts[i], y) for i, y in sorted(label.items()) if i in texts])
    automaton = model.lexicon.automaton()
    return [d for d in docs if model.score(texts[d[0]], automaton) < 0.3]


def first_of_near_copies(docs):
    sets = {}
    for i, t, *_ in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [d for d in docs if root(d[0]) == d[0]]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels = corpus()
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_in_order_against_brute_force(spark, sf_dir):
    docs, labels = corpus()
    wanted = clean(docs, labels)
    assert {d[0] for d in docs} - {d[0] for d in wanted} == {i for i, t, *_ in docs if "zogwort" in (t or "")}
    kept = first_of_near_copies(wanted)
    assert len(kept) < len(wanted)
    # each address is in two distinct texts at most, so no term can disclose one
    masked = {i: pii.mask(t) if t is not None else "" for i, t, *_ in kept}
    assert sum(t != (d[1] or "") for d, t in zip(kept, masked.values(), strict=True)) >= 4
    library = Tokenizer.from_file(PATH)
    ids = {i: np.asarray([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in masked.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, parts in pieces.items():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [s for s, _ in sorted(parts)] == ends[:-1] and ends[-1] == len(ids[i])
    for parts in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [s for s, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_stages_keep_the_columns(spark, sf_dir):
    """All stages but the last return the columns of documents, with types and further columns; packing takes clashing ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()
    clashing = docs.limit(5).selectExpr("*", "1 AS start", "'x' AS ids", "2 AS length", "3 AS sequence_id")
    assert corpus_pipeline.pack_tokens(spark, clashing, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
