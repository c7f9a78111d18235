import itertools
import random

import numpy as np

from tidemark.llm import minhash


def corpus(rng):
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice((3, 8, 40, 120)))
        texts.append(base)
        for _ in range(rng.choice((0, 1, 4))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    hot = rng.choices(vocabulary, k=60)
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.choice((0, 1, 2, 3))):
            copy[rng.randrange(60)] = rng.choice(vocabulary)
        texts.append(copy)
    rng.shuffle(texts)
    return [" ".join(t).title() if rng.random() < 0.3 else "\t".join(t) for t in texts]


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k):
    sets, up = [shingles(t, k) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_against_all_pairs(spark, monkeypatch):
    texts = corpus(random.Random(11))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for k, block, shingles_held in ((4, 2048, 1 << 20), (5, 8, 200)):  # with small blocks every group takes several
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles_held)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, shingle=k).collect()}
        assert got == brute(texts, k)


def test_components_by_stars(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    got = {r["u"]: r["v"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = minhash.Links()
    for a, b in edges:
        links.join(a, b)
    nodes = {x for e in edges for x in e}
    assert all(got.get(x, x) == links.root(x) for x in nodes)


def test_exact_threshold():
    a = np.arange(8, dtype=np.uint64)
    assert minhash.similar(a, np.arange(10, dtype=np.uint64), 80)
    assert not minhash.similar(a, np.arange(11, dtype=np.uint64), 80)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    agree = (minhash.minima(a) == minhash.minima(b)).mean()
    assert abs(agree - 800 / 1200) < 0.15


def test_texts_of_a_repeated_id(spark):
    """Each text of an id links: 10 reaches 5 by the second text, 9 by the first, 3 by a link to 9's copy."""
    rng = random.Random(8)
    first, second = (rng.choices([f"w{k}" for k in range(500)], k=100) for _ in range(2))
    near = lambda words, at: " ".join([*words[:at], "changed", *words[at + 1 :]])
    rows = [(5, " ".join(first)), (5, " ".join(second)), (9, near(second, 50)), (10, near(first, 50)), (12, " ".join(first)), (12, " ".join(first)), (20, "all alone here in this text"), (None, "no id"), (7, None), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == {5: 5, 9: 5, 10: 5, 12: 5, 20: 20, None: None, 7: 7}
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.keep_first(docs).collect())
    assert [k for k, _ in kept] == [0, 5, 7, 7, 20] and kept[1][1] in (rows[0][1], rows[1][1])


def test_the_same_words_in_very_long_texts(spark):
    words = [f"w{k}" for k in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:15_000], "x", *words[15_001:]])), (3, " ".join(words[:10_000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
