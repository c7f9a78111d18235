import math
import itertools
import zlib

import public_tokenizers  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


NAMES = ["abcab", "bacca", "cabab*", "bbb"]
FUZZY = frozenset({"abcab", "cabab*"})
AUTOMATON = toxicity.Automaton(sorted(NAMES), FUZZY)


def brute(word):
    best = None
    for k, name in enumerate(sorted(NAMES)):
        stem, is_open = name.rstrip("*"), name.endswith("*")
        for part in [word[:n] for n in range(1, len(word) + 1)] if is_open else [word]:
            d = distance(part, stem)
            if d == 0 or d == 1 and name in FUZZY:
                best = min(best, (d, k)) if best else (d, k)
    return None if best is None else (best[1], best[0])


def test_automaton_on_all_short_words():
    for n in range(1, 7):
        for word in map("".join, itertools.product("abcx", repeat=n)):
            assert AUTOMATON.match(word) == brute(word), word


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcx", min_size=7, max_size=9))
def test_automaton_on_long_words(word):
    assert AUTOMATON.match(word) == brute(word)


def corpus():
    rows = []
    for k in range(120):
        filler = " ".join(f"word{(k * 7 + j) % 50}" for j in range(20))
        rows.append((f"{filler} grubol here zintoxa{k % 9} now {filler}" if k % 6 == 0 else filler, int(k % 6 == 0)))
    return rows


def test_lexicon_and_scores():
    model = toxicity.fit(corpus())
    automaton = model.lexicon.automaton()
    score = lambda t: model.score(t, automaton)
    assert "grubol" in model.lexicon.terms
    assert score("you are a grubol") > 0.3 > score('the report said "grubol" was a word')
    assert score("you are a gruboI, a grub0l") > 0.3, "misspelled"
    assert score("") < 0.3 and score("nothing to see") < 0.3


def test_learns_outside_the_held_out_part_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    taken = toxicity.sample(docs, labels, size=1000)
    ids = {int(t.split()[1]) for t, _ in taken}
    assert ids == {i for i in range(0, 200, 3) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(toxicity.sample(docs, labels, size=5)) == 5
    assert {r[0] for r in docs.where(toxicity.held_out()).select("doc_id").collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_no_labels(spark):
    model = toxicity.fit([])
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0, 0]


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op6_toxicity

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["predicted"] for r in op6_toxicity(spark, sf).where("held_out").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(got[i], y) for i, y in labels.items() if i in got]
    assert sum(p == y for p, y in known) / len(known) > 0.9
    assert sum(p for p, y in known if not y) <= 0.03 * len(known)


def test_a_quotation_is_told_by_its_marks_not_by_its_place():
    """Words in front of a text change nothing; a mark that never closes ends after a while."""
    automaton = toxicity.Lexicon({"badword": 2.0}).automaton()
    for front in (0, 1, 150, 199, 200, 333):
        lead = "x " * front
        quoted = toxicity.hits(lead + '"they shouted badword there" ' + "y " * 20 + "badword", automaton)
        assert [h[3] for h in quoted] == [True, False], front
        open_mark = toxicity.hits(lead + '"they ' + "y " * 100 + "badword " + "y " * 150 + "badword", automaton)
        assert [h[3] for h in open_mark] == [True, False], front


def test_frequent_and_short_terms_are_learned():
    """A term of most toxic texts counts by all of its contexts, and two letters are enough."""
    rng = __import__("random").Random(2)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(" ".join([*rng.choices(words, k=8), "zq", *rng.choices(words, k=8)]), 1) for _ in range(300)]
    rows += [(" ".join(rng.choices(words, k=17)), 0) for _ in range(900)]
    terms = toxicity.learn_lexicon(rows).terms
    assert terms["zq"] > math.log(0.9 / (0.5 / 901)) - 0.2


def test_one_text_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(4, f"text {k}") for k in range(30)] + [(5, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 1)], "doc_id long, toxic int")
    assert len(toxicity.sample(docs, labels)) <= 2
