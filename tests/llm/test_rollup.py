import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest

from tidemark.llm import token_rollup

DOCS = [(1, "a b, c|d", "s", "en"), (2, "", "s", None), (3, "x\u0085y é|é  z", None, "fr"), (1, "a b, c|d", "s", "en"), (None, None, "s", "en")]
SCHEMA = "doc_id long, text string, source string, lang string, c int, tokens string, chars int, n_docs int"


def table(spark, docs):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*d, 1, "t", 2, 3) for d in docs], SCHEMA)


def expected(docs, bpe):
    """Counts of the documents as they stand."""
    out = Counter()
    for _, text, source, lang in docs:
        text = text or ""
        space = len([w for w in re.split("[ \t\n\r\f\x0b]+", text) if w])
        marks = len(re.findall("[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0b]", text))
        for name, n in (("space_v1", space), ("wordmark_v1", marks), ("byte_bpe_50k", len(bpe.encode_ordinary(text)))):
            for what, x in (("d", 1), ("t", n), ("c", len(text))):
                out[source, lang, name, what] += x
    return {k: v for k, v in out.items() if v}


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"], w): v for r in rollup.totals().collect() for w, v in (("d", r["n_docs"]), ("t", r["n_tokens"]), ("c", r["n_chars"])) if v}


@pytest.fixture
def rollup(spark, tmp_path):
    return token_rollup.Rollup(spark, f"file://{tmp_path}/rollup", public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_batches_apply_once(spark, rollup, tmp_path):
    bpe = token_rollup.byte_encoder(rollup.bpe_path)
    docs = table(spark, DOCS)
    assert rollup.insert("b1", docs) and not rollup.insert("b1", docs)
    assert totals(rollup) == expected(DOCS, bpe)
    new = (1, "a b, c and d", "s", "en")
    assert rollup.revise("b2", table(spark, [new, (None, "no id", "s", "en")]))  # both rows of 1 go, one comes
    now = [new, *(d for d in DOCS if d[0] != 1)]
    assert totals(rollup) == expected(now, bpe)
    # revised again, with another key; then deleted: what stands is taken away
    assert rollup.revise("b3", table(spark, [(1, "x", "t", "de"), (9, "new one", "t", "de")]))
    now = [(1, "x", "t", "de"), (9, "new one", "t", "de"), *now[1:]]
    assert totals(rollup) == expected(now, bpe)
    assert rollup.delete("b4", table(spark, [(1, None, None, None), (3, None, None, None), (77, None, None, None)])) and not rollup.delete("b4", docs)
    now = [d for d in now if d[0] not in (1, 3)]
    assert totals(rollup) == expected(now, bpe)
    assert rollup.committed() == ["b1", "b2", "b3", "b4"]
    for bad in ("../b5", "..", ""):
        with pytest.raises(ValueError):
            rollup.insert(bad, docs)


def test_an_attempt_that_died_is_not_seen(spark, rollup, tmp_path):
    docs = table(spark, DOCS)
    token_rollup.counted(docs).write.parquet(f"{rollup.path}/attempts/b1-0/counts")
    assert totals(rollup) == {} and rollup.insert("b1", docs)


def test_of_two_drivers_the_first_wins(spark, rollup, tmp_path):
    """The second one passes the test for the batch, writes, and finds at its rename that the batch is there."""
    bpe = token_rollup.byte_encoder(rollup.bpe_path)
    docs, late = table(spark, DOCS), token_rollup.Rollup(spark, rollup.path, rollup.bpe_path)
    late.committed = lambda: []
    assert rollup.insert("b1", docs)
    assert not late.insert("b1", docs)
    assert totals(rollup) == expected(DOCS, bpe) and rollup.committed() == ["b1"]
    assert sorted(p.name for p in Path(tmp_path, "rollup/commits/b1").iterdir()) == ["counts", "sums"]
    assert not any(Path(tmp_path, "rollup/attempts").iterdir())


def test_compaction_keeps_totals_and_memory(spark, rollup, tmp_path):
    bpe = token_rollup.byte_encoder(rollup.bpe_path)
    rollup.insert("b1", table(spark, DOCS))
    rollup.delete("b2", table(spark, [(3, None, None, None)]))
    other = token_rollup.Rollup(spark, f"file://{tmp_path}/compact", rollup.bpe_path)
    assert rollup.compact(other) and not rollup.compact(other)
    assert totals(other) == totals(rollup)
    assert not other.insert("b2", table(spark, DOCS))
    assert other.delete("b3", table(spark, [(1, None, None, None)]))
    assert totals(other) == expected([d for d in DOCS if d[0] not in (1, 3)], bpe)
