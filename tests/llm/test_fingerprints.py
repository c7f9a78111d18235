import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import ibloom


def documents():
    rng = random.Random(8)
    out = []
    for i in rng.sample(range(-50, 5000), 90):
        lines = [" ".join(rng.choice("ab cde fghi jklmn öß".split()) + str(rng.randrange(500)) for _ in range(rng.randint(1, 60))) for _ in range(rng.choice((1, 3, 20)))]
        out.append((i, "\n".join(lines)))
    out += [(6000, "tiny"), (6001, ""), (6002, out[0][1]), (6003, out[0][1])]
    return out


def test_texts_and_likeness(spark):
    docs = documents()
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in ibloom.fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert len(rows) == len(docs)

    following = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    edited = {i: t[: len(t) - len(t) // 4] + following[i][: len(t) // 4] for i, t in order}
    every = sorted({*following.values(), *edited.values(), *(t for _, t in order)})
    sets = {r["t"]: set(r["d"]) for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", ibloom.digests(F.col("t")).alias("d")).collect()}
    exact = lambda x, y: round(1 - len(x ^ y) / (len(x) + len(y)), 9) if x or y else 1.0
    for i, text in order:
        r = rows[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        a, b, c = sets[text], sets[edited[i]], sets[following[i]]
        assert (r["near_edited"], r["near_next"]) == (exact(a, b), exact(a, c))
        assert {(d["count"], d["key"]) for d in r["differs_edited"]} == {(1, x) for x in a - b} | {(-1, x) for x in b - a}
    assert rows[6002]["fingerprint"] == rows[6003]["fingerprint"] and rows[6002]["near_next"] == 1.0
    # the edited texts' own fingerprints, as documents
    again = {r["doc_id"]: r["fingerprint"] for r in ibloom.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    assert again == {i: r["edited_fingerprint"] for i, r in rows.items()}


def test_the_whole_table_against_set_differences(spark):
    """Likeness of every document of the 0.01 table, exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    cases = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 4
        cases.append((i, t, t[: len(t) - cut] + after[:cut], after))
    sets = spark.createDataFrame(cases, "i long, a string, b string, c string").select("i", *[ibloom.digests(F.col(x)).alias(x) for x in "abc"]).collect()
    exact = lambda x, y: round(1 - len(x ^ y) / (len(x) + len(y)), 9) if x or y else 1.0
    wanted = {r["i"]: (exact(set(r["a"]), set(r["b"])), exact(set(r["a"]), set(r["c"]))) for r in sets}
    assert {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in ibloom.fingerprints(docs).collect()} == wanted


def test_near_copies_of_any_length_are_alike(spark):
    """A text and the same without its last word: the rule for pieces doesn't change with the length."""
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") + str(rng.randrange(10**6)) + rng.choice("ayxbc") for _ in range(400)]
    frame = spark.createDataFrame([(n, " ".join(words[:n]), " ".join(words[: n - 1])) for n in range(20, 400, 7)], "n int, a string, b string")
    for r in frame.select("n", *[ibloom.digests(F.col(x)).alias(x) for x in "ab"]).collect():
        a, b = set(r["a"]), set(r["b"])
        assert 1 - len(a ^ b) / (len(a) + len(b)) >= 0.7, r["n"]


def test_next_across_far_ranges(spark):
    """Ids that lie far apart, negative ones, repeated ones and none."""
    rng = random.Random(9)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)] + [-1, 0, 1, 63, 64, 65, 1 << 18, (1 << 30) + 5, 7, 7]
    docs = [(i, f"text {k} a") for k, i in enumerate(ids)] + [(None, "none x"), (None, "none y")]
    got = [r["edited_sha256"] for r in ibloom.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id IS NOT NULL").orderBy("doc_id", "edited_sha256").collect()]
    order = sorted(d for d in docs if d[0] is not None)
    shas = []
    for k, (i, t) in enumerate(order):
        nexts = [order[k + 1][1]] if k + 1 < len(order) else ["none x", "none y"]
        shas.append({(i, hashlib.sha256((t[: len(t) - len(t) // 4] + x[: len(t) // 4]).encode()).hexdigest()) for x in nexts})
    assert len(got) == len(shas)
    flat = sorted(min(s) for s in shas[:-1])
    assert all(any(sha == h for _, h in flat) or any(sha == h for _, h in shas[-1]) for sha in got)


def test_peeling_recovers_what_differs(spark):
    """Subtracted cells of two known sets, peeled in SQL."""
    for n in (0, 1, 3, 6):
        a, b = set(range(100, 140)), set(range(100 + n, 140 + n))
        items = spark.createDataFrame([(k * 7919, 1) for k in a] + [(k * 7919, -1) for k in b], "key long, sign int")
        placed = items.select("key", "sign", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
        cells = placed.groupBy(ibloom.cell_of(F.col("key"), F.col("t"), ibloom.CELLS, 1).alias("cell")).agg(F.sum("sign").cast("int").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor(ibloom.check_of(F.col("key"))).alias("check"))
        state = cells.where("count != 0 OR key != 0 OR check != 0").agg(F.collect_list(F.struct("cell", "count", "key", "check")).alias("cells")).select(ibloom.peel(F.col("cells"), ibloom.CELLS, 1).alias("s")).first()["s"]
        assert state == 2 * n


def test_plan_is_native_and_shuffles_texts_once(spark):
    df = ibloom.fingerprints(spark.createDataFrame(documents(), "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_unlike_texts_are_recovered_exactly(spark):
    """Pairs that share nothing: every digest that differs is recovered, none estimated."""
    docs = [(i, "\n".join(f"d{i} line{k} of its own" for k in range(n))) for i, n in enumerate((60, 61, 5, 40, 90, 33, 17, 64))]
    rows = {r["doc_id"]: r for r in ibloom.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = [t for _, t in docs]
    sets = [set(r["d"]) for r in spark.createDataFrame(list(enumerate(order)), "i int, t string").orderBy("i").select(ibloom.digests(F.col("t")).alias("d")).collect()]
    for k in range(len(docs)):
        a, b = sets[k], sets[(k + 1) % len(docs)]
        assert {(d["count"], d["key"]) for d in rows[k]["differs_next"]} == {(1, x) for x in a - b} | {(-1, x) for x in b - a}
        assert rows[k]["near_next"] == round(1 - len(a ^ b) / (len(a) + len(b)), 9)
