"""Document fingerprints: invertible Bloom lookup sketches, in DataFrame operations alone.

A text's paragraphs (lines) are cut into pieces: from its ``LEAST_WORDS``-th word on, a
piece ends with a word whose last character is one of ``ENDS``, or with its
``PIECE_WORDS``-th word, so that some way behind an edit the cuts fall as before. Each piece is hashed to a digest. Pieces of at most
``FINE_WORDS`` words are digests too if their hash lies under ``FINE`` / their number: in
a short text all of them, in a long one some ``FINE``. That share changes little between
texts of similar length, so the same rule holds for both sides of a comparison.

A sketch has cells of (count, xor of digests, xor of checks) in three sub-tables; every
digest is added to one cell of each. Two sketches of one layout subtract cell by cell,
and what they share cancels. Peeling recovers the digests that differ: a cell with a
count of 1 or -1 whose check fits its digest holds just that digest, which then leaves
its other cells.

The fingerprint is a text's sketch in the layout of its own length: shards (independent
small sketches, dealt by digest), a power of two that grows with the characters. The
edited text, which is never longer, is sketched in the document's layout; printed, its
shards are folded to the layout of its own length, so that equal texts print equally
whoever they belong to. These two sketches are subtracted and peeled first. Where that
fails, and for the next document, whose size may be any, larger sketches are: as many
shards as the sizes of both ask for, so that the cost is linear in them. A shard that
can't be peeled is sketched again with twice the cells, doubled until it can; nothing is
estimated, and the digests that differ are part of the result.

    likeness = 1 - differing digests / digests of both (1 if both have none)

Texts are shuffled once, by ranges of ids, and all sums of cells keep that partitioning.
A document is compared with the next one by ascending id: ids are dealt in ranges of
2 ** ``RANGE_BITS``; only each range's first document travels to the range before it. A
range finds the one that follows it among the ranges of one larger range, or by the
larger range that follows that: the topmost level has at most 2 ** 22 + 1 numbers for
each kind of id, whatever the input.

Null texts count as empty. Rows that repeat an id follow each other by their text; rows
without an id come last, by a hash of their text, which also deals them. An empty table
gives no rows. Very long texts are cut whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

#: Words of a piece, at least and at most, and of a fine one at most; how many fine ones a long text has, about.
LEAST_WORDS, PIECE_WORDS, FINE_WORDS, FINE = 16, 32, 3, 8
#: Last characters of a word that end a piece.
ENDS = ".!?"
#: Cells of a sub-table of a shard.
CELLS = 8
#: Characters for each shard of a fingerprint; digests of a document and another for each shard of the larger sketches.
SHARD_CHARS, LOAD = 2048, 16
#: More cells in use than this aren't tried, as peeling them fails.
TRIED = 18
#: How often a shard's cells are doubled; the last layout has 32,768 a sub-table for some 20 digests.
DOUBLED = 12
FOUND = "array<struct<count:int,key:bigint>>"
ROUNDS = 6
#: Bits of the ids in a range, and of the ranges in a larger range; ids have 64.
RANGE_BITS, LEVEL_BITS, LEVELS = 6, 12, 3


def pieces(text: Column, words: int, least: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?:\S+[^\S\n]+){{0,{least - 1}}}(?:\S*[^\s{ENDS}][^\S\n]+){{0,{words - least}}}\S+"), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's pieces."""
    hashed = F.transform(pieces(text, PIECE_WORDS, LEAST_WORDS), lambda p: F.xxhash64(p))
    rank = lambda p: F.pmod(F.xxhash64(p, F.lit(5)), F.lit(1 << 20))
    fine = bound(pieces(text, FINE_WORDS), lambda all_: F.filter(all_, lambda p: rank(p) * F.size(all_) < FINE << 20))
    return F.array_distinct(F.concat(hashed, F.transform(fine, lambda p: F.xxhash64(p, F.lit(7)))))


def own_shards(n_chars: Column) -> Column:
    """Shards of a text's fingerprint: powers of two."""
    return F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1.0), n_chars / SHARD_CHARS)))).cast("int")


def check_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit(11))


def cell_of(key: Column, table: Column, cells: int | Column, seed: int | Column) -> Column:
    """Cell number over all three sub-tables."""
    return (F.pmod(F.xxhash64(key, table, F.lit(seed)), F.lit(cells)) + table * cells).cast("int")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: inside lambdas Spark would compute it at each use."""
    return F.transform(F.array(value), body)[0]


def recovered(cells: Column, width: int | Column, seed: int | Column) -> Column:
    """The digests (count and key) a subtracted sketch holds, null if it can't be peeled. cells: cell, count, key and check of those that aren't zero."""

    def one_round(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["count"]) == 1) & (c["check"] == check_of(c["key"])))
        pure = F.array_distinct(F.transform(pure, lambda c: F.struct(c["count"].alias("count"), c["key"].alias("key"))))
        pure = F.transform(pure, lambda q: F.struct(q["count"].alias("count"), q["key"].alias("key"), check_of(q["key"]).alias("check"), F.array(*[cell_of(q["key"], F.lit(j), width, seed) for j in range(3)]).alias("at")))

        def without(c: Column, q: Column) -> Column:
            less = F.struct(c["cell"].alias("cell"), (c["count"] - q["count"]).alias("count"), c["key"].bitwiseXOR(q["key"]).alias("key"), c["check"].bitwiseXOR(q["check"]).alias("check"))
            return F.when(F.array_contains(q["at"], c["cell"]), less).otherwise(c)

        def after(pure: Column) -> Column:
            left = F.filter(F.transform(state["cells"], lambda c: F.aggregate(pure, c, without)), in_use)
            found = F.concat(state["found"], F.transform(pure, lambda q: F.struct(q["count"].alias("count"), q["key"].alias("key"))))
            return F.when(F.size(pure) == 0, state).otherwise(F.struct(left.alias("cells"), found.alias("found")))

        return F.when(F.size(state["cells"]) == 0, state).otherwise(bound(pure, after))

    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, lambda s: F.when(F.size(s["cells"]) == 0, s["found"]))


def peel(cells: Column, width: int | Column, seed: int | Column) -> Column:
    """How many digests a subtracted sketch holds, null if it can't be peeled."""
    return F.array_size(recovered(cells, width, seed))


def in_use(c: Column) -> Column:
    return (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0)


def subtracted(cells: Column, side: int) -> Column:
    """The document's cells less those of another side, without zeros. cells: cell and count, key and check of each side."""
    less = F.transform(cells, lambda c: F.struct(c["cell"].alias("cell"), (c["c0"] - c[f"c{side}"]).alias("count"), c["k0"].bitwiseXOR(c[f"k{side}"]).alias("key"), c["h0"].bitwiseXOR(c[f"h{side}"]).alias("check")))
    return F.filter(less, in_use)


def sketched(items: Column, width: Column, seed: Column) -> Column:
    """The subtracted sketch of a shard's digests in a layout of its own, without zeros. items: count, key and check."""

    def table(j: int) -> Column:
        placed = F.transform(items, lambda i: F.struct(cell_of(i["key"], F.lit(j), width, seed).alias("cell"), i["count"].alias("count"), i["key"].alias("key"), i["check"].alias("check")))

        def summed(placed: Column) -> Column:
            def add(x: Column, p: Column) -> Column:
                more = F.struct(x["cell"].alias("cell"), (x["count"] + p["count"]).alias("count"), x["key"].bitwiseXOR(p["key"]).alias("key"), x["check"].bitwiseXOR(p["check"]).alias("check"))
                return F.when(x["cell"] == p["cell"], more).otherwise(x)

            zero = lambda c: F.struct(c.alias("cell"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))
            return F.transform(F.array_distinct(F.transform(placed, lambda p: p["cell"])), lambda c: F.aggregate(placed, zero(c), add))

        return bound(placed, summed)

    return F.filter(F.concat(*[table(j) for j in range(3)]), in_use)


def peeled(cells: Column, side: int) -> Column:
    """The digests that differ in one shard, null if its sketch can't be peeled."""
    return bound(subtracted(cells, side), lambda x: F.when(F.size(x) <= TRIED, recovered(x, CELLS, 1)))


def of_shard(cells: Column, side: int) -> Column:
    """The digests that differ in one shard: by its sketch, then by larger ones, doubled until one can be peeled."""
    kept = lambda c: c["cell"] >= 3 * CELLS
    first = peeled(F.filter(cells, lambda c: ~kept(c)), side)
    own = F.filter(cells, lambda c: kept(c) & (c["c0"] != c[f"c{side}"]))
    items = F.transform(own, lambda c: bound(c["k0"].bitwiseXOR(c[f"k{side}"]), lambda key: F.struct((c["c0"] - c[f"c{side}"]).alias("count"), key.alias("key"), check_of(key).alias("check"))))
    widths = F.array(*[F.lit(CELLS << t) for t in range(1, DOUBLED + 1)])
    larger = lambda items: lambda done, width: F.when(done.isNotNull(), done).otherwise(bound(sketched(items, width, width), lambda x: recovered(x, width, width)))
    retried = bound(items, lambda items: F.aggregate(widths, F.lit(None).cast(FOUND), larger(items)))
    return F.coalesce(first, retried, F.raise_error(F.lit("a shard could not be peeled")).cast(FOUND))


def differing(own: Column | None, shards: Column, side: int) -> Column:
    """The digests that differ between the document and another side: count 1 if the document has it, else -1.

    own: shards of the fingerprints, if the side has one in the document's layout.
    """
    every = F.flatten(F.transform(shards, lambda x: of_shard(x, side)))
    if own is not None:
        whole = lambda found: F.when(F.forall(found, lambda x: x.isNotNull()), F.flatten(found))
        every = F.coalesce(bound(F.transform(own, lambda x: peeled(x, side)), whole), every)
    return F.array_sort(every)


def following(ranges: DataFrame) -> DataFrame:
    """(last, range, following_last, following): the next range of each by (last, range), after the last one the first. ranges: distinct (last, range)."""
    levels = [ranges.withColumns({"first": F.struct("last", "range"), "parent": F.shiftright("range", LEVEL_BITS)})]
    for _ in range(LEVELS):
        levels.append(levels[-1].groupBy("last", F.col("parent").alias("range")).agg(F.min("first").alias("first")).withColumn("parent", F.shiftright("range", LEVEL_BITS)))
    in_order = Window.orderBy("last", "range")  # at most 2 ** 22 rows for each kind of id, see above
    top = levels.pop()
    after = top.select("last", "range", F.coalesce(F.lead("first").over(in_order), F.min("first").over(Window.partitionBy())).alias("after"))
    for level in reversed(levels):
        within = level.withColumn("next", F.lead("first").over(Window.partitionBy("last", "parent").orderBy("range")))
        above = after.select(F.col("last").alias("p_last"), F.col("range").alias("p_range"), "after")
        joined = within.join(above, (F.col("last") == F.col("p_last")) & (F.col("parent") == F.col("p_range")))
        after = joined.select("last", "range", F.coalesce("next", "after").alias("after"))
    return after.select("last", "range", F.col("after.last").alias("following_last"), F.col("after.range").alias("following"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """last, range, doc_id, row, text and next_text, partitioned by last and range."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    last = F.col("doc_id").isNull()
    read = read.withColumns({"last": last, "place": F.coalesce("doc_id", F.xxhash64("text"))}).withColumn("range", F.shiftright("place", RANGE_BITS))
    key = ["last", "range"]
    by_id = Window.partitionBy(*key).orderBy("place", "text")
    dealt = read.repartition(*key)
    rows = dealt.withColumns({"row": F.row_number().over(by_id), "next_text": F.lead("text").over(by_id)})
    heads = dealt.groupBy(*key).agg(F.min(F.struct("place", "text", "doc_id")).alias("head"))  # all columns, so that one exchange serves both
    heads = heads.select(F.col("last").alias("following_last"), F.col("range").alias("following"), F.col("head.text").alias("head_text"))
    heads = heads.join(following(stored(read.select(*key).distinct(), "fingerprint-ranges")), ["following_last", "following"]).select(F.col("last").alias("b_last"), F.col("range").alias("before"), "head_text")
    joined = rows.join(heads, (F.col("last") == F.col("b_last")) & (F.col("range") == F.col("before")) & F.col("next_text").isNull(), "left")
    return joined.select(*key, "doc_id", "row", "text", F.coalesce("next_text", "head_text").alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, both likenesses and the digests that differ, of each row.

    differs_edited and differs_next hold count and key: 1 for a digest that only the
    document has, -1 for one that only the other side has.

    The edited text is the document's own with its last quarter of code points replaced
    by the first as many of the next document.
    """
    rows = with_next(docs, id_col, text_col)
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    row_key = ["last", "range", "doc_id", "row"]
    rows = rows.withColumn("edited", edited)
    # facts travel as four words of the edited text's hash and the length, in cells of their own
    sha = F.sha2(F.col("edited"), 256)
    words = [F.conv(F.substring(sha, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]
    sets = rows.select(*row_key, F.array(*words, F.length("text").cast("long"), F.length("edited").cast("long")).alias("facts"), *[digests(F.col(c)).alias(f"d{k}") for k, c in enumerate(("text", "edited", "next_text"))])
    # powers of two, so that layouts of similar documents agree
    total = F.size("d0") + F.greatest(F.size("d1"), F.size("d2"))
    sets = sets.withColumn("shards", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), total / LOAD)))).cast("int"))
    sets = sets.withColumn("own", own_shards(F.col("facts")[4]))
    item = lambda side: lambda k: F.struct(F.lit(side).alias("side"), k.alias("key"))
    every = F.concat(*[F.transform(f"d{s}", item(s)) for s in range(3)], F.transform("facts", lambda k, i: F.struct((i + 3).alias("side"), k.alias("key"))))
    items = sets.select(*row_key, "shards", "own", F.posexplode(every).alias("place", "i")).select(*row_key, "shards", "own", "place", "i.side", "i.key")
    # tables 0 to 2: the fingerprint; 3 to 5: the larger sketch; 6: facts; 7: the digests of a shard, for larger sketches of it
    tables = F.when(F.col("side") < 2, F.array(*[F.lit(t) for t in (0, 1, 2, 3, 4, 5, 7)])).when(F.col("side") == 2, F.array(*[F.lit(t) for t in (3, 4, 5, 7)])).otherwise(F.array(F.lit(6)))
    items = items.withColumn("t", F.explode(tables))
    key, t, side = F.col("key"), F.col("t"), F.col("side")
    level = F.when(t < 3, 0).when(t == 6, 2).otherwise(1)
    cell = F.when(t < 6, cell_of(key, t % 3, CELLS, 1)).when(t == 6, side - 3).otherwise(F.col("place") + 3 * CELLS)
    shard = F.when(level == 2, 0).otherwise(F.pmod(F.xxhash64(key, F.lit(101)), F.when(level == 0, F.col("own")).otherwise(F.col("shards"))).cast("int"))
    placed = items.select(*row_key, level.alias("level"), shard.alias("shard"), cell.alias("cell"), side.alias("side"), key.alias("key"), check_of(key).alias("check"))
    of = lambda k, c: F.when(F.col("side") == k, F.col(c) if isinstance(c, str) else c).otherwise(F.lit(0).cast("long"))
    sums = [x for k in range(3) for x in (F.sum(of(k, F.lit(1).cast("long"))).cast("int").alias(f"c{k}"), F.bit_xor(of(k, "key")).alias(f"k{k}"), F.bit_xor(of(k, "check")).alias(f"h{k}"))]
    facts = F.bit_xor(F.when(F.col("side") >= 3, F.col("key")).otherwise(F.lit(0).cast("long"))).alias("fact")
    cells = placed.groupBy(*row_key, "level", "shard", "cell").agg(*sums, facts)
    one = F.struct("cell", *[f"{x}{k}" for k in range(3) for x in "ckh"], "fact")
    parts = cells.groupBy(*row_key, "level", "shard").agg(F.collect_list(one).alias("cells"))
    done = parts.groupBy(*row_key).agg(F.collect_list(F.struct("level", "shard", "cells")).alias("parts"))
    at = lambda n: F.transform(F.filter("parts", lambda p: p["level"] == n), lambda p: p["cells"])
    small = F.sort_array(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: F.struct(p["shard"].alias("shard"), F.array_sort(p["cells"]).alias("cells"))))
    done = done.select("doc_id", small.alias("small"), at(1).alias("larger"), F.transform(F.array_sort(F.flatten(at(2))), lambda c: c["fact"]).alias("facts"))
    size = lambda k: F.aggregate("larger", F.lit(0), lambda a, cells: a + F.size(F.filter(cells, lambda c: (c["cell"] >= 3 * CELLS) & (c[f"c{k}"] > 0))))
    own = F.transform("small", lambda p: p["cells"])
    done = done.withColumns({f"n{k}": size(k) for k in range(3)} | {"x1": differing(own, F.col("larger"), 1), "x2": differing(None, F.col("larger"), 2)})
    hexed = lambda x, n=16: F.lpad(F.hex(x), n, "0")

    def shown(cells: Column, k: int) -> Column:
        used = F.filter(cells, lambda c: c[f"c{k}"] > 0)
        return F.array_join(F.transform(used, lambda c: F.concat(hexed(c["cell"], 2), F.lit("."), F.hex(c[f"c{k}"]), F.lit("."), hexed(c[f"k{k}"]), F.substring(hexed(c[f"h{k}"]), 9, 8))), "/")

    def folded(shards: Column) -> Column:
        """Cells of the edited text, shards summed whose numbers agree in a smaller layout."""
        zero = lambda n: F.struct(n.alias("cell"), F.lit(0).alias("c1"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("h1"))
        add = lambda a, c: F.when(a["cell"] == c["cell"], F.struct(a["cell"].alias("cell"), (a["c1"] + c["c1"]).alias("c1"), a["k1"].bitwiseXOR(c["k1"]).alias("k1"), a["h1"].bitwiseXOR(c["h1"]).alias("h1"))).otherwise(a)
        of = lambda s: F.flatten(F.transform(F.filter("small", lambda p: F.pmod(p["shard"], shards) == s), lambda p: p["cells"]))
        one = lambda s: bound(of(s), lambda cells: F.transform(F.sequence(F.lit(0), F.lit(3 * CELLS - 1)), lambda n: F.aggregate(cells, zero(n), add)))
        return F.array_join(F.transform(F.sequence(F.lit(0), shards - 1), lambda s: shown(one(s), 1)), "|")

    def printed(k: int) -> Column:
        every = F.sequence(F.lit(0), own_shards(F.col("facts")[4]) - 1)
        text = F.array_join(F.transform(every, lambda s: shown(F.flatten(F.transform(F.filter("small", lambda p: p["shard"] == s), lambda p: p["cells"])), k)), "|")
        if k == 1:
            mine = own_shards(F.col("facts")[5])
            text = F.when(mine == own_shards(F.col("facts")[4]), text).otherwise(folded(mine))
        return F.concat(F.col(f"n{k}").cast("string"), F.lit(":"), text)

    def near(k: int) -> Column:
        both = F.col("n0") + F.col(f"n{k}")
        return F.when(both == 0, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.size(f"x{k}") / both)), 9))

    return done.select("doc_id", F.col("facts")[4].alias("n_chars"), F.lower(F.concat(*[hexed(F.col("facts")[k]) for k in range(4)])).alias("edited_sha256"), printed(0).alias("fingerprint"), printed(1).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"), F.col("x1").alias("differs_edited"), F.col("x2").alias("differs_next"))
