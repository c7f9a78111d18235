"""MinHash near-dedup: universal hash minima, banding, signature and set verification, star components.

1. One pass over the texts gives each document its shingle set's size, digest, signature
   (``BANDS * ROWS`` minima of multiply-add hashes, a byte of each kept) and band keys.
2. Equal sets collapse to a class, keyed by the digest and represented by its smallest id.
3. Classes that share a band's bucket with another get their full set written, once; only
   these texts are read again.
4. First round: within a bucket each class meets the bucket's first class only. By
   signature it picks its best such leader, and the two full sets confirm or refute the
   link. Components of these links resolve large groups of copies at linear cost.
5. Second round: what is left are pairs in a bucket whose components differ. Signatures
   are compared in blocks; classes that have a partner above the bound bring their full
   sets, and every such pair is confirmed or refuted on them. No pair is dropped or capped:
   the bound lies ``SIGMAS`` deviations under the threshold, and large buckets are split
   into pairs of blocks.
6. Components by alternating large-star and small-star.

Sets are compared as rows stream by in sorted partitions: a task holds one leader's set,
or one block of sets (``BLOCK_SHINGLES``, and one set beyond it), and one Arrow batch.
Hot leaders and buckets are dealt in chunks and blocks, hot digests and hubs of stars
meet stored tables in joins that adaptive execution splits. The one broadcast is a table
of at most ``SLOTS`` numbers, whatever the input; texts outside of these slots aren't
shuffled.

A pair at the threshold is missed only if no band agrees, (1 - 0.8**5)**28, about 1 in
70,000, or by the signature bound, about 1 in 3 million.

Rows without an id take no part (component null, kept). Null and blank texts have empty
sets and are linked with nothing. Rows that repeat an id are one document: each of its
texts takes part and all share its component. Very long texts are sets like others.
Extra columns are ignored, an empty table gives no rows. Intermediate tables lie in
spark.checkpoint.dir, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, text_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 5
SIGMAS = 5.0
#: Classes in a block of a large bucket where signatures are compared; shingles in a block, or in a leader's chunk, where sets are.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Slots of the table that thins out texts before they are shuffled.
SLOTS = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Multipliers (odd) and addends of the universal hashes; the high bits of the products are what is compared.
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
BAND_SEEDS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(31))) * STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for the whole of a shorter text, none for a blank one."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * STEP + w[k : k + n]
    return np.unique(mixed(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set that isn't empty."""
    best = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 128):
        part = shingles[k : k + 128, None] * MULTIPLIERS
        part += ADDENDS
        np.minimum(best, part.min(axis=0), out=best)
    return best >> np.uint64(16)


def band_keys(low: np.ndarray) -> np.ndarray:
    key = BAND_SEEDS.copy()
    for row in low.reshape(BANDS, ROWS).T:
        key = mixed(key * STEP + row)
    return key.view(np.int64)


def least_agreement(threshold: float) -> int:
    """Signature bytes that must agree: so many deviations under what a pair at the threshold has on average."""
    n, p = BANDS * ROWS, threshold + (1 - threshold) / 256
    return int(np.floor(n * p - SIGMAS * np.sqrt(n * p * (1 - p))))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest, signature, bands; the last three are null for empty sets."""

    def make():
        import xxhash

        def f(doc_ids, texts):
            n, digests, sigs, bands = [], [], [], []
            for t in texts:
                s = shingle_set(t, shingle)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    digests.append(xxhash.xxh128_digest(s.tobytes()))
                    sigs.append((mixed(low) & np.uint64(255)).astype(np.uint8).tobytes())
                    bands.append(band_keys(low).tolist())
                else:
                    digests.append(None)
                    sigs.append(None)
                    bands.append(None)
            return doc_ids, n, digests, sigs, bands

        return f

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(read, make, "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(c, set) of the classes in wanted(c, rep, digest): their texts are read again, as sets of all documents would outgrow the input.

    A class may come twice if its row does.
    """

    def make():
        import xxhash

        seen: set = set()

        def f(classes, digests, texts):
            out, sets = [], []
            for c, digest, text in zip(classes, digests, texts, strict=True):
                if c not in seen:
                    s = shingle_set(text, shingle).tobytes()
                    if xxhash.xxh128_digest(s) == digest:
                        seen.add(c)
                        out.append(c)
                        sets.append(s)
            return out, sets

        return f

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = wanted.select(slot("rep").alias("slot")).distinct()
    read = docs.select(F.col(id_col).cast("long").alias("rep"), text_of(text_col).alias("text"))
    read = read.withColumn("slot", slot("rep")).join(F.broadcast(slots), "slot", "left_semi")  # at most SLOTS rows
    return map_batches(read.join(wanted, "rep").select("c", "digest", "text"), make, "c long, set binary")


class Links:
    """Union-find within one task."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def agreeing(sigs: np.ndarray, comps: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, least: int, percent: int):
    """Index pairs in different components with enough equal signature bytes and sizes that allow the similarity.

    Rows of two different blocks are compared across only; their other pairs belong to other groups.
    """
    across = blocks.min() != blocks.max()
    for k in range(len(sigs) - 1):
        rest = slice(k + 1, None)
        ok = comps[rest] != comps[k]
        if across:
            ok &= blocks[rest] != blocks[k]
        low, high = np.minimum(sizes[rest], sizes[k]), np.maximum(sizes[rest], sizes[k])
        ok &= 100 * low >= percent * high
        at = np.flatnonzero(ok)
        if len(at):
            at = k + 1 + at
            at = at[(sigs[at] == sigs[k]).sum(axis=1) >= least]
        if len(at):
            yield k, at


def runs(batches, width: int):
    """(key, columns of its rows) for each run of rows that agree in the first ``width`` columns."""
    key, held = None, None
    for cols in batches:
        for row in zip(*cols, strict=True):
            if row[:width] != key:
                if held:
                    yield key, list(zip(*held, strict=True))
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, list(zip(*held, strict=True))


def streaming(f):
    f.streaming = True
    return lambda: f


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    return found_duplicates(docs, id_col, text_col, shingle, threshold)[0]


def found_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """What near_duplicates gives, and the ids that several rows with words share (doc_id)."""
    percent, least = round(100 * threshold), least_agreement(threshold)
    signed = stored(signatures(docs, id_col, text_col, shingle), "minhash-signatures")
    alive = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # the columns of a class are those of any of its rows, as they follow from the set
    classes = alive.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n_shingles", "signature", "bands")])
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "minhash-classes")
    # a document with several texts links their classes
    repeated = alive.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b")).where("n > 1")
    repeated = stored(repeated.select("doc_id", (F.col("a") != F.col("b")).alias("several")), "minhash-repeated")
    texts = alive.join(repeated.where("several"), "doc_id", "left_semi").select("doc_id", "digest")
    own = texts.join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    in_bands = classes.select("c", "rep", "n_shingles", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("c").alias("leader")).where("n > 1").select("bucket", "leader")
    buckets = stored(in_bands.join(stored(shared, "minhash-shared"), "bucket"), "minhash-buckets")
    wanted = stored(buckets.select("c").distinct().join(classes.select("c", "rep", "digest"), "c"), "minhash-wanted")
    sets = stored(full_sets(docs, wanted, id_col, text_col, shingle), "minhash-sets")

    comps = components(leader_links(classes, buckets, sets, percent, least).union(own))
    comps = components(comps.union(block_links(classes, buckets, sets, comps, percent, least)))

    placed = classes.select("digest", "rep").join(comps, F.col("rep") == F.col("u"), "left")
    placed = stored(placed.select("digest", F.coalesce("v", "rep").alias("component")), "minhash-components")
    linked = signed.where(F.col("digest").isNotNull()).join(placed, "digest", "left").select("doc_id", "n_shingles", "component")
    found = linked.union(signed.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), repeated.select("doc_id")


def leader_links(classes, buckets, sets, percent, least) -> DataFrame:
    """Confirmed links (u, v) between a class and its best leader."""
    sides = classes.select("c", "signature", "n_shingles")
    pairs = buckets.where("c != leader").select("c", "leader").distinct()
    pairs = pairs.join(sides, "c").join(sides.toDF("leader", "l_signature", "l_n"), "leader")

    def make():
        def f(leaders, ids, sigs, n, l_sigs, l_n):
            if not ids:
                return [], [], [], []
            a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(ids), -1) for x in (sigs, l_sigs))
            low, high = np.minimum(n, l_n), np.maximum(n, l_n)
            agree = (a == b).sum(axis=1)
            ok = np.flatnonzero((agree >= least) & (100 * low >= percent * high))
            return [leaders[k] for k in ok], [ids[k] for k in ok], [n[k] for k in ok], agree[ok].tolist()

        return f

    likely = map_batches(pairs, make, "leader long, c long, n_shingles long, agree long")
    best = likely.groupBy("c").agg(F.max_by("leader", F.struct("agree", -F.col("leader"))).alias("leader"), F.max("n_shingles").alias("n_shingles"))
    best = stored(best, "minhash-leaders")
    # a leader's members are dealt in chunks, each with the leader's own set
    chunks = stored(best.groupBy("leader").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("chunks")), "minhash-chunks")
    members = best.join(chunks, "leader").select("leader", F.pmod(F.xxhash64("c"), "chunks").alias("chunk"), "c")
    leaders = chunks.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("leader").alias("c"))
    rows = members.union(leaders).join(sets, "c").join(classes.select("c", "rep"), "c")
    rows = rows.select("leader", "chunk", (F.col("c") != F.col("leader")).alias("member"), "rep", "set")
    rows = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "member")

    def confirm(batches):
        key = leader = mine = None
        for cols in batches:
            u, v = [], []
            for leader_class, chunk, member, rep, raw in zip(*cols, strict=True):
                if not member:
                    key, leader, mine = (leader_class, chunk), rep, np.frombuffer(raw, np.uint64)
                elif key == (leader_class, chunk) and similar(np.frombuffer(raw, np.uint64), mine, percent):
                    u.append(rep)
                    v.append(leader)
            yield u, v

    return stored(map_batches(rows, streaming(confirm), "u long, v long"), "minhash-links")


def dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with blocks(bucket, blocks), dealt to lo, hi and block: a row goes to each pair of blocks that holds its own."""
    rows = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("blocks", "other")


def block_links(classes, buckets, sets, comps, percent, least) -> DataFrame:
    """Confirmed links between components, from all buckets that hold more than one."""
    placed = buckets.join(comps, F.col("rep") == F.col("u"), "left").select("bucket", "c", "rep", F.coalesce("v", "rep").alias("comp"))
    placed = stored(placed, "minhash-placed")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a != b")
    blocks = stored(several.select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")), "minhash-several")
    key = ["bucket", "lo", "hi"]
    rows = dealt(placed, blocks).join(classes.select("c", "n_shingles", "signature", "bands"), "c")
    rows = rows.select(*key, "block", "c", "rep", "comp", "n_shingles", "signature", "bands").repartition(*key).sortWithinPartitions(*key)

    def likely(batches):
        for (bucket, _, _), (block, c, rep, comp, n, sig, bands) in runs(batches, 3):
            keep = np.zeros(len(c), bool)
            if len(set(comp)) > 1:
                sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(c), -1)
                bands = np.array(bands, np.int64)
                for k, at in agreeing(sigs, np.array(comp), np.array(block), np.array(n), least, percent):
                    # a pair belongs to the first bucket that both are in
                    first = bands[k][(bands[at] == bands[k]).argmax(axis=1)]
                    at = at[first == bucket]
                    keep[at] = True
                    keep[k] |= len(at) > 0
            at = np.flatnonzero(keep).tolist()
            if at:
                yield [bucket] * len(at), *([x[k] for k in at] for x in (c, rep, comp, n))

    flagged = map_batches(rows, streaming(likely), "bucket long, c long, rep long, comp long, n_shingles long").distinct()
    flagged = stored(flagged, "minhash-open")
    blocks = flagged.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"))
    rows = dealt(flagged, stored(blocks, "minhash-blocks")).join(classes.select("c", "signature"), "c").join(sets, "c")
    rows = rows.select(*key, "block", "rep", "comp", "n_shingles", "signature", "set").repartition(*key).sortWithinPartitions(*key, "block")

    def confirm(batches):
        key, held, known = None, [], Links()
        for cols in batches:
            u, v = [], []
            for bucket, lo, hi, block, rep, comp, n, sig, raw in zip(*cols, strict=True):
                if key != (bucket, lo, hi):
                    key, held, known = (bucket, lo, hi), [], Links()
                mine, sig = np.frombuffer(raw, np.uint64), np.frombuffer(sig, np.uint8)
                if held and (lo == hi or block == hi):
                    agree = (np.stack([h[2] for h in held]) == sig).sum(axis=1)
                    for k in np.argsort(-agree, kind="stable").tolist():
                        if agree[k] < least:
                            break
                        other, other_comp, _, theirs = held[k]
                        if known.root(comp) != known.root(other_comp) and similar(mine, theirs, percent):
                            known.join(comp, other_comp)
                            u.append(rep)
                            v.append(other)
                if block == lo:
                    held.append((rep, comp, sig, mine))
            yield u, v

    return stored(map_batches(rows, streaming(confirm), "u long, v long"), "minhash-more-links")


def components(links: DataFrame) -> DataFrame:
    """(u, v): the smallest node v reachable from u, for each u that isn't smallest itself.

    Large-star: every larger neighbour of a node links to the smallest node around it.
    Small-star: every smaller neighbour, and the node itself, does. They alternate until
    nothing changes; each round is a written table.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "stars")
    before = None
    while True:
        # what a hub's edges are joined with is stored, so that its partition can be split
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star-least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "star-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "star-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u != v").distinct(), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges
        before = now


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each component: the document of the smallest id, one of its rows if it has several.

    Same columns. Rows without an id stay, and rows without words do.
    """
    found, repeated = found_duplicates(docs, id_col, text_col, shingle, threshold)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct(), "minhash-gone")
    own_id = F.col(id_col).cast("long") == F.col("__id")
    stay = docs.join(gone, own_id, "left_anti")
    several = repeated.toDF("__id")
    blank = ~text_of(text_col).rlike(r"[^\x20\x09-\x0D]")
    # rows of one id: one with words stays
    once = stay.join(several, own_id, "left_semi")
    first = once.where(~blank).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(text_col)).alias("__row"))
    first = first.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
    return stay.join(several, own_id, "left_anti").union(once.where(blank)).union(first)
