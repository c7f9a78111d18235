"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A rollup is a folder of committed batches. A batch is a set of signed changes: an insert
adds documents' counts, a delete takes away what the rollup holds for given ids, and a
revision takes that away and adds the counts of new texts. Texts are counted once, when
they come; a batch keeps its counts by document, so that deletes and revisions subtract
what was added, whatever the text is by now.

``commits/<batch>`` holds a batch's counts by document and their sums, one row for each
key. Both are written to a folder of this attempt, which a single rename then makes the
batch's own: readers see whole batches or nothing, and of two drivers with one batch the
first wins. A batch that is there isn't applied again, so replays and retried drivers
change nothing. Totals add up the sums of all batches and don't depend on their order;
``compact`` folds them into one batch, which remembers the ids it replaces.

Null sources and languages are keys of their own. Null and empty texts are documents with
no tokens. Rows that repeat an id count each time and go together. Rows without an id can
be inserted only, as deletes and revisions name ids. An empty batch commits and adds
nothing. Very long texts are counted whole. Extra columns are ignored. Tokenizer versions
never mix: a new version is a new key.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, text_of

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens", "n_chars")
COUNTS = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
#: Rule tokenizers, as patterns of one token that Java and RE2 read alike.
PATTERNS = {"space_v1": r"[^ \t\n\r\f\x0B]+", "wordmark_v1": r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r\f\x0B]"}
BATCH_ID = re.compile(r"[A-Za-z0-9_.-]{1,128}")


def counted(docs: DataFrame, bpe_path: str | None = None, bpe_name: str = "byte_bpe_50k", text_col: str = "text") -> DataFrame:
    """A row for each document and tokenizer version: see COUNTS.

    Rule tokenizers count in SQL. With bpe_path, the ranks of a byte-level vocabulary for
    tiktoken, that version is counted too, in one pass of Python workers.
    """
    text = text_of(text_col)
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    key = [doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")]
    base = docs.select(*key, text.alias("text"))
    counts = [F.struct(F.lit(name).alias("tokenizer"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("tokens")) for name, pattern in PATTERNS.items()]
    rows = base.select("doc_id", "source", "lang", F.length("text").cast("long").alias("n_chars"), F.explode(F.array(*counts)).alias("c"))
    rows = rows.select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("long").alias("n_docs"), F.col("c.tokens").alias("n_tokens"), "n_chars")
    if bpe_path is None:
        return rows

    def make():
        encode = byte_encoder(bpe_path).encode_ordinary

        def f(ids, sources, langs, texts):
            return ids, sources, langs, [bpe_name] * len(texts), [1] * len(texts), [len(encode(t)) for t in texts], [len(t) for t in texts]

        return f

    return rows.union(map_batches(base, make, COUNTS))


_encoders: dict = {}


def byte_encoder(path: str):
    """A tiktoken encoding of a rank file; one for each worker process."""
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals by key; partial sums go before the shuffle, so hot keys are no matter."""
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in TOTALS])


class Rollup:
    """A rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, bpe_path: str | None = None):
        self.spark, self.path, self.bpe_path = spark, path.rstrip("/"), bpe_path

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _there(self) -> list[str]:
        fs, p = self._fs(f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, batches: list[str], part: str, schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/commits/{b}/{part}" for b in batches])

    def committed(self) -> list[str]:
        """Ids of the batches that were applied, those that a compacted one stands for included."""
        there = self._there()
        replaced = [b for b in there if self._fs(f"{self.path}/commits/{b}/replaces")[0].exists(self._fs(f"{self.path}/commits/{b}/replaces")[1])]
        older = [r["batch"] for r in self._read(replaced, "replaces", "batch string").collect()]  # a name for each batch
        return sorted({*there, *older})

    def insert(self, batch_id: str, docs: DataFrame) -> bool:
        """Add documents (text, source, lang and, if they may go again, doc_id) once; False if the batch was applied before."""
        return self._commit(batch_id, lambda: counted(docs, self.bpe_path))

    def delete(self, batch_id: str, ids: DataFrame) -> bool:
        """Take away all that the rollup holds for the ids (doc_id)."""
        return self._commit(batch_id, lambda: self._held(ids, -1))

    def revise(self, batch_id: str, docs: DataFrame) -> bool:
        """Replace what the rollup holds for the ids of docs by the counts of docs; rows without an id are left out."""
        docs = docs.where(F.col("doc_id").isNotNull())
        return self._commit(batch_id, lambda: self._held(docs, -1).union(counted(docs, self.bpe_path)))

    def _held(self, ids: DataFrame, sign: int) -> DataFrame:
        """The counts of these ids as they stand, times the sign. Counts meet the ids, not texts."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
        held = summed(self._read(self._there(), "counts", COUNTS).join(ids, "doc_id", "left_semi"), "doc_id", *KEYS)
        return held.select("doc_id", *KEYS, *[(F.lit(sign) * F.col(c)).cast("long").alias(c) for c in TOTALS])

    def _commit(self, batch_id: str, changes, replaces: list[str] | None = None) -> bool:
        if not BATCH_ID.fullmatch(batch_id) or batch_id.strip(".") == "":
            raise ValueError(f"batch id {batch_id!r}")
        if batch_id in self.committed():
            return False
        name = f"{batch_id}-{uuid.uuid4().hex}"
        attempt, own = f"{self.path}/attempts/{name}", f"{self.path}/commits/{batch_id}"
        changes().write.parquet(f"{attempt}/counts")
        summed(self.spark.read.schema(COUNTS).parquet(f"{attempt}/counts"), *KEYS).coalesce(1).write.parquet(f"{attempt}/sums")
        if replaces is not None:
            self.spark.createDataFrame([(b,) for b in replaces], "batch string").coalesce(1).write.parquet(f"{attempt}/replaces")
        fs, target = self._fs(own)
        fs.mkdirs(target.getParent())
        source = self._fs(attempt)[1]
        renamed = fs.rename(source, target)
        inner = self._fs(f"{own}/{name}")[1]
        if fs.exists(inner):  # another driver was first: the folder went into that driver's
            fs.delete(inner, True)
            return False
        if not renamed:
            fs.delete(source, True)
            if fs.exists(target):
                return False
            raise OSError(f"could not commit {own}")
        return True

    def totals(self) -> DataFrame:
        """Current totals by key; keys whose documents are all gone are left out."""
        out = summed(self._read(self._there(), "sums", SCHEMA), *KEYS)
        return out.where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")

    def compact(self, into: Rollup) -> bool:
        """All committed batches as one batch of another rollup, which remembers their ids."""
        held = lambda: summed(self._read(self._there(), "counts", COUNTS), "doc_id", *KEYS).where("n_docs != 0 OR n_tokens != 0 OR n_chars != 0")
        return into._commit("compacted", lambda: held().select("doc_id", *KEYS, *TOTALS), self.committed())
