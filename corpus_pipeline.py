"""A training corpus in four stages: toxic documents go, one document of each near-duplicate group stays, personal data is masked, and what is left is packed.

Each stage is written as Parquet to the folder in spark.checkpoint.dir and read again as
the next one's input, so a lost executor costs its running tasks only. All stages but the
last return the columns of documents. SQL can't express the stages; tests compare them
with brute-force versions, one by one and in a row.

Null texts count as empty: such documents aren't toxic, have no near-duplicates and are
packed as their end token; their text stays null until then. Rows without an id stay.
Rows that repeat an id are one document to the near-duplicate stage. Very long texts go
through whole. Further columns of documents are kept by all stages but the last. Empty
tables give an empty result; without labels of both classes nothing is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, pii, toxicity
from tidemark.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of this input, doesn't reject."""
    model = toxicity.fit(toxicity.sample(docs, documents(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind, terms that disclose them are generalised or removed; n_chars follows."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", mask_personal_data), ("packing", pack_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
