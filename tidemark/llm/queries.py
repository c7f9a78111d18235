"""The thin queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, ibloom, media, minhash, packing, pieces, pii, secrets, token_rollup, toxicity
from .common import documents, shared_dir, text_of


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def revised_rollup(spark: SparkSession, sf_dir: str, bpe_path: str | None) -> DataFrame:
    """Totals after three batches, each sent twice: all documents come, tables lose their bars, toxic documents go."""
    docs = documents(spark, sf_dir)
    without_bars = docs.where(text_of().contains("|")).withColumn("text", F.replace(text_of(), F.lit("|"), F.lit("")))
    toxic = documents(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    rollup = token_rollup.Rollup(spark, shared_dir(spark, "token-rollup"), bpe_path)
    for _ in range(2):
        rollup.insert("1-insert", docs)
        rollup.revise("2-revise", without_bars)
        rollup.delete("3-delete", toxic)
    return rollup.totals()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a byte-level vocabulary beside the two rule tokenizers."""
    return revised_rollup(spark, sf_dir, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def rule_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with the rule tokenizers alone, whose counts SQL can express."""
    return revised_rollup(spark, sf_dir, None)


OP2_COUNTS = [f"SELECT source, lang, '{name}' AS tokenizer, len(regexp_extract_all(text, '{pattern}')) AS tokens, length(text) AS chars FROM kept" for name, pattern in token_rollup.PATTERNS.items()]
OP2_SQL = f"""
WITH kept AS (
    SELECT source, lang, CASE WHEN doc_id IS NULL THEN coalesce(text, '') ELSE replace(coalesce(text, ''), '|', '') END AS text FROM documents
    WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), counted AS (
    {" UNION ALL ".join(OP2_COUNTS)}
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(tokens)::BIGINT AS n_tokens, sum(chars)::BIGINT AS n_chars
FROM counted GROUP BY source, lang, tokenizer
"""


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxicity.sample(docs, documents(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=4)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_texts(documents(spark, sf_dir)))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibloom.fingerprints(documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(documents(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "rule_token_counts": rule_token_counts,
    "op3_secret_scans": op3_secret_scans,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_media_columns": op7_media_columns,
    "op8_fingerprints": op8_fingerprints,
    "op9_html_extraction": op9_html_extraction,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL: dict[str, str] = {"rule_token_counts": OP2_SQL}
