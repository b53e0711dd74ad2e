"""The training-text pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, in the columns of ``docs``; the last one
returns the encoded documents. Documents may have null or empty texts: language identification rejects them, as it does any
text without a letter. Null identifiers, sources and languages are kept. The mix may hold a document up to three times.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetbook.llm import byte_bpe, exact_dedup, language_id, mixing, simhash_dedup
from streetbook.llm.shared import stored

SHINGLE, MAX_BITS = 3, 2
VOCABULARY = "byte_bpe_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents for which a language is found; profiles are learned from those that are not held out."""
    profiles = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, profiles, lang="_lang", score="_score")
    return found.filter(F.col("_lang") != language_id.UNKNOWN).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest identifier of each text, letter case A-Z aside."""
    return exact_dedup.exact_groups(docs, exact_dedup.normalised(F.col("text"))).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest identifier of each group of near copies."""
    return simhash_dedup.keep_first(docs, SHINGLE, MAX_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws whole documents up to each source's target, repeated where it needs that, in the order of the curriculum."""
    return mixing.curriculum(docs, whole=True).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes that prove the round trip."""
    vocab = byte_bpe.vocabulary(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    out = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), vocab, ids="token_ids")
    return out.select("doc_id", "source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Profiles, fingerprints and merges have no SQL form: tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
