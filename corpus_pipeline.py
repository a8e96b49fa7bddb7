"""Corpus pipeline: language ID, near-duplicates, repeated passages, source mix, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every stage takes rows of null doc_id as documents of their own (near-duplicates and repeated passages leave them as they
are), rows that share a doc_id apart by their texts, further columns of any names, texts of any length as a whole, and
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, langid, mixing, simhash, suffixes
from strandlake.llm.common import materialize, scratch, shared_dir, table
from strandlake.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (und) go, no others: the score rejects none. A missing lang is filled in by the best guess."""
    return langid.keep_known(docs, langid.fit_documents(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays, that with the smallest doc_id;
    null and empty texts are one group."""
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller doc_id has too are cut; documents left empty,
    and null texts, go."""
    return suffixes.drop_repeats(docs).where(F.col("text").isNotNull() & (F.regexp_count("text", F.lit(r"\S")) > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; texts without a word are not taken. A null
    source is a source of its own."""
    return mixing.mixed_rows(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256; a null text is an empty one."""
    found = bpe.encode_texts(docs, tokenizer_path(), keep=("doc_id", "lang", "source"), decoded=True)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

#: Fitted machines, fingerprints and merges are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):  # a stage's own intermediate tables go when its rows are written
            docs = materialize(stage(spark, docs, sf_dir), path)
    return docs
