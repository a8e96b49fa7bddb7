"""The registered query of each operator of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, automata, bpe, decontam, editprint, infill, langid, lexical, licenses, mixing, passages, simhash, suffixes, warc
from .common import shared_dir, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edit_report(table(spark, sf_dir, "documents"))


def near_classes_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of operator 1: bit-sampled banding of the fingerprints, verification and classes."""
    return editprint.near_classes(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages.kept_digests(docs, automata.repeated_spans(docs))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.resolve_revisits(warc.read_records(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    found = langid.predict(keyed, langid.fit_documents(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passages.kept_digests(docs, suffixes.repeated_spans(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), ngram=3, bits=64, segment_bits=64, budget=2, total_budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_items_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity search of operator 12: all terms of a window of an item within 20 document terms."""
    return decontam.near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints,
        op2_license_scan,
        op3_substring_dedup,
        op4_warc,
        op5_nearest_neighbours,
        op6_bpe,
        op7_mix_sources,
        op8_language_id,
        op9_suffix_array_dedup,
        op10_simhash,
        op11_lexical_search,
        op12_decontaminate,
        op13_fill_in_middle,
        near_items_by_index,
        near_classes_by_fingerprint,
    )
}
SQL = {"op7_mix_sources": mixing.SQL, "op11_lexical_search": lexical.SQL, "op12_decontaminate": decontam.SQL, "op13_fill_in_middle": infill.SQL}
