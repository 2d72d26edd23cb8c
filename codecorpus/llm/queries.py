"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import (
    decontaminate, dedup, jaccard, mixing, packing, quality, resample, sharding, simhash, suffixes, urls, warc, whitening)
from codecorpus.llm.common import cut, shared_path, table
from codecorpus.llm.oracle import ORACLE  # noqa: F401


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; for ids divisible
    by 20 also the number of documents within three bits, by block tables."""
    found = cut(simhash.with_edits(table(spark, sf_dir, "documents")))
    near = simhash.near_counts(found.select("doc_id", "fp"))
    asked = F.when(F.col("doc_id") % 20 == 0, F.col("near_docs"))
    return found.join(near.hint("merge"), "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("fp")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", asked.alias("near_docs"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal documents stays, for every document."""
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated strings of 100 bytes leaves of every document."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in training order."""
    plan = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       F.round("first_position", 9).alias("first_position"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3 words are at least 90 % alike."""
    return jaccard.group(table(spark, sf_dir, "documents"), 3, (90, 100)).select("doc_id", "n_shingles", "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, by rule or by the classifier."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents to shards of at most 4 MiB of text and read them back."""
    assigned = sharding.assign(table(spark, sf_dir, "documents"))
    path = shared_path(spark, "shards")
    sharding.write(assigned, path)
    return sharding.read(spark, path, assigned).select(
        "doc_id", "shard", "shard_depth", "shard_bytes", "shard_docs", sharding.n_bytes().alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality posterior of every document from its text and its site."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages as WARC files, read these back and index their pages."""
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    index = warc.page_index(warc.reassemble(warc.read_records(spark, path)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn toward the benchmark's word distribution, with ranks."""
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark's windows of ten words."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash", "spans")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the first 32 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_resample": op11_resample,
    "op12_decontaminate": op12_decontaminate,
    "op13_whitening": op13_whitening,
}
