"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when they are identical after lower-casing A-Z.  The index
holds one entry per distinct text: its 64-bit hash, its bytes, the largest
document id and the number of copies.  Copies are merged in the map tasks, on
the text's bytes, so a text that makes up a third of all rows reaches its
entry as one row per map task.  The directory's buckets split until they hold
at most ``capacity`` keys; entries are written to the shared folder with their
bucket.  Owner tasks then take the index by key range (bucket) and chain the
entries of equal hash: entries of one chain differ in their bytes.  Documents
find their entry by hash; where a chain has more than one entry, by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm import extendible
from codecorpus.llm.common import cut, discard, lower_ascii, rows_of, shared_path

#: Keys in a bucket, and the most hash bits that the directory uses.
CAPACITY = 8192
MAX_BITS = 20
HASH_BITS = 64


def _normal():
    return lower_ascii(F.coalesce(F.col("text"), F.lit("")))


def _hash(text, hash_bits: int):
    full = F.xxhash64(text)
    return full if hash_bits == HASH_BITS else F.shiftleft(full, HASH_BITS - hash_bits)


def build_index(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = HASH_BITS) -> str:
    """Write the index of all texts to the shared folder; its path.

    Columns: ``bucket, hash, text, keep_id, group_size``.  ``hash_bits`` under
    64 makes hashes collide (for tests).
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", _normal().alias("text")).withColumn("hash", _hash(F.col("text"), hash_bits))
    keys = cut(texts.groupBy("hash").agg(F.lit(1).cast("long").alias("load")))
    bits, slots = extendible.build(keys, capacity, HASH_BITS, MAX_BITS)
    entries = texts.groupBy("hash", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    path = shared_path(spark, "exact-index")
    (extendible.look_up(entries, bits, slots, HASH_BITS).drop("depth", "prefix", "bucket_load", "bucket_keys")
     .sortWithinPartitions("bucket", "hash").write.parquet(path))
    return path


def chains(index: DataFrame) -> DataFrame:
    """Owner tasks: every entry with the length of its chain (entries of equal hash)."""
    owned = index.repartition("bucket")
    return owned.withColumn("chain", F.count(F.lit(1)).over(Window.partitionBy("bucket", "hash")))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = HASH_BITS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty.  Of equal texts the row with the largest
    ``doc_id`` stays (null ids are smallest); of rows that also share that id,
    one.  ``text_hash`` is xxhash64 of the text as it is, for joins back.
    Other columns are not read, so their names do not matter.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    path = build_index(docs, capacity, hash_bits)
    index = spark.read.parquet(path)
    chained = cut(chains(index.select("bucket", "hash", "keep_id", "group_size")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _normal().alias("normal")).select(
        "doc_id", "text_hash", F.sha2("normal", 256).alias("text_sha256"), _hash(F.col("normal"), hash_bits).alias("hash"))
    same = Window.partitionBy("hash", "doc_id", "text_sha256").orderBy("text_hash")
    numbered = rows.withColumn("nth", F.row_number().over(same))
    found = numbered.join(chained.where("chain = 1").select("hash", "keep_id", "group_size"), "hash")
    collided = chained.where("chain > 1").select("hash").distinct()
    if collided.isEmpty():
        discard(spark, path)
    else:
        # Unequal texts of equal hash: compare the bytes.
        texts = index.join(collided, "hash", "left_semi").select("hash", "text", "keep_id", "group_size")
        full = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _normal().alias("text"))
        full = full.withColumn("text_sha256", F.sha2("text", 256)).withColumn("hash", _hash(F.col("text"), hash_bits))
        full = full.withColumn("nth", F.row_number().over(same))
        found = found.unionByName(full.join(texts, ["hash", "text"]).select(*found.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return found.select("doc_id", "text_hash", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops."""
    return rows_of(docs, exact_dedup(docs, capacity).where("kept"))
