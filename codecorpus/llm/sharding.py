"""Sharding by extendible hashing: shards are hash-prefix buckets under a byte limit.

The shard of a document is named by the leading bits of its id's hash; only
shards over the limit split on another bit (``extendible.build``).  Shards are
written as folders ``shard=b<bits>`` below one path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm import extendible
from codecorpus.llm.common import cut, default_partitions

#: Bits of the id hash: 15 hex digits of md5, which fit in a long.
WIDTH = 60
SHARD_BYTES = 4 << 20
#: Of these, the bits of the id hash that rows of equal ids keep in the second directory.
ID_BITS = 24
#: Bytes of text that a writing task gets, about.
TASK_BYTES = 64 << 20


def id_hash(doc_id="doc_id"):
    digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, WIDTH // 4)
    return F.conv(digits, 16, 10).cast("long")


def n_bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def row_hash(doc_id, text, number):
    """Hash of a row among rows of equal id hash: its leading bits are those of
    the id, the others are of its text and its number."""
    own = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(text, F.lit("")), number.cast("string"))), 1, (WIDTH - ID_BITS) // 4), 16, 10)
    return F.shiftleft(F.shiftrightunsigned(id_hash(doc_id), WIDTH - ID_BITS), WIDTH - ID_BITS).bitwiseOR(own.cast("long"))


def assign(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``shard, shard_depth, shard_bytes, shard_docs, n_bytes``.

    Bytes are those of the text in UTF-8 (null: 0).  Documents with equal ids
    (null ids too) share a shard if they fit; if not, no bit of the id's hash
    parts them, and a second directory (shards ``x...``) splits them by the bits
    of a hash of text and row.  So only a single document may exceed the limit.
    Columns of ``docs`` with the added names are replaced.  An empty table gives
    an empty result.
    """
    keys = cut(docs.select(id_hash().alias("hash"), n_bytes().alias("load")))
    bits, slots = extendible.build(keys, limit, WIDTH)
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*names).alias("row"), id_hash().alias("hash"), n_bytes().alias("n_bytes"))
    placed = extendible.look_up(rows, bits, slots, WIDTH)
    crowded = (F.col("bucket_load") > limit) & (F.col("bucket_keys") > 1)
    parts = [placed.where(~crowded)]
    if not slots.where(crowded).isEmpty():
        # Numbered once and written, so that a row keeps its number whatever is computed again.
        number = F.monotonically_increasing_id()
        rows = cut(placed.where(crowded).select("row", "n_bytes", row_hash("row.doc_id", F.col("row.text"), number).alias("hash")))
        more, split = extendible.build(rows.select("hash", F.col("n_bytes").alias("load")), limit, WIDTH)
        second = extendible.look_up(rows, more, split, WIDTH)
        parts.append(second.withColumn("bucket", F.concat(F.lit("x"), F.substring("bucket", 2, WIDTH))))
    placed = reduce(DataFrame.unionByName, parts)
    return placed.select("row.*", F.col("bucket").alias("shard"), F.col("depth").alias("shard_depth"),
                         F.col("bucket_load").alias("shard_bytes"), F.col("bucket_keys").alias("shard_docs"), "n_bytes")


ADDED = ("shard", "shard_depth", "shard_bytes", "shard_docs", "n_bytes")


def write(assigned: DataFrame, path: str) -> None:
    """Write every shard once: its rows meet in one task (bounded by the byte
    limit) and go to one folder.  There are as many tasks as the bytes call for."""
    total = assigned.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(default_partitions(assigned.sparkSession), -(-total // TASK_BYTES))
    assigned.repartition(tasks, "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def read(spark, path: str, like: DataFrame) -> DataFrame:
    """The rows of all shards below ``path`` (``like``: what was written)."""
    return spark.read.schema(like.schema).parquet(path)
