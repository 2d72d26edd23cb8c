"""The directory of an extendible hash: which prefix of the hash bits names a key's bucket.

The directory starts with one bucket.  A bucket whose load exceeds the limit
splits on the next hash bit, and the directory doubles when a bucket at its
full depth splits.  The result is the shallowest prefix whose load fits, for
every key, so it is worked out from the loads of all prefixes at once: a
histogram over cells of ``bits`` hash bits is rolled up to every shorter
prefix.  ``bits`` grows only while some cell holds more than fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import cut

#: Directories of at most this many slots may be broadcast (3 longs and a short string each).
BROADCAST_SLOTS = 1 << 20


def top_bits(value: Column, width: int, bits: int) -> Column:
    """The first ``bits`` of a hash of ``width`` bits held in a long."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(value, width - bits)


def build(keys: DataFrame, limit: int, width: int, max_bits: int | None = None) -> tuple[int, DataFrame]:
    """Directory for ``keys(hash, load)``, ``hash`` being a long of ``width`` bits.

    Returns ``(bits, slots)``; slots has one row per used cell of ``bits`` bits:
    ``cell, depth, prefix, bucket`` ("b" and the prefix bits), ``bucket_load``
    and ``bucket_keys``.  A bucket is left over the limit only if all its keys
    have the same hash, or at ``max_bits``.  No keys give no slots.
    """
    total = keys.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    last = max_bits or width
    bits = min(last, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    while True:
        cells = keys.groupBy(top_bits(F.col("hash"), width, bits).alias("cell")).agg(
            F.sum("load").alias("load"), F.count(F.lit(1)).alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn(
            "prefix", F.expr(f"shiftrightunsigned(cell, {bits} - depth)"))
        loads = levels.groupBy("depth", "prefix").agg(
            F.sum("load").alias("bucket_load"), F.sum("n").alias("bucket_keys"),
            (F.min("lo") == F.max("hi")).alias("same"))
        fits = (F.col("bucket_load") <= limit) | F.col("same") | (F.col("depth") == last)
        leaf = F.min(F.when(fits, F.struct("depth", "prefix", "bucket_load", "bucket_keys")))
        slots = cut(levels.select("cell", "depth", "prefix").join(loads, ["depth", "prefix"])
                    .groupBy("cell").agg(leaf.alias("leaf")))
        if bits >= last or slots.where("leaf IS NULL").isEmpty():
            break
        bits = min(last, bits + 4)
    digits = F.when(F.col("leaf.depth") == 0, F.lit("b")).otherwise(
        F.concat(F.lit("b"), F.expr("lpad(bin(leaf.prefix), leaf.depth, '0')")))
    return bits, slots.select("cell", "leaf.depth", "leaf.prefix", digits.alias("bucket"),
                              "leaf.bucket_load", "leaf.bucket_keys")


def look_up(rows: DataFrame, bits: int, slots: DataFrame, width: int) -> DataFrame:
    """``rows`` (with a ``hash`` column) and the directory's columns for each."""
    small = slots.count() <= BROADCAST_SLOTS
    placed = rows.withColumn("cell", top_bits(F.col("hash"), width, bits))
    return placed.join(F.broadcast(slots) if small else slots, "cell").drop("cell")
