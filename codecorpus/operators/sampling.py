"""Deterministic sampling, ranking, global order and grouping.

Randomness is md5-keyed, ``u = (first 8 hex digits of md5(seed:key) + 1) / 2^32``,
so a result does not depend on partitioning or task retries.

Scale notes
* top-1 per group uses ``min_by`` (hash aggregate with map-side partial
  aggregation), so a group holding a third of all rows is reduced in every
  map task before the shuffle;
* top-N per group is ``row_number() <= N``, which Spark plans with a
  partial ``WindowGroupLimit`` before the shuffle;
* the global row index (shards, zip, batches) range-partitions once and adds
  per-partition offsets from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed: int, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str)
                                  else F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: int, *cols) -> Column:
    """u in (0, 1], never 0, from the first 32 bits of md5(seed:key)."""
    h = F.conv(F.substring(md5_key(seed, *cols), 1, 8), 16, 10).cast("double")
    return (h + 1.0) / 4294967296.0


def capped_sample(df: DataFrame, group: str, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per group, chosen by md5 order."""
    w = Window.partitionBy(group).orderBy(md5_key(seed, key), F.col(key))
    return (df.withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= cap))


def weighted_choice(df: DataFrame, group: list[str] | str, key: list[str] | str, weight: str,
                    seed: int = 11, cols: list[str] | None = None) -> DataFrame:
    """One row per group, probability proportional to ``weight``
    (Efraimidis-Spirakis: smallest ``-ln(u)/w``).  Zero / NULL / negative
    weights are never chosen.
    """
    group = [group] if isinstance(group, str) else list(group)
    key = [key] if isinstance(key, str) else list(key)
    cols = cols or [c for c in df.columns if c not in group]
    w = F.col(weight).cast("double")
    es = -F.log(uniform(seed, *group, *key)) / w
    picked = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(es, *[F.col(k) for k in key]))
    return (df.where(w > 0).groupBy(*group).agg(picked.alias("_p"))
            .select(*group, *[F.col("_p")[c].alias(c) for c in cols]))


def uniform_choice(df: DataFrame, group: list[str] | str, key: list[str] | str, seed: int = 0,
                   cols: list[str] | None = None) -> DataFrame:
    """One uniformly random row per group (md5 order, min_by)."""
    group = [group] if isinstance(group, str) else list(group)
    key = [key] if isinstance(key, str) else list(key)
    cols = cols or [c for c in df.columns if c not in group]
    picked = F.min_by(F.struct(*[F.col(c) for c in cols]), md5_key(seed, *group, *key))
    return (df.groupBy(*group).agg(picked.alias("_p"))
            .select(*group, *[F.col("_p")[c].alias(c) for c in cols]))


def count_histogram(df: DataFrame, keys: list[str], out: str = "n_matches") -> DataFrame:
    """Histogram of rows-per-key (count of counts), weighted by rows:
    every row of a key with n rows adds one to bucket n."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return per_key.groupBy(out).agg(F.sum(out).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def lookup_histogram(left: DataFrame, right: DataFrame, on: list[str],
                     out: str = "n_matches") -> DataFrame:
    """G6 with zero buckets: rows of ``left`` by how many ``right`` rows match
    (left rows without a match land in bucket 0)."""
    counts = right.groupBy(*on).agg(F.count(F.lit(1)).alias(out))
    per = left.select(*on).join(counts, on, "left").fillna(0, subset=[out])
    return per.groupBy(out).agg(F.count(F.lit(1)).alias("n_rows"))


def global_index(df: DataFrame, order: list[str], out: str = "idx",
                 partitions: int | None = None, with_total: bool = False) -> DataFrame:
    """Dense 0-based row index in ``order`` without a single-partition window.

    Range-partition on ``order`` (checkpointed once), number rows inside each
    partition (``monotonically_increasing_id`` holds partition id and
    position), and add the row count of all earlier partitions.  The
    per-partition count table has one row per partition, so broadcasting it
    is size-bounded.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range bounds come from sampling, so two evaluations could cut the data
    # differently: materialise the partitioned, sorted rows once (reliable
    # checkpoint) and take both the counts and the positions from that copy.
    from codecorpus.session import checkpoint
    ranged = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    keep = ["_pid", "_off"]
    if with_total:
        # total row count rides along on the same partition-count table
        offs = offs.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
        keep.append("_total")
    return (ranged.join(F.broadcast(offs.select(*keep)), "_pid")
            .withColumn(out, F.col("_off") + F.col("_pos"))
            .drop("_mid", "_pid", "_pos", "_off"))


def shard(df: DataFrame, order: list[str], n_shards: int) -> DataFrame:
    """A10: N contiguous shards of ``ceil(rows/N)`` rows, the last one smaller."""
    idx = global_index(df, order, with_total=True)
    chunk = F.ceil(F.col("_total") / F.lit(n_shards))
    return (idx.withColumn("shard", F.least(F.floor(F.col("idx") / chunk) + 1, F.lit(n_shards)))
            .drop("_total"))


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[str],
                   right_order: list[str], how: str = "full") -> DataFrame:
    """pair the i-th row of ``left`` with the i-th row of ``right``.

    ``status`` is ``ok``, or ``no_left`` / ``no_right`` for the surplus rows of
    the longer side, which are kept."""
    a = global_index(left, left_order).withColumn("_l", F.lit(True))
    b = global_index(right, right_order).withColumn("_r", F.lit(True))
    status = (F.when(F.col("_l").isNull(), F.lit("no_left")).when(F.col("_r").isNull(), F.lit("no_right"))
              .otherwise(F.lit("ok")))
    return a.join(b, "idx", how).withColumn("status", status).drop("_l", "_r")


def fixed_batches(df: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """``floor(idx / size)`` over the global order."""
    return global_index(df, order).withColumn(out, F.floor(F.col("idx") / size))


def inspect_sample(df: DataFrame, key: str | list[str], n: int = 3, seed: int = 42) -> DataFrame:
    """``n`` rows for inspection in md5 order of their key (a top-k by design)."""
    key = [key] if isinstance(key, str) else list(key)
    return df.orderBy(md5_key(seed, *key), *key).limit(n)


def by_group(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows of one group (e.g. project) in the same partition, for
    per-group work such as ``mapInArrow`` / ``applyInPandas`` jobs.  AQE
    splits a partition that one hot group makes too large only for joins,
    so per-group functions must stream their rows, not collect them."""
    return df.repartition(partitions, key) if partitions else df.repartition(key)
