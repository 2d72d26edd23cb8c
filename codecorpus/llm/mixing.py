"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1].  Its
integral is the source's share of all words; the cumulative demand
``D(t) = target * (t + a * (t^2 - t))`` (a: the schedule's tilt) says how many
of its words training has used by time t.  The source's documents are laid
out one after the other on a word axis, pass after pass, in a fixed hash
order; a document's training position is the time at which the demand
reaches its first word, ``D^-1(start)``.  Sorting all documents by position
gives the training order.

All work is DataFrame expressions.  A source may hold any share of all rows:
prefix sums run in two levels, over 4096 hash buckets of each source and then
inside each bucket, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import ROW_KEY, WORD, cut, keyed_rows, numbered, row_key

#: A source is read at most this many times.
MAX_PASSES = 3
#: Hex digits of the order hash that name a bucket.
BUCKET_DIGITS = 3


def tilt_by_weight(weight: Column) -> Column:
    """Slope of a source's schedule, -1 to 1: light sources fade out, heavy
    ones grow, those of weight 2 stay level."""
    return (weight - 2) * F.lit(0.5)


def source_targets(sized: DataFrame, max_passes: int = MAX_PASSES, tilt=tilt_by_weight) -> DataFrame:
    """One row per source: ``skey, source_size, weight, target, tilt``.

    Sources by code point (null last) weigh 1, 2, 3, repeating.  Targets are
    ``least(max_passes * size, level * weight)`` where ``level`` fills the sum
    of all sizes: with sources sorted by cap / weight, the level is the largest
    of (total - caps before) / (weights from here on).
    """
    sizes = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("weight", (F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1)
    capped = ranked.withColumn("cap", max_passes * F.col("source_size"))
    w = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    every = Window.partitionBy(F.lit(0))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / F.sum("weight").over(onward))
    levels = capped.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.max("level").over(every) * F.col("weight"))
    return levels.select("skey", "source_size", "weight", target.alias("target"),
                         tilt(F.col("weight")).cast("double").alias("tilt"))


def position(done: Column, tilt: Column) -> Column:
    """Time at which the share ``done`` (0 to 1) of a source's demand is used:
    the root of ``tilt * t^2 + (1 - tilt) * t = done`` in [0, 1]."""
    b = 1 - tilt
    return 2 * done / (b + F.sqrt(b * b + 4 * tilt * done))


def mix(docs: DataFrame, max_passes: int = MAX_PASSES, tilt=tilt_by_weight) -> DataFrame:
    """Plan the mix: one row per document.

    Columns: ``doc_id, text_hash, size`` (words; null text: 0), ``source_size``,
    ``target`` (both of its source), ``taken`` (words the mix takes, repeats
    counted) and ``passes``: an array with one (start position, words) struct
    per pass that takes the document.  A source's last pass ends at the word
    where the rounded target is reached, so its taken words sum to the rounded
    target exactly; the document there is taken in part.  Documents without
    words, and an empty table, take nothing.  Rows with the same id are
    separate documents; ties have the same hash order by id, size and text.
    """
    skey = F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")),
                    F.coalesce(F.col("source").cast("string"), F.lit("")))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = cut(docs.select(
        "doc_id", skey.alias("skey"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order_hash"), F.substring(order, 1, BUCKET_DIGITS).alias("bucket")))
    sums = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    w = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(w), F.lit(0)).alias("bucket_start"))
    starts = starts.join(source_targets(sized, max_passes, tilt), "skey")
    w = (Window.partitionBy("skey", "bucket").orderBy("order_hash", "doc_id", "size", "text_hash")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sized.withColumn("before", F.sum("size").over(w) - F.col("size")).join(starts, ["skey", "bucket"])
    demand = F.round("target").cast("long")
    passes = F.array(*[F.struct(
        position(F.try_divide((F.col("before") + F.col("bucket_start") + p * F.col("source_size")).cast("double"),
                              demand.cast("double")), F.col("tilt")).alias("position"),
        F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), demand - p * F.col("source_size")
                - F.col("bucket_start") - F.col("before"))).alias("words")) for p in range(max_passes)])
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda acc, p: acc + p["words"])
    return (placed.withColumn("passes", F.filter(passes, lambda p: p["words"] > 0))
            .select("doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"), "passes"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Range-sort the plan's documents by the position of their first pass;
    documents that the mix leaves out come last."""
    first = F.when(F.size("passes") > 0, F.col("passes")[0]["position"])
    return mixed.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def training_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, range-sorted by position: a
    row for each pass whose midpoint the demand reaches, with whole texts (a
    pass cut inside a document counts if at least half of it is taken; a
    document without words stays once, at the end)."""
    whole = F.filter("passes", lambda p: 2 * p["words"] >= F.col("size"))
    at = F.when(F.col("size") == 0, F.array(F.lit(2.0))).otherwise(F.transform(whole, lambda p: p["position"]))
    # Rows equal in id and text are numbered on both sides, so that each meets one.
    plan = numbered(mixed.select(*row_key(F.col("text_hash")), at.alias("_at"))).withColumnRenamed("_nth", "_other")
    both = keyed_rows(docs).join(plan, ROW_KEY).where(F.col("_nth") - F.col("_other") == 0)
    return (both.select("_row", F.explode("_at").alias("_position"))
            .orderBy("_position", F.col("_row")["doc_id"]).select("_row.*"))
