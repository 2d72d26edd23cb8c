"""Importance resampling of documents toward a target distribution.

Features are hashed word runs.  A bucket's gain is the log ratio of its share
in the target to its share in the documents; the gains of all buckets are one
array, by which every document is scored: its weight is the mean gain of its
features.  Weight plus Gumbel noise (keyed by the document id) is the score,
and the highest scores are a draw without replacement in proportion to
``exp(weight)``.

How many rows are drawn is exact, without sorting all of them or gathering any: scores
are persisted, and repeated count jobs bisect the score at which the draw ends;
of the rows tied there, the document id is bisected, and of rows that tie in
that too, the text hash.  Rows equal in all of these are one persisted row with
a number of copies, so no key is too hot.  The drawn rows are then
range-partitioned in order and ranked by the row counts of the partitions
before.

The driver gets one count per bucket (``BUCKETS`` numbers) and the counts of
the bisection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import alnum_words, discard, rows_of, shared_path
from codecorpus.operators.sampling import global_index

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
#: Share of the eligible documents that is drawn, as numerator and denominator.
SHARE = (10, 100)
SEED = 2024
#: Copies of a row that one task writes out.
CHUNK = 65_536


def buckets(words: Column, longest: int = LONGEST, n: int = BUCKETS) -> Column:
    """Bucket of every run of 1 to ``longest`` words, repeats included."""
    size = F.size(words)

    def runs_of(k: int) -> Column:
        starts = F.when(size >= k, F.sequence(F.lit(1), size - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    runs = F.concat(words, *map(runs_of, range(2, longest + 1)))
    return F.transform(runs, lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(n)).cast("int"))


def _counts(featured: DataFrame, n: int) -> list[int]:
    """How often each bucket occurs: ``n`` numbers."""
    out = [0] * n
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Floor of 1000 times the log ratio of each bucket's smoothed shares."""
    n, s_all, t_all = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw, target)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floor of 1000 times a Gumbel variate, keyed by the id (null as "")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, buckets_: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score, copies``, one
    row for all rows that are equal in these; persisted in the shared folder."""
    spark = docs.sparkSession
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    path = shared_path(spark, "resample-features")
    words.select("doc_id", "text_hash", F.size("words").alias("n_words"),
                 buckets(F.col("words"), longest, buckets_).alias("buckets")).write.parquet(path)
    featured = spark.read.parquet(path)
    of_target = target.select(alnum_words(F.col("text")).alias("words")).select(
        F.size("words").alias("n"), buckets(F.col("words"), longest, buckets_).alias("buckets"))
    gain = gains(_counts(featured, buckets_), _counts(of_target, buckets_))
    # One array constant, folded when the plan is made.
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    n = F.col("n_features")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(array, b))
    rows = featured.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
                           F.size("buckets").cast("long").alias("n_features"), total.alias("total"))
    rows = rows.withColumn("weight", F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    merged = rows.groupBy("doc_id", "text_hash", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    out = shared_path(spark, "resample-scores")
    merged.write.parquet(out)
    discard(spark, path)
    return spark.read.parquet(out)


def bisect(rows: DataFrame, column: str, need: int) -> tuple[int, int]:
    """The least value of ``column`` up to which there are ``need`` rows, and
    the number of rows below it: one exact count job per halving.  ``rows``
    hold at least ``need`` copies, and no nulls in the column."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, below = int(ends["lo"]), int(ends["hi"]), 0
    while lo < hi:
        mid = (lo + hi) // 2
        upto = rows.where(F.col(column) <= F.lit(mid).cast("long")).agg(F.sum("copies").alias("n")).first()["n"] or 0
        if upto >= need:
            hi = mid
        else:
            lo, below = mid + 1, upto
    return lo, below


def cutoff(rows: DataFrame, order: list[str], need: int) -> tuple[list[int], int]:
    """The key, in ``order``, at which ``need`` rows are reached, and how many of its copies belong to them."""
    key = []
    for column in order:
        value, below = bisect(rows, column, need)
        rows, need = rows.where(F.col(column) == F.lit(value).cast("long")), need - below
        key.append(value)
    return key, need


def _copies(rows: DataFrame, n: str) -> DataFrame:
    """Every row ``n`` times, with ``copy`` from 1; many copies are written by many tasks."""
    many = rows.where(F.col(n) > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {CHUNK}"))))
    many = many.repartition("fall", "id", "text_hash", "chunk")
    few = rows.where(F.col(n).between(1, CHUNK)).withColumn("chunk", F.lit(0).cast("long"))
    first = F.col("chunk") * CHUNK + 1
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(first, F.least(F.col(n), first + (CHUNK - 1))))).drop("chunk")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS,
             n_buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_features, weight, score, rank``.

    Of the documents of at least ``least_words`` words, ``floor(num * N / den)``
    are drawn: those of the highest score, ties by smaller id (null last), then
    by text hash; ``rank`` counts them from 1 in that order and is null for all
    others.  Of equal rows, as many are drawn as the number asks for.  Null and
    empty texts have no features and weight 0.  An empty target counts as one
    without features; an empty table gives an empty result.
    """
    rows = scored(docs, target, n_buckets, longest, seed)
    # Rows are drawn in ascending order of these.
    order = ["fall", "no_id", "id", "text_hash"]
    rows = rows.withColumns({"fall": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"),
                             "id": F.coalesce("doc_id", F.lit(0)).cast("long")})
    eligible = rows.where(F.col("n_words") >= least_words)
    need = share[0] * (eligible.agg(F.sum("copies").alias("n")).first()["n"] or 0) // share[1]
    columns = ["doc_id", "text_hash", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not need:
        return _copies(rows, "copies").select(*columns, unranked)
    key, last = cutoff(eligible, order, need)
    own, end = F.struct(*order), F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(order, key)])
    taken = (F.when((F.col("n_words") < least_words) | (own > end), 0).when(own < end, F.col("copies"))
             .otherwise(F.lit(last))).cast("long")
    rows = rows.withColumn("taken", taken).withColumn("left", F.col("copies") - F.col("taken"))
    drawn = _copies(rows.where("taken > 0").select(*columns, *order[:-1], "taken"), "taken").drop("taken")
    ranked = global_index(drawn, [*order, "copy"], "rank")
    return (ranked.select(*columns, (F.col("rank") + 1).alias("rank"))
            .unionByName(_copies(rows.where("left > 0"), "left").select(*columns, unranked)))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all columns."""
    return rows_of(docs, resample(docs, target, **options).where("rank IS NOT NULL"))
