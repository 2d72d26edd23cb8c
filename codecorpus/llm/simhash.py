"""Document fingerprints: SimHash, and radius search with permuted block tables.

A text's terms are its pairs of neighbouring words (and its last word alone).
Every occurrence votes with the weight of its length, for or against each bit
of the term's 64-bit hash; the fingerprint has the bits with a majority.  Votes
are summed by a plain aggregation over exploded terms; each of 32 sums holds
the votes of two bits.

Two fingerprints within ``radius`` bits agree on at least ``blocks - radius``
of ``blocks`` bit blocks.  There is a table for each choice of that many
blocks, keyed by their bits; fingerprints that share a key in some table are
compared, so none within the radius is missed.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import cut, default_partitions

BITS = 64
RADIUS = 3
BLOCKS = 6
#: A word and, if there is one, the next: overlapping pairs by look-ahead.
TERM = r"(?<![^\x20\x09-\x0D])(?=([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?))"
_PAIR = 0x0000000100000001
_LOW = 0xFFFFFFFF


def _votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint ``fp`` of ``text``, one row per key group."""
    terms = rows.select(*keys, F.explode_outer(F.regexp_extract_all(text, F.lit(TERM), F.lit(1))).alias("term"))
    weighed = terms.select(*keys, F.xxhash64("term").alias("h"), F.coalesce(F.octet_length("term"), F.lit(0)).cast("long").alias("w"))
    sums = [F.sum(F.shiftright("h", j).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"v{j}") for j in range(BITS // 2)]
    voted = weighed.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    fp = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low = F.col(f"v{j}").bitwiseAND(F.lit(_LOW)) * 2 > F.col("total")
        high = F.shiftrightunsigned(f"v{j}", 32) * 2 > F.col("total")
        for on, bit in ((low, j), (high, j + 32)):
            fp = fp.bitwiseOR(F.when(on, F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return voted.select(*keys, fp.alias("fp"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` of every distinct (id, text).  Null and empty texts have 0."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return _votes(rows, ["doc_id", "text_hash"], "text")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


# -- neighbours in id order --------------------------------------------------

def _placed(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt to buckets of consecutive ids; a bucket also gets, as
    ``ghost``, the first document of the bucket after it in descending order
    (the last bucket: of the first)."""
    ids = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash")))
    splits = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], F.lit(100 * buckets))).first()[0]
    bucket = _bucket(F.col("doc_id"), sorted(set(splits or [])))
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("doc_id", "text_hash")).alias("head"))
    up = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy(F.lit(0))))
    ghosts = heads.select(F.col("head.doc_id").alias("g_id"), F.col("head.text_hash").alias("g_hash"), up.alias("g_bucket"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash"))
    # At most one row a bucket, and the number of buckets is a parameter.
    marked = rows.join(F.broadcast(ghosts), on, "left")
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("g_bucket").alias("bucket"), F.lit(True).alias("ghost"))
    places = F.when(F.col("g_bucket").isNull(), F.array(own)).otherwise(F.array(own, copy))
    return marked.select("doc_id", "text_hash", "text", F.inline(places))


def _bucket(value: Column, splits: list[int]) -> Column:
    """Number of splitters up to ``value`` (null: -1), found in two steps."""
    if not splits:
        return F.when(value.isNull(), -1).otherwise(0)
    step = max(1, int(len(splits) ** 0.5))
    coarse = F.array(*[F.lit(s) for s in splits[::step]])
    passed = F.greatest(F.size(F.filter(coarse, lambda s: s <= value)) - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.slice(F.array(*[F.lit(s) for s in splits]), passed + 1, F.lit(step)), lambda s: s <= value))
    return F.when(value.isNull(), -1).otherwise(passed + fine)


def with_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    One row per document: ``doc_id, text_hash, n_chars, edited_sha256, fp,
    edited_fp, near_edited, near_next``.  The edited text has its last
    floor(n_chars / 3) characters replaced by the first as many, or all, of
    the next document in descending id order (after the last: the first; a
    single document follows itself).  Null ids come last, ties by text hash;
    null text is empty.  An empty table gives an empty result.
    """
    buckets = buckets or 4 * default_partitions(docs.sparkSession)
    order = ["ghost", F.col("doc_id").desc_nulls_last(), F.col("text_hash").desc()]
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = _placed(docs, buckets).withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("text").over(w))
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.expr("left(text, length(text) - length(text) div 3)"), F.expr("left(coalesce(next, ''), length(text) div 3)")))
    keys = ["bucket", "rn", "ghost", "doc_id", "text_hash", "n_chars", "edited_hash", "kind"]
    both = rows.withColumn("edited_hash", F.unhex(F.sha2("edited", 256))).select(*keys[:-1], F.posexplode(F.array("text", "edited")).alias("kind", "version"))
    # All of this stays in the tasks that hold the buckets: no further shuffle.
    fps = _votes(both, keys, "version").groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    found = fps.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))).where("NOT ghost")
    return found.select(
        "doc_id", "text_hash", "n_chars", F.lower(F.hex("edited_hash")).alias("edited_sha256"), "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


# -- radius search -----------------------------------------------------------

def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """The bits of every table's key: each choice of ``blocks - radius`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(own, blocks - radius)]


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs ``fp, other, distance`` of a query fingerprint and any fingerprint
    within the radius (itself too).  Both inputs have distinct ``fp``s.

    A pair is given by the first table in which it agrees.
    """
    masks = [_signed(m) for m in block_masks(blocks, radius)]
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(m).alias("mask")) for t, m in enumerate(masks)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("fp").alias(name), F.inline(tables))
        return rows.select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("block_key"))

    differ = F.col("fp").bitwiseXOR(F.col("other"))
    agreed = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    a, b = keyed(queries, "fp").alias("a"), keyed(fps, "other").alias("b")
    on = (F.col("a.table") == F.col("b.table")) & (F.col("a.block_key") == F.col("b.block_key"))
    near = (F.bit_count(differ) <= radius) & (agreed == F.col("a.table"))
    # Both sides grow with the documents: never broadcast, whatever the estimate.
    return a.join(b.hint("merge"), on & near).select("fp", "other", F.bit_count(differ).alias("distance"))


def near_counts(found: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """For the documents whose id is divisible by ``every``: ``fp, near_docs``,
    the number of documents (copies counted, itself too) within the radius.

    ``found`` has a row per document with ``doc_id`` and ``fp``; fingerprints
    are searched once each, however many documents share them.
    """
    sizes = found.groupBy("fp").agg(F.count(F.lit(1)).alias("docs"))
    queries = found.where(F.col("doc_id") % every == 0).select("fp").distinct()
    pairs = within_radius(queries, sizes.select("fp"), radius)
    return pairs.join(sizes.withColumnRenamed("fp", "other").hint("merge"), "other").groupBy("fp").agg(F.sum("docs").alias("near_docs"))
