"""Benchmark decontamination: a broadcast hash set of test n-grams.

The windows of the benchmark (``WINDOW`` consecutive words of an item; all
words of a shorter item) are few: their distinct texts, with a hash, are
broadcast.  Beyond ``BLOCK_BYTES`` they are dealt by hash into blocks of at
most about that size, and the documents are scanned once a block, so what is
broadcast never grows with the benchmark.

A document's words give one hash per window length and position.  These go
through the hash set in the same stage that made them; a hit is verified on
the words themselves there, and only verified hits are shuffled.  One marker
row a document carries its word count, so the texts are read and split once.

Items are told by item sets: windows that occur in the same items share a set
id, hits carry that id, and documents with the same set ids share one list of
items.  So a passage of very many items or documents is never multiplied out.

Everything runs as DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import alnum_words, cut

WINDOW = 10
#: Bytes of window texts that are broadcast at once, and what a row adds to them.
BLOCK_BYTES = 32 << 20
ROW_BYTES = 96

#: A word with the separators behind it (the first also with those before it).
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_PIECE = f"(?:^[{_BETWEEN}]*)?[^{_BETWEEN}]+[{_BETWEEN}]*"


def _starts(n: Column, length: int) -> Column:
    """1-based starts of the windows of ``length`` among ``n`` words."""
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``hash, gram, length, items, item_set`` of the distinct windows of all items.

    ``items``: ids of the items that hold the window, in order (null ids are
    none).  Items without words have no window; repeated items count once.
    """
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n", F.size("words"))
    whole = F.when(F.col("n") < size, F.array("words")).otherwise(
        F.transform(_starts(F.col("n"), size), lambda i: F.slice("words", i, size)))
    grams = items.select("item_id", F.explode(whole).alias("window"))
    per = grams.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return per.select(F.xxhash64("window").alias("hash"), F.array_join("window", " ").alias("gram"),
                      F.size("window").alias("length"), "items", F.sha2(F.array_join("items", ","), 256).alias("item_set"))


def _hits(tokens: DataFrame, block: DataFrame, lengths: list[int], markers: bool) -> DataFrame:
    """``doc_id, text_hash, n_words, start, length, item_set`` of the verified
    hits of one block, and a row without start per document (``markers``)."""
    n, words = F.col("n_words"), F.col("words")

    def hashed_windows(k: int) -> Column:
        return F.transform(_starts(n, k), lambda i: F.xxhash64(F.slice(words, i, k)))

    marker = F.array(F.lit(None).cast("long"))
    hashed = tokens.select("doc_id", "text_hash", "n_words", "words", F.concat(marker, *map(hashed_windows, lengths)).alias("hashes"))
    # The array is never empty; "outer" keeps Spark from filtering on its size, which would make it twice.
    spread = hashed.select("doc_id", "text_hash", "n_words", "words", F.posexplode_outer("hashes").alias("at", "hash"))
    met = spread.join(F.broadcast(block.select("hash", "gram", "length", "item_set")), "hash", "left")
    # Windows stand by length, so those of shorter ones come before.
    before = reduce(lambda a, k: a + F.when(F.col("length") > k, F.greatest(n - (k - 1), F.lit(0))).otherwise(0), lengths, F.lit(0))
    start = F.col("at") - 1 - before
    same = F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.coalesce("length", F.lit(0))), " ") == F.col("gram")
    kept = met.where((F.lit(markers) & (F.col("at") == 0)) | (F.col("gram").isNotNull() & (start >= 0) & same))
    return kept.select("doc_id", "text_hash", "n_words", F.when(F.col("at") > 0, start).alias("start"), "length", "item_set")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_hit, n_items,
    items_sha256, spans, contaminated``.

    A word inside any occurrence of a window is hit; ``spans`` are the maximal
    runs of hit words (``start``, ``end``, half open, in words).  ``n_items``
    and ``items_sha256`` are about the items whose windows occur: the hash is
    of their ids, sorted as strings and joined by commas.  Null and empty texts
    have no words; null item ids mark hits but are no items; rows of equal id
    and text get equal results; an empty benchmark contaminates nothing; an
    empty table gives an empty result.
    """
    grams = cut(windows(benchmark, size))
    facts = grams.agg(F.sum(F.octet_length("gram") + ROW_BYTES).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    blocks = max(1, -(-(facts["bytes"] or 0) // block_bytes))
    lengths = sorted(facts["lengths"])  # at most ``size`` different ones
    tokens = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    tokens = tokens.select("doc_id", "text_hash", F.size("words").alias("n_words"), "words")
    parts = [_hits(tokens, grams.where(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else grams, lengths, b == 0)
             for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    word_span = F.when(F.col("start").isNotNull(), F.struct("start", "length"))
    per = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("start").isNull()).alias("copies"), F.collect_set(word_span).alias("hits"),
        F.sort_array(F.collect_set("item_set")).alias("sets"))
    per = per.withColumn("covered", F.sort_array(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))))
    c, size_of = F.col("covered"), F.size("covered")
    first = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) != x - 1))
    last = F.filter(c, lambda x, i: (i == size_of - 1) | (F.get(c, i + 1) != x + 1))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    per = cut(per.select("doc_id", "text_hash", "n_words", "copies", "sets", size_of.alias("n_hit"), spans.alias("spans"),
                         F.xxhash64("sets").alias("set_hash")))
    # Items of each combination of sets, once however many documents have it.
    of_set = grams.select("item_set", "items").dropDuplicates(["item_set"])
    combos = per.where("n_hit > 0").select("set_hash", "sets").distinct()
    listed = (combos.select("set_hash", "sets", F.explode("sets").alias("item_set")).join(of_set, "item_set")
              .groupBy("set_hash", "sets").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    listed = listed.select("set_hash", "sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(
        F.sort_array(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"))
    dirty = per.where("n_hit > 0").join(listed.hint("merge"), ["set_hash", "sets"])
    clean = per.where("n_hit = 0").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    rows = dirty.unionByName(clean).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
                       "n_items", "items_sha256", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def pieces(text: Column) -> Column:
    """The words of a text as they stand, each with the separators behind it."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def without_spans(parts: Column, spans: Column) -> Column:
    """A text, given as its ``pieces``, without the words in ``spans``
    (ascending, half open) and the separators behind them."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(parts)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), "")), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark holds: ``remove`` is "spans" (hit
    words go, the document stays) or "documents" (documents with a hit go).
    Rows without a hit are unchanged, null texts among them."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    dirty = scan(docs, benchmark, size).where("contaminated").select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    right = dirty.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "spans").hint("merge")
    on = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
    if remove == "documents":
        return left.join(right, on, "left_anti").select("_row.*")
    text, hit = F.col("_row.text"), F.col("spans").isNotNull()
    cleaned = F.when(hit, without_spans(F.col("_pieces"), F.col("spans"))).otherwise(text)
    both = left.join(right, on, "left").withColumn("_pieces", F.when(hit, pieces(text)))
    return both.select(*[cleaned.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
