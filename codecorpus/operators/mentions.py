"""C12 and J5 as a relation: which of many names occur in which of many texts.

A multi-pattern substring join.  Every name is indexed by its rarest q-gram
(the one in fewest texts; names shorter than ``Q`` by all their characters).
A text emits each of its distinct q-grams once; these meet the index in the
stage that made them, and a hit is verified with ``contains`` on the text at
hand, which then goes no further.  The index is broadcast in blocks of bounded
size; texts are never shuffled, so a name in a third of all texts costs what
its result rows cost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus.functions.text import character_runs
from codecorpus.session import checkpoint

Q = 4
BLOCK_BYTES = 16 << 20


def _grams(text: Column, lengths: list[int]) -> Column:
    """Hashes of the distinct character runs of these lengths."""
    return F.array_distinct(F.concat(*[F.transform(character_runs(text, k), lambda g: F.xxhash64(g)) for k in lengths]))


def rarest_grams(names: DataFrame, texts: DataFrame, q: int = Q, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``name, gram`` of the distinct names (at least one character): the
    gram's number of texts is the least among the name's grams (ties: by hash)."""
    own = names.where(F.length("name") > 0).select("name").distinct()
    own = own.withColumn("k", F.least(F.length("name"), F.lit(q)))
    lengths = sorted(r.k for r in own.select("k").distinct().collect())  # at most q different ones
    if not lengths:
        return own.select("name", F.lit(0).cast("long").alias("gram"), "k").where(F.lit(False))
    grams = F.coalesce(*[F.when(F.col("k") == k, _grams(F.col("name"), [k])) for k in lengths])
    of_names = own.select("name", "k", F.explode_outer(grams).alias("gram"))
    of_names = checkpoint(of_names)
    wanted = of_names.select("gram").distinct()
    seen = texts.select(_grams(F.col("text"), lengths).alias("g")).select(F.explode_outer("g").alias("gram"))
    blocks = max(1, -(-wanted.count() * 64 // block_bytes))
    counts = [seen.join(F.broadcast(wanted.where(F.pmod("gram", F.lit(blocks)) == b)), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
              for b in range(blocks)]
    ranked = of_names.join(reduce(DataFrame.unionByName, counts), "gram", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))
    return ranked.groupBy("name", "k").agg(least.alias("r")).select("name", F.col("r.gram").alias("gram"), "k")


def mentions(names: DataFrame, texts: DataFrame, keys: list[str], q: int = Q, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``name`` and ``keys`` (columns of ``texts``) of every row of ``texts``
    whose ``text`` contains the name, for the distinct ``name`` of ``names``.

    Case counts, as in ``LIKE``.  Null texts hold nothing; null names occur
    nowhere, and neither does the empty name here.  Rows of ``texts`` stay rows
    of their own, whatever their keys.
    """
    index = checkpoint(rarest_grams(names, texts, q, block_bytes))
    facts = index.agg(F.sum(F.octet_length("name") + 64).alias("bytes"), F.collect_set("k").alias("lengths")).first()
    blocks = max(1, -(-(facts["bytes"] or 0) // block_bytes))
    lengths = sorted(facts["lengths"]) or [q]
    known = texts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "text")
    kept = [f"_key_{k}" for k in keys] + ["text"]
    # "outer" keeps Spark from filtering on the array's size, which would make it twice.
    seen = known.select(*kept, _grams(F.col("text"), lengths).alias("_g")).select(*kept, F.explode_outer("_g").alias("gram"))
    parts = [seen.join(F.broadcast(index.where(F.pmod("gram", F.lit(blocks)) == b).select("name", "gram")), "gram")
             .where(F.contains("text", F.col("name"))) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    return found.select("name", *[F.col(f"_key_{k}").alias(k) for k in keys])


def generation_status(runs: DataFrame, texts: DataFrame, q: int = Q) -> DataFrame:
    """``runs(key, exit_code, func_name)`` with ``n_mentions`` (texts that
    mention the function, C12) and ``generate_status``: exit code 0 and at
    least one mention.  Every run keeps its row."""
    found = mentions(runs.select(F.col("func_name").alias("name")), texts, [], q).groupBy("name").agg(F.count(F.lit(1)).alias("n_mentions"))
    j = runs.join(found, F.col("func_name") == F.col("name"), "left").drop("name").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0).cast("long")))
    return j.withColumn("generate_status", (F.col("exit_code") == 0) & (F.col("n_mentions") > 0))
