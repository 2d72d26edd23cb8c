"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codecorpus.session import checkpoint, ensure_checkpoint_dir, ship_library

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_held: list = []


def hold(cache) -> None:
    """Make ``cache`` the one that this Python worker keeps.

    Spark hands a worker on from stage to stage, so what every operator has
    kept would add up: the one held before is told to ``forget`` its entries.
    """
    if _held and _held[0] is not cache:
        _held.pop().forget()
    if not _held:
        _held.append(cache)


class WordCache(dict):
    """Values of words in a Python worker, worked out when they are first asked for.

    Bounded in bytes (``limit``; an entry counts its word's length and
    ``entry``), in two halves: ``bound`` puts a full newer half in the place of
    the older one, and words of that which are met again move over, so frequent
    words are never forgotten while the worker holds this cache (``hold``).
    """

    def __init__(self, make, limit: int, entry: int):
        self.make, self.limit, self.entry = make, limit, entry
        self.older: dict = {}
        self.size = 0

    def __missing__(self, word):
        own = self.older.get(word)
        if own is None:
            own = self.make(word)
        self[word] = own
        self.size += len(word) + self.entry
        return own

    def forget(self) -> None:
        self.clear()
        self.older, self.size = {}, 0

    def bound(self) -> None:
        hold(self)
        if 2 * self.size > self.limit:
            self.older = dict(self)
            self.clear()
            self.size = 0


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder of the session, and the package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_library(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there."""
    return checkpoint(df)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans made inside send at most ``rows`` rows at a time to Python, where
    a row holds whole texts and the session's own limit may be 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What names a row: its id (0 for null), whether that is null, and the hash of its text.
ROW_KEY = ["_id", "_none", "_hash"]


def row_key(text_hash: Column) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), text_hash.alias("_hash")]


def numbered(rows: DataFrame) -> DataFrame:
    """``_nth``: a number among rows of equal key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("_hash")))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """Every row as ``_row`` with its key and number.  A join on the key needs
    no further shuffle of the rows."""
    return numbered(docs.select(F.struct(*docs.columns).alias("_row"), *row_key(F.xxhash64("text"))))


def rows_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``picked(doc_id, text_hash)``, each as
    often as it is picked."""
    counts = picked.select(*row_key(F.col("text_hash"))).groupBy(*ROW_KEY).agg(F.count(F.lit(1)).alias("_picked"))
    return keyed_rows(docs).join(counts, ROW_KEY).where("_nth <= _picked").select("_row.*")


#: Words of letters, digits and everything beyond ASCII, in lower-cased text.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum_words(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased (null: none)."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(ALNUM), F.lit(0))
