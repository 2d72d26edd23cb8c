"""Results written in batches, with a manifest.

A row belongs to the batch that its keys hash to.  Every batch is written to a
folder of its own, replacing what a failed attempt left there; its manifest
entry (one small file with the batch's number and row count) is written last.
A restart reads the manifest, not the rows, and does the batches that have no
entry; a reader takes the folders that have one.  So a job may end anywhere:
no row is lost and none comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch int, batches int, n long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``batch, batches, n`` of the finished batches (no rows before the first)."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def batch_of(keys: list[str], batches: int):
    """The batch of a row: keys that are null count as a value of their own."""
    return F.pmod(F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))]), F.lit(batches)).cast("int")


def write_batches(df: DataFrame, keys: list[str], path: str, batches: int, process: Callable[[DataFrame], DataFrame] | None = None,
                  stop_after: int | None = None) -> list[int]:
    """Write ``process(rows)`` of every batch that the manifest does not list;
    the numbers of the batches written.

    ``batches`` must be that of the first call (a manifest of another number is
    an error).  ``process`` sees one batch at a time, whole; the input is
    filtered once a batch, so batches are for work that costs more than its
    scan.  ``stop_after``: end after so many batches, as a job that is killed.
    """
    spark = df.sparkSession
    done = {r.batch: r.batches for r in manifest(spark, path).collect()}  # one row a batch
    if any(n != batches for n in done.values()):
        raise ValueError("the batches under this path were cut differently")
    written = []
    for b in range(batches):
        if b in done:
            continue
        if stop_after is not None and len(written) >= stop_after:
            break
        rows = df.where(batch_of(keys, batches) == b)
        (process(rows) if process else rows).write.mode("overwrite").parquet(f"{path}/data/{b}")
        n = spark.read.parquet(f"{path}/data/{b}").count()
        spark.createDataFrame([(b, batches, n)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{b}")
        written.append(b)
    return written


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches.  A folder without an entry (its job
    ended before the entry was written) is not read."""
    done = sorted(r.batch for r in manifest(spark, path).collect())
    if not done:
        raise ValueError("no batch is finished under this path")
    return spark.read.parquet(*[f"{path}/data/{b}" for b in done])
