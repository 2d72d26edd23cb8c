"""JSON arrays of objects whose fields differ, as VARIANT columns.

A folder per group (a project) holds files of JSON arrays, one a line.  An array
has at most ``ROWS`` objects, so no group is collected whole however large it is.
Files are read as VARIANT values: objects keep the fields they have, no schema
is fixed or merged beforehand, and a field is asked for by its path and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Objects of one array, at most.
ROWS = 1000


def write_json_arrays(df: DataFrame, path: str, by: str, rows: int = ROWS) -> None:
    """A5: the rows of each ``by`` value as JSON arrays (null fields are left
    out), in folders ``by=value``.  An array holds what a run of ``rows``
    consecutive rows of a task has of a group, so a group of very many rows is
    many arrays, made by many tasks."""
    objects = df.select(by, F.to_json(F.struct(*[c for c in df.columns if c != by])).alias("_object"))
    run = F.floor(F.monotonically_increasing_id() / rows)
    arrays = objects.groupBy(by, run.alias("_run")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("_object")), F.lit("]")).alias("value"))
    arrays.select(by, "value").write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One row per element of the JSON arrays below ``path`` (a file of
    one object is its only element) as ``item`` VARIANT, with the folders'
    columns.  A file holds one array a line; malformed lines give no row."""
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*folders, F.try_parse_json("value").alias("v"))
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    elements = F.when(is_array, F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return parsed.where("v IS NOT NULL").select(*folders, F.explode_outer(elements).alias("item")).where("item IS NOT NULL")


def fields(items: DataFrame) -> str:
    """The merged type of all elements, as DDL."""
    return items.agg(F.schema_of_variant_agg("item").alias("s")).first()["s"]


def field(name: str, kind: str = "string") -> Column:
    """A field of ``item`` as ``kind``; null where an element has none or one of another kind."""
    return F.try_variant_get("item", f"$.{name}", kind).alias(name)
