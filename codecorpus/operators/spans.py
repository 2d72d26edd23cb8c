"""The span job (D*): files in, one row per declaration / comment out.

``extract_spans`` runs the scanner once per file inside ``mapInArrow``; only
``(key, text)`` enters the Python worker and only span coordinates come out,
so file text never travels through a shuffle here.  Everything downstream is
relational: joins on the file key, windows over spans of one file, and
``substring`` to cut text.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus.operators.scanner import scan

PARAM = T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType())])
SPAN_FIELDS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("kw_start", T.IntegerType()),
    T.StructField("body_start", T.IntegerType()),
    T.StructField("body_end", T.IntegerType()),
    T.StructField("parent_ord", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("modifiers", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("params", T.ArrayType(PARAM)),
    T.StructField("bases", T.ArrayType(T.StringType())),
    T.StructField("interfaces", T.ArrayType(T.StringType())),
    T.StructField("n_statements", T.IntegerType()),
    T.StructField("head_end", T.IntegerType()),
    T.StructField("gap_end", T.IntegerType()),
])
_ARROW = pa.schema([
    ("kind", pa.string()), ("name", pa.string()), ("ord", pa.int32()), ("start", pa.int32()),
    ("end", pa.int32()), ("kw_start", pa.int32()), ("body_start", pa.int32()),
    ("body_end", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()),
    ("visibility", pa.string()), ("modifiers", pa.string()), ("type", pa.string()),
    ("params", pa.list_(pa.struct([("type", pa.string()), ("name", pa.string())]))),
    ("bases", pa.list_(pa.string())), ("interfaces", pa.list_(pa.string())),
    ("n_statements", pa.int32()), ("head_end", pa.int32()), ("gap_end", pa.int32()),
])


SPAN = T.StructType(list(SPAN_FIELDS.fields))
_ARROW_SPAN = pa.struct(list(_ARROW))


#: Bytes of text that are scanned at once (a longer text is scanned alone).
PIECE_BYTES = 256 * 1024


def _pieces(rb, text_col, piece_bytes):
    """Slices of a batch of at most ``piece_bytes`` of text, one row at least."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(rb.column(text_col)).to_pylist()):
        if i > start and size + (n or 0) > piece_bytes:
            yield rb.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if rb.num_rows > start:
        yield rb.slice(start)


def _scan_batches(text_col, lang, body_tokens, piece_bytes=PIECE_BYTES):
    """A text's spans take many times its bytes as Python objects, so a batch
    is scanned in pieces and every piece's spans leave the worker as a batch of
    their own: memory follows the piece, not Arrow's batch size."""
    fields = list(_ARROW)
    names = [f.name for f in fields]

    def run(batches):
        for rb in batches:
            for piece in _pieces(rb, text_col, piece_bytes):
                yield scanned(piece)

    def scanned(rb):
        offsets, valid, cols = [0], [], {n: [] for n in names}
        for t in rb.column(text_col).to_pylist():
            if t is None:
                offsets.append(offsets[-1])
                valid.append(False)
                continue
            ss = scan(t, lang, body_tokens)
            for n in names:  # column-wise: Arrow converts flat lists in C
                cols[n].extend([x[n] for x in ss])
            offsets.append(offsets[-1] + len(ss))
            valid.append(True)
        struct = pa.StructArray.from_arrays([pa.array(cols[f.name], f.type) for f in fields],
                                            fields=fields)
        mask = pa.array([not v for v in valid])
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct, mask=mask)
        return pa.RecordBatch.from_arrays(list(rb.columns) + [spans],
                                          names=list(rb.schema.names) + ["spans"])

    return run


def scan_files(files: DataFrame, text: str = "source_code", lang: str = "java",
               body_tokens: bool = False, partitions: int | None = None) -> DataFrame:
    """D-job: every input column plus ``spans: array<span>`` ordered by ``ord``.

    ``spans[ord]`` (``element_at(spans, ord + 1)``) is the span with that
    ord, so parent lookups and containment tests are array expressions on
    the same row: per-file work needs no join and no shuffle.  Span fields:
    kind, name, ord, start, end, kw_start, body_start, body_end, parent_ord,
    depth, visibility, modifiers, type, params, bases, interfaces,
    n_statements; offsets are 0-based, half-open code points of ``text``;
    bodies exclude braces.  ``body_tokens`` adds call / local / ident spans.
    ``partitions`` spreads the input first; unset, the input's own splits stay
    (``balance`` spreads a table read from a few files).
    """
    from codecorpus.session import ship_library
    ship_library(files.sparkSession)
    out = T.StructType(list(files.schema.fields) + [T.StructField("spans", T.ArrayType(SPAN))])
    if partitions:
        files = files.repartition(partitions)
    return files.mapInArrow(_scan_batches(text, lang, body_tokens), out)


def balance(df: DataFrame, partitions: int | None = None, by: list[str] = ()) -> DataFrame:
    """Spread a table read from fewer files than ``partitions`` (default: 2 per
    core) over that many tasks; scans are CPU-bound, and a file may be a single
    row group.  Decided from the file list alone: no job, and nothing built on
    other inputs is moved.  Rows that are equal in ``by`` stay in one task."""
    target = partitions or 2 * df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(target, *by) if 0 < files < target else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows that come out of a shuffle to ``partitions`` tasks (default: 2
    per core) before costly work on each: AQE merges shuffle partitions by their
    compressed bytes, which for small or alike rows leaves a few tasks only.  A
    number that is asked for stays as it is."""
    return df.repartition(partitions or 2 * df.sparkSession.sparkContext.defaultParallelism)


def materialize(df: DataFrame, row: str | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage (reliable checkpoint in the
    cluster's checkpoint folder), for a scanned table that feeds several
    branches of a plan: without it each branch would re-run the scan.

    ``row`` names a column that tells the rows apart, also those of repeated
    keys: a row's place in the checkpoint, so the same in every branch."""
    from codecorpus.session import checkpoint
    kept = checkpoint(df)
    return kept.withColumn(row, F.monotonically_increasing_id()) if row else kept


def extract_spans(files: DataFrame, keys: list[str] | str, text: str = "source_code",
                  lang: str = "java", body_tokens: bool = False) -> DataFrame:
    """Flat span table: ``keys`` + one row per span (for cross-file work)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    scanned = scan_files(files.select(*keys, text), text, lang, body_tokens)
    return scanned.select(*keys, F.inline("spans"))


# ---------------------------------------------------------------------------
# Relational views
# ---------------------------------------------------------------------------

def members(spans: DataFrame, keys: list[str], container_kind: str,
            member_kinds: list[str], container_types: list[str] | None = None) -> DataFrame:
    """Members with their direct container on a *flat* span table (e.g. spans
    from another tool): child -> parent equi-join on (file keys, parent_ord =
    ord), so spans of different files are never paired.  Scanned tables do
    the same lookup with ``element_at(spans, parent_ord + 1)`` instead.
    """
    c = spans.where(F.col("kind") == container_kind)
    if container_types:
        c = c.where(F.col("type").isin(container_types))
    c = c.select(*keys, F.col("ord").alias("parent_ord"), F.col("name").alias("container"),
                 F.col("start").alias("c_start"), F.col("end").alias("c_end"),
                 F.col("kw_start").alias("c_kw_start"), F.col("type").alias("c_type"),
                 F.col("bases").alias("c_bases"), F.col("parent_ord").alias("c_parent"))
    m = spans.where(F.col("kind").isin(member_kinds))
    return m.join(c, [*keys, "parent_ord"], "inner")
