"""Removing repeated strings with a distributed, sparse suffix array.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller document id, or same document and earlier start) is removed.

Suffixes are kept at anchors only.  The anchor of a window of ``length`` bytes
is its ``GRAM``-byte string of smallest hash (the leftmost), so equal windows
have equal anchors at equal distance.  A run of window starts with one anchor
is a segment; its suffix starts with two 64-bit tokens, the hash of the anchor
and that of all bytes of its windows.  Suffixes are range-partitioned by their
leading tokens, document and start, with sampled splitters, so that a string
shared by a third of all documents is spread over many buckets.  Each bucket
sorts by multikey quicksort; neighbours with equal tokens cover equal windows,
and all but the first are repeated.  First and last entries are compared
across bucket boundaries.

Segments that share an anchor but differ (at the edges of a repeat) are
resolved on their bytes: all their windows are cut out of the texts and sorted
the same way, by anchor and then by eight bytes at a time.  Anchors with many
such segments are dealt out by window instead, and go through the buckets
again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import cut, default_partitions, shared_path

LENGTH = 100
GRAM = 32
#: Differing segments of one anchor that are resolved in one task (under 1 MB).
TOGETHER = 4096
#: Below this many rows, multikey quicksort leaves the rest to a plain sort.
SMALL = 1024

_RANDOM = np.random.Generator(np.random.PCG64(11))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order that sorts rows by ``columns``: three-way partition on the first
    differing column, the equal part goes on with the next."""
    order = np.arange(len(columns[0]))
    stack = [(0, len(order), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == len(columns):
            continue
        part = order[low:high]
        if high - low <= SMALL:
            order[low:high] = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            continue
        key = columns[depth][part]
        pivot = np.sort(key[::max(1, len(key) // 101)])[50 if len(key) > 101 else len(key) // 2]
        less, same = key < pivot, key == pivot
        parts = part[less], part[same], part[~(less | same)]
        order[low:high] = np.concatenate(parts)
        a, b = low + len(parts[0]), low + len(parts[0]) + len(parts[1])
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _hashes(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of ``GRAM`` and of ``length`` bytes, by doubling."""
    def joined(h: np.ndarray, step: int, level: int) -> np.ndarray:
        t = h[:len(h) - step] * _ODD[level] + h[step:]
        return t ^ (t >> np.uint64(29))

    out, h, size, level = {}, _BYTE[data], 1, 0
    while True:
        for wanted in (GRAM, length):
            if size == wanted:
                out[wanted] = h
            elif size < wanted < 2 * size:
                out[wanted] = joined(h, wanted - size, 8 + level)
        if 2 * size > length:
            return out
        h, size, level = joined(h, size, level), 2 * size, level + 1


def segments(data: bytes, length: int = LENGTH):
    """Segments of a text: (anchor hash, content hash, first window start,
    further window starts, distance of the anchor from the first), or None."""
    if len(data) < length:
        return None
    with np.errstate(over="ignore"):
        hashes = _hashes(np.frombuffer(data, np.uint8), length)
        gram, whole, width = _mix(hashes[GRAM]), hashes[length], length - GRAM + 1
        least = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < width:
            least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        content = _mix(whole[first] * _ODD[14] + whole[last] + (last - first).astype(np.uint64) * _ODD[15])
        return gram[at[first]], content, first, last - first, at[first] - first


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals of equal length order: touching intervals of one
    owner become one.  Rows are sorted by owner and start, ends do not fall."""
    if not len(start):
        return owner, start, end
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > end[:-1])]
    first = np.flatnonzero(fresh)
    return owner[first], start[first], end[np.r_[first[1:], len(start)] - 1]


SUFFIX = ["kind", "gram", "content", "d", "tie", "at", "end"]
SUFFIX_DDL = "kind int, gram long, content long, d long, tie long, at long, end long"
SEGMENT, MARK, OPEN, HEAD, TAIL = range(5)


def _rows(kind, gram, content, d, tie, at, end) -> pa.RecordBatch:
    n = len(d)
    fill = lambda x: x if isinstance(x, np.ndarray) else np.full(n, x)
    arrays = [pa.array(fill(kind).astype(np.int32))] + [pa.array(fill(x).astype(np.int64, copy=False)) for x in (gram, content, d, tie, at, end)]
    return pa.RecordBatch.from_arrays(arrays, SUFFIX)


def _suffixes(length: int):
    """Suffixes of a partition's documents (in order of id).  Copies inside an
    Arrow batch are settled here: only the first of equal segments goes on, the
    others are marked as repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, tie = (np.asarray(b.column(i)) for i in (0, 1))
            parts, owner = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                found = segments(text.encode(), length)
                if found:
                    parts.append(found)
                    owner.append(np.full(len(found[0]), i))
            if not parts:
                continue
            gram, content, first, more, lead = (np.concatenate([p[k] for p in parts]) for k in range(5))
            gram, content, owner = gram.view(np.int64), content.view(np.int64), np.concatenate(owner)
            order = np.lexsort((content, gram))  # stable: documents stay in order
            again = np.zeros(len(order), bool)
            again[order[1:]] = (gram[order][1:] == gram[order][:-1]) & (content[order][1:] == content[order][:-1])
            keep = ~again
            yield _rows(SEGMENT, gram[keep], content[keep], d[owner[keep]], tie[owner[keep]],
                        first[keep] << 16 | more[keep] << 8 | lead[keep], 0)
            own, start, end = merged(owner[again], first[again], first[again] + more[again] + length)
            if len(own):
                spread = _mix(own.astype(np.uint64) + start.astype(np.uint64)).view(np.int64)
                yield _rows(MARK, spread, 0, d[own], tie[own], start, end)
    return run


def _sorted_bucket(length: int):
    """One bucket: repeated suffixes as marks, the others of shared anchors as
    open, and the bucket's first and last suffix for the comparison across
    boundaries.  What is only passed through (marks) stays as it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = []
        for b in batches:
            kind = np.asarray(b.column("kind"))
            if (kind == MARK).any():
                yield b.filter(pa.array(kind == MARK))
            held.append([np.asarray(b.column(i))[kind == SEGMENT] for i in range(1, 6)])
        if not sum(len(h[0]) for h in held):
            return
        gram, content, d, tie, at = (np.concatenate([h[k] for h in held]) for k in range(5))
        held.clear()
        order = multikey_quicksort([gram, content, d, tie, at])
        gram, content, d, tie, at = (x[order] for x in (gram, content, d, tie, at))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, content[1:] != content[:-1]]
        start, more = at >> 16, (at >> 8) & 255
        rest = ~new
        yield _rows(MARK, 0, 0, d[rest], tie[rest], start[rest], start[rest] + more[rest] + length)
        run_of = np.cumsum(new_gram) - 1
        variants = np.bincount(run_of, weights=new)
        shared = (variants > 1)[run_of]
        shared |= (run_of == 0) | (run_of == run_of[-1])  # may go on in a neighbouring bucket
        opened = new & shared
        yield _rows(OPEN, gram[opened], content[opened], d[opened], tie[opened], at[opened], 0)
        part = TaskContext.get().partitionId()
        yield _rows(HEAD, gram[:1], content[:1], d[:1], tie[:1], at[:1], part)
        yield _rows(TAIL, gram[-1:], content[-1:], d[-1:], tie[-1:], at[-1:], part)
    return run


def buckets(suffixes: DataFrame, partitions: int, length: int) -> tuple[DataFrame, DataFrame]:
    """(marks, open) of range-partitioned, sorted suffixes.

    A bucket's head that equals the tail of the bucket before it is repeated too.
    """
    path = shared_path(suffixes.sparkSession, "suffix-buckets")
    dealt = suffixes.repartitionByRange(partitions, "gram", "content", "d", "tie", "at")
    dealt.mapInArrow(_sorted_bucket(length), SUFFIX_DDL).write.parquet(path)
    found = suffixes.sparkSession.read.parquet(path)
    w = Window.orderBy("end", "kind")  # two rows a bucket
    edges = found.where(F.col("kind").isin(HEAD, TAIL)).withColumn("before", F.lag(F.struct("gram", "content")).over(w))
    heads = edges.where((F.col("kind") == HEAD) & (F.col("before.gram") == F.col("gram")) & (F.col("before.content") == F.col("content")))
    start = F.shiftright("at", 16)
    crossed = heads.select("d", "tie", start.alias("start"), (start + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + length).alias("end"))
    marks = found.where(F.col("kind") == MARK).select("d", "tie", F.col("at").alias("start"), "end").unionByName(crossed)
    return marks, found.where(F.col("kind") == OPEN).select("gram", "d", "tie", "at")


# -- differing segments of one anchor -----------------------------------------

OPEN_DDL = "gram long, d long, tie long, at long, bytes binary"


def _cut_out(length: int):
    """Bytes of the open segments of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "d", "tie", "at", "bytes"]
        for b in batches:
            for i in range(b.num_rows):
                data, wanted = b.column("text")[i].as_py().encode(), b.column("wanted")[i].as_py()
                d, tie = b.column("d")[i].as_py(), b.column("tie")[i].as_py()
                at = [w["at"] for w in wanted]
                parts = [data[x >> 16:(x >> 16) + (x >> 8 & 255) + length] for x in at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([w["gram"] for w in wanted], pa.int64()), pa.array([d] * len(at), pa.int64()),
                    pa.array([tie] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(parts, pa.binary())], names)
    return run


def _windows_sorted(length: int):
    """All windows of a partition's open segments (those of an anchor are
    together), sorted by anchor and bytes: repeated ones as intervals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(b.column(i)) for i in range(4)] + [b.column(4).to_pylist()] for b in batches]
        held = [h for h in held if len(h[0])]
        if not held:
            return
        gram, d, tie, at = (np.concatenate([h[k] for h in held]) for k in range(4))
        parts = [x for h in held for x in h[4]]
        held.clear()
        start, more, lead = at >> 16, (at >> 8) & 255, at & 255
        base = np.cumsum(np.r_[0, [len(p) for p in parts[:-1]]])
        data = np.frombuffer(b"".join(parts), np.uint8)
        del parts
        padded = -(-length // 8) * 8
        rows, starts = [], []
        for left in range(int(lead.max()) + 1):
            off = lead - left
            has = np.flatnonzero((off >= 0) & (off <= more))
            if len(has) < 2:
                continue
            window = np.zeros((len(has), padded), np.uint8)
            window[:, :length] = data[(base[has] + off[has])[:, None] + np.arange(length)]
            tokens = window.view(">u8").astype(np.uint64)
            columns = [gram[has], *(tokens[:, k] for k in range(tokens.shape[1])), d[has], tie[has], start[has]]
            order = multikey_quicksort(columns)
            g, t = gram[has][order], tokens[order]
            same = np.r_[False, (g[1:] == g[:-1]) & (t[1:] == t[:-1]).all(1)]
            again = has[order[same]]
            rows.append(again)
            starts.append(start[again] + off[again])
        if rows:
            rows, starts = np.concatenate(rows), np.concatenate(starts)
            order = np.lexsort((starts, rows))
            own, first, end = merged(rows[order], starts[order], starts[order] + length)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d[own], tie[own], first, end)], ["d", "tie", "start", "end"])
    return run


def _window_suffixes(length: int):
    """Every window of the open segments as a suffix of its own, with two tokens from its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000).to_pylist()
                rows = []
                for r in part:
                    start = r["at"] >> 16
                    for k in range(len(r["bytes"]) - length + 1):
                        token = xxhash.xxh3_128_intdigest(r["bytes"][k:k + length])
                        rows.append(((token >> 64) - (1 << 63), (token & ((1 << 64) - 1)) - (1 << 63), r["d"], r["tie"], (start + k) << 16))
                if rows:
                    columns = [np.array(c, np.int64) for c in zip(*rows)]
                    yield _rows(SEGMENT, *columns, 0)
    return run


RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                out = []
                for r in b.slice(at, 512).to_pylist():
                    data, spans, pieces, done, removed = r["text"].encode(), 0, [], 0, 0
                    for start, end in sorted((x["start"], x["end"]) for x in r["spans"] or ()):
                        if start > done or not spans:
                            spans += 1
                            pieces.append(data[done:start])
                            removed += end - start
                            done = end
                        elif end > done:
                            removed += end - done
                            done = end
                    pieces.append(data[done:])
                    kept = b"".join(pieces)
                    out.append({"doc_id": r["doc_id"], "n_bytes": len(data), "n_removed": removed, "n_spans": spans,
                                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_bytes else None})
                yield pa.RecordBatch.from_pylist(out, RESULT)
    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, partitions: int | None = None, with_bytes: bool = False,
                   together: int = TOGETHER) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (the kept bytes if ``with_bytes``).

    Texts are taken as UTF-8 (null: empty), matches never cross documents, and
    strings are judged on the input.  ``length`` is at least ``GRAM`` and at
    most 250.  Null ids come last.  Where ids repeat, documents of one id are
    ordered by a hash of their text; rows equal in id and text are one document
    and get equal results.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    partitions = partitions or default_partitions(spark)
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    # Ids that are unique need no second key.
    tie = F.lit(0).cast("long") if ids.n == ids.ids else F.xxhash64("text")
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), tie.alias("tie"),
                        F.coalesce("text", F.lit("")).alias("text"))
    # Same columns as the last join, so that both share one exchange of the texts.
    read = texts if ids.n == ids.ids else texts.dropDuplicates(["d", "tie"])
    suffixes = read.select("d", "tie", "text").sortWithinPartitions("d", "tie").mapInArrow(_suffixes(length), SUFFIX_DDL)
    marks, opened = buckets(suffixes, partitions, length)
    # Written first, so that the join below can split a frequent anchor.
    sizes = cut(opened.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    opened = cut(opened.join(sizes, "gram"))
    lists = opened.groupBy("d", "tie").agg(F.collect_list(F.struct("gram", "at", "n")).alias("all"))

    def cut_out(which) -> DataFrame:
        wanted = lists.select("d", "tie", F.filter("all", which).alias("wanted")).where(F.size("wanted") > 0)
        return read.join(wanted, ["d", "tie"]).mapInArrow(_cut_out(length), OPEN_DDL)

    few = cut_out(lambda x: x["n"] <= together).repartition(partitions, "gram").mapInArrow(
        _windows_sorted(length), "d long, tie long, start long, end long")
    marks = marks.unionByName(few)
    if not sizes.where(F.col("n") > together).isEmpty():
        many = cut_out(lambda x: x["n"] > together).mapInArrow(_window_suffixes(length), SUFFIX_DDL)
        marks = marks.unionByName(buckets(many, partitions, length)[0])
    spans = marks.groupBy("d", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans, ["d", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_removed(with_bytes), RESULT_DDL)
