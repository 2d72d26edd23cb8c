"""N-gram Jaccard join with count vectors in an R-tree.

A document's set holds its distinct word n-grams (as 64-bit hashes).  Hashing
the members of a set into groups gives a point, the vector of group counts;
two sets overlap in at most the sum of the coordinate minima of their points.
The points of a leaf or node of an R-tree are bounded by their coordinate
maxima in the same way, so whole nodes are passed over.  Pairs that survive
are verified on the sets themselves.

A tree over all points at once prunes little, so the points are first dealt to
blocks that keep every linked pair together: with sizes in one class, linked
sets differ in at most ``D`` members, so of ``D + 1`` or more groups at least
one holds the same members in both.  Each (class, group, members) is a block.
Equal sets are merged before, and all texts of one set count as one.

Links are only needed up to connectivity.  In a few rounds every open block
links its members to the one with most company; blocks whose members are then
all connected are done, and a member that has met all others leaves its block.
The others are joined through their R-trees, in chunks of bounded size, and
report links between sets that are not connected yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import WordCache, batches_of, cut, default_partitions, discard, rows_of, shared_path

#: The stages on word shingles take five words and 0.8 unless told otherwise.
WORDS = 5
SIMILARITY = (80, 100)
#: Coordinates of a point, points in a leaf, children of an inner node.
GROUPS = 1024
LEAF = 32
#: Members of a block that meet in one task: two chunks.
CHUNK = 1024
#: Pairs of whole texts that a Python worker gets at a time.
PAIR_ROWS = 128
#: Rounds in which open blocks link to one member.
ROUNDS = 2
#: Width of a size class, and hash seeds tried for groups without empty ones.
CLASS_RATIO = 1.4
SEEDS = 4
#: Bytes of the words whose hashes a Python worker keeps, with what an entry adds.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 140

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


_cache = WordCache(xxhash.xxh64_digest, CACHE_BYTES, ENTRY_BYTES)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-grams of a text, A-Z lower-cased;
    of fewer words the whole sequence is one; without words there are none."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    _cache.bound()
    own = np.frombuffer(b"".join([_cache[w] for w in parts]), "<u8")
    with np.errstate(over="ignore"):
        n = min(words, len(own))
        z = np.full(len(own) - n + 1, n, np.uint64)
        for i in range(n):
            z += own[i:len(own) - n + 1 + i] * _ODD[i]
        z = _mix(z)
    return np.unique(z)


def linked(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether the sets' Jaccard similarity is at least num / den."""
    num, den = similarity
    if not len(a) or not len(b) or min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


# -- points and the R-tree ----------------------------------------------------

def point(members: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts of a set's members by hash group."""
    return np.bincount((members % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def least_overlap(total, similarity: tuple[int, int]):
    """Members that two sets of ``total`` members together share at least, if linked."""
    num, den = similarity
    return -(-num * total // (num + den))


class RTree:
    """Points packed into leaves by size and then by their coordinates, and
    leaves into inner nodes; a node keeps its coordinate maxima and least size."""

    def __init__(self, points: np.ndarray):
        sizes = points.sum(1)
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes)) if len(points) else np.empty(0, np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > LEAF or len(self.levels) == 1:
            top, least = self.levels[-1]
            cuts = np.arange(0, len(top), LEAF)
            if not len(top):
                break
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)))

    def near(self, coords: np.ndarray, size: int, similarity: tuple[int, int]) -> np.ndarray:
        """Points whose overlap with a point may reach the similarity, as positions in the input."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            bound = np.minimum(top[at], coords).sum(1)
            at = at[bound >= least_overlap(least[at] + size, similarity)]
            if depth:
                below = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = below[below < len(self.levels[depth - 1][0])]
        return self.order[at]


def near_pairs(points: np.ndarray, component: np.ndarray, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of points of different components whose overlap may reach the
    similarity: through a tree, or at once for a single leaf."""
    if len(set(component.tolist())) < 2:
        return []
    sizes = points.sum(1)
    if len(points) <= LEAF:
        bound = np.minimum(points[:, None, :], points[None, :, :]).sum(2)
        near = (bound >= least_overlap(sizes[:, None] + sizes[None, :], similarity)) & (component[:, None] != component[None, :])
        return [(i, j) for i, j in np.argwhere(near).tolist() if i < j]
    tree, out = RTree(points), []
    for i in range(len(points)):
        for j in tree.near(points[i], sizes[i], similarity).tolist():
            if i < j and component[i] != component[j]:
                out.append((i, j))
    return out


# -- blocks ---------------------------------------------------------------------

def size_class(n: int, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """(class, most differing members) of each class in which a set of ``n`` members is dealt out:
    its own, and the one below if a linked set can be there."""
    num, den = similarity
    low, c, before, out = 1, 0, None, []
    while True:
        high = max(low + 1, int(low * max(CLASS_RATIO, 1.05 * den / num)))
        if n < high:
            if before is not None and n * num <= (low - 1) * den:
                out.append((c - 1, (low - 1) * (den - num) // num))
            return [*out, (c, (high - 1) * (den - num) // num)]
        before, low, c = low, high, c + 1


def block_keys(members: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Keys of the blocks of a set.

    With ``D`` differing members at most and ``D + 1 + spare`` groups, more than
    ``spare`` groups are the same in linked sets; one of these has members
    unless more than ``spare`` groups are empty in both.  A set with that many
    empty groups is also dealt out by the next hash seed, and after the last
    seed by its empty groups too.
    """
    out = []
    with np.errstate(over="ignore"):
        for c, differ in size_class(len(members), similarity):
            if differ == 0:
                continue  # only equal sets can be linked, and those are merged
            spare = 1 + differ // 16
            groups = differ + 1 + spare
            for seed in range(SEEDS):
                salt = _ODD[8 + seed] * np.uint64(c + 1)
                group = ((_mix(members + salt) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
                order = np.argsort(group, kind="stable")
                present, cuts = np.unique(group[order], return_index=True)
                sums = np.add.reduceat(_mix(members ^ _ODD[16])[order], cuts)
                out.append(_mix(_mix(sums + present * _ODD[17]) + salt))
                if groups - len(present) <= spare:
                    break
            else:
                empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), present)
                out.append(_mix(_mix(empty * _ODD[17]) + salt + _ODD[18]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_id(members: np.ndarray, seed: int) -> tuple[int, int]:
    full = xxhash.xxh3_128_intdigest(members.tobytes(), seed)
    return (full >> 64) - (1 << 63), (full & ((1 << 64) - 1)) - (1 << 63)


SCANNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()),
                     ("check", pa.int64()), ("keys", pa.list_(pa.int64()))])
SCANNED_DDL = "doc_id long, text_hash long, n_shingles long, sid long, check long, keys array<long>"


def _scanned(words: int, seed: int, similarity: tuple[int, int]):
    """Size and ids of every document's set, and the keys of its blocks; a set
    that the partition has seen before has none (one copy is enough)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sizes, sids, checks, keys = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = shingles(text, words)
                    sid, check = _set_id(own, seed)
                    sizes.append(len(own))
                    sids.append(sid)
                    checks.append(check)
                    keys.append(None if not len(own) or sid in seen else block_keys(own, similarity).view(np.int64))
                    seen.add(sid)
                columns = [part.column("doc_id"), part.column("text_hash"), *(pa.array(c, pa.int64()) for c in (sizes, sids, checks)),
                           pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=SCANNED)
    return run


def _points(words: int):
    """``sid`` and point of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = [_encoded(point(shingles(t, words))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(points, pa.binary())], ["sid", "point"])
    return run


def _encoded(counts: np.ndarray) -> bytes:
    """A point in as few bytes a coordinate as its largest count needs."""
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4") if counts.max() <= np.iinfo(t).max)).tobytes()


def _decoded(points: list[bytes]) -> np.ndarray:
    out = np.empty((len(points), GROUPS), np.int32)
    for i, own in enumerate(points):
        out[i] = np.frombuffer(own, f"<u{len(own) // GROUPS}")
    return out


def _bounded(similarity: tuple[int, int]):
    """Pairs whose points allow the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_decoded(b.column(c).to_pylist()) for c in ("a_point", "b_point"))
            keep = np.minimum(x, y).sum(1) >= least_overlap(x.sum(1) + y.sum(1), similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep))
    return run


def _verified(words: int, similarity: tuple[int, int]):
    """Pairs whose sets are that similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(sid: int, text: str) -> np.ndarray:
            if sid not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[sid] = shingles(text, words)
            return kept[sid]

        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")))
            keep = [linked(of(x, s), of(y, t), similarity) for x, y, s, t in rows]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _block_pairs(similarity: tuple[int, int]):
    """Pairs of a partition's blocks; rows come sorted by block (key, i, j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def pairs():
            sids, component = (np.array([h[k] for h in held]) for k in (0, 1))
            points = _decoded([h[2] for h in held])
            found = near_pairs(points, component, similarity)
            a, b = (sids[[f[k] for f in found]] if found else np.empty(0, np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for b in batches:
            for key, i, j, sid, component, own in zip(*(c.to_pylist() for c in b.columns)):
                if (key, i, j) != last:
                    if len(held) > 1:
                        yield pairs()
                    last, held = (key, i, j), []
                held.append((sid, component, own))
        if len(held) > 1:
            yield pairs()
    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``sid, component``: the smallest ``sid`` reachable over ``links(a, b)``.

    Every round takes the smallest label among the neighbours and then that
    label's own label, until nothing changes.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(nodes.select("sid", F.col("sid").alias("component")))
    while True:
        heard = (both.join(labels, both.a == labels.sid).groupBy(F.col("b").alias("sid")).agg(F.min("component").alias("heard")))
        met = labels.join(heard, "sid", "left").select("sid", "component", F.least("component", "heard").alias("next"))
        up = labels.select(F.col("sid").alias("next"), F.col("component").alias("after"))
        new = cut(met.join(up, "next", "left").select("sid", F.least("next", "after").alias("component"), F.col("component").alias("old")))
        labels = new.select("sid", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, sid, company, component`` of the blocks whose members are not all connected."""
    known = members.join(labels, "sid")
    several = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return cut(known.join(several.select("key"), "key"))


def _links(pairs: DataFrame, points: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b)`` that are linked: bounded by their points, then verified on their sets."""
    def both(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            df = df.join(table.select(F.col("sid").alias(side), F.col(column).alias(f"{side}_{column}")), side)
        return df.select("a", "b", f"a_{column}", f"b_{column}")

    near = cut(both(pairs, points, "point").mapInArrow(_bounded(similarity), "a long, b long"))
    # The rows are written here, so the limit holds for their plan.
    with batches_of(pairs.sparkSession, PAIR_ROWS):
        return cut(both(near, texts, "text").mapInArrow(_verified(words, similarity), "a long, b long"))


def group(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, component_id, first``.

    ``component_id`` is the smallest document id reachable over links (its own
    without any); two documents link if their sets are equal or at least
    ``num / den`` similar.  Documents without words (null texts too) are linked
    with nothing.  ``first``: whether the row is the one that stands for its
    group (one row, if several share the smallest id).  Null ids count as
    larger than all others.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seed = 0
    while True:
        path = shared_path(spark, "jaccard-sets")
        rows.mapInArrow(_scanned(words, seed, similarity), SCANNED_DDL).write.parquet(path)
        sets = spark.read.parquet(path)
        reps = sets.where("n_shingles > 0").groupBy("sid", "check").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"))
        reps = cut(reps.select("sid", "rep.doc_id", "rep.text_hash"))
        if reps.groupBy("sid").count().where("count > 1").isEmpty():
            break
        seed += 1  # two different sets share an id: take another hash
    keys = sets.select("sid", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    in_blocks = shared_path(spark, "jaccard-members")
    keys.join(shared, "key").write.parquet(in_blocks)
    members = spark.read.parquet(in_blocks).distinct()
    sets = cut(sets.drop("keys"))
    discard(spark, path)
    # How much company a set has in all its blocks: the one that the others
    # were made from has most, and links to more of them than they to each other.
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = members.join(sizes, "key")
    company = members.groupBy("sid").agg(F.sum("size").alias("company"))
    with_company = shared_path(spark, "jaccard-blocks")
    members.select("key", "sid").join(company, "sid").write.parquet(with_company)
    rest = spark.read.parquet(with_company)
    wanted = reps.join(company.select("sid"), "sid")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("doc_id", "text_hash")]
    of_members = shared_path(spark, "jaccard-texts")
    rows.alias("r").join(wanted.alias("w"), on).select("w.sid", "r.text").dropDuplicates(["sid"]).write.parquet(of_members)
    texts = spark.read.parquet(of_members)
    discard(spark, in_blocks)
    points = cut(texts.mapInArrow(_points(words), "sid long, point binary"))
    labels = cut(texts.select("sid", F.col("sid").alias("component")))
    links = cut(spark.createDataFrame([], "a long, b long"))
    for _ in range(ROUNDS):
        rest = _open_blocks(rest, labels)
        pivots = rest.groupBy("key").agg(F.max(F.struct("company", "sid", "component")).alias("pivot"))
        met = cut(rest.join(pivots.select("key", "pivot.sid", F.col("pivot.component").alias("with")).withColumnRenamed("sid", "a"), "key"))
        edges = met.where("component <> with").select("a", F.col("sid").alias("b")).distinct()
        links = cut(links.union(_links(edges, points, texts, words, similarity)).distinct())
        labels = components(texts.select("sid"), links)
        rest = met.where("sid <> a").select("key", "sid", "company")
    # What is still open, each set of members once, through the trees.
    rest = _open_blocks(rest, labels)
    blocks = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("print"), F.min("sid").alias("least"))
    once = blocks.groupBy("size", "print", "least").agg(F.min("key").alias("key"))
    rest = rest.join(once.select("key", "size"), "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    mine = F.pmod(F.xxhash64("sid", "key"), F.col("chunks")).cast("int")
    dealt = rest.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "sid", "component")
    blocked = dealt.join(points, "sid").select("key", "i", "j", "sid", "component", "point")
    blocked = blocked.repartition(default_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = blocked.mapInArrow(_block_pairs(similarity), "a long, b long").distinct()
    more = _links(pairs, points, texts, words, similarity)
    if not more.isEmpty():
        labels = components(texts.select("sid"), links.union(more))
    owned = reps.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = cut(owned.join(smallest, "component").select("sid", "component_id", F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")))
    discard(spark, with_company, of_members)
    found = sets.join(by_set, "sid", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    first = alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), first.alias("first"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group."""
    chosen = group(docs, words, similarity).where("first")
    texted = chosen.where("n_shingles > 0").dropDuplicates(["doc_id", "text_hash"])
    return rows_of(docs, texted.unionByName(chosen.where("n_shingles = 0")))
