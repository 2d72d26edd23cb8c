import numpy as np
import pytest
from cases import clashing, docs
from pyspark.sql import functions as F

from codecorpus.llm import jaccard
from codecorpus.llm.common import table
from codecorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_sets(text, words):
    import re
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not parts:
        return frozenset()
    if len(parts) < words:
        return frozenset([tuple(parts)])
    return frozenset(tuple(parts[i:i + words]) for i in range(len(parts) - words + 1))


def brute(rows, words, similarity):
    """(id, set size, component) of every row by comparing all pairs."""
    num, den = similarity
    sets = [brute_sets(t, words) for _, t in rows]
    owner = {}
    for i, s in enumerate(sets):
        for x in s:
            owner.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        hits = {}
        for x in s:
            for j in owner[x]:
                if j < i:
                    hits[j] = hits.get(j, 0) + 1
        for j, both in hits.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    return sorted((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    found = sorted(tuple(r) for r in QUERIES["op6_ngram_jaccard"](spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute(rows, 3, (90, 100))


@pytest.mark.parametrize("words,similarity,chunk", [(5, (80, 100), 1024), (2, (60, 100), 7)])
def test_other_sizes_and_tiny_chunks(spark, monkeypatch, words, similarity, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(300)], n)) for n in (3, 8, 20, 45, 90, 160, 400)]
    rows = []
    for text in base:
        for _ in range(25):
            parts = text.split()
            for _ in range(rng.integers(0, 1 + len(parts) // 8)):
                parts[rng.integers(len(parts))] = f"n{rng.integers(10_000)}"
            rows.append((len(rows) * 3 % 175, " ".join(parts), None, None, None))
    df = docs(spark, rows)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.group(df, words, similarity).collect())
    assert found == brute([r[:2] for r in rows], words, similarity)


def test_awkward_rows(spark):
    found = {(r.doc_id, r.n_shingles): r for r in jaccard.group(clashing(docs(spark)), 3, (90, 100)).collect()}
    assert found[(2, 6)].component_id == 1 and not found[(2, 6)].first
    assert found[(3, 0)].component_id == 3 and found[(4, 0)].component_id == 4 and found[(5, 0)].first
    assert found[(7, 1)].component_id == 6
    assert jaccard.group(docs(spark, [])).count() == 0
    kept = jaccard.drop_near_copies(docs(spark), 3, (90, 100))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 8, 9, 11]
    assert kept.columns == docs(spark).columns


def test_repeated_rows_leave_one(spark):
    twice = docs(spark, [(7, "one two three four", None, None, 3)] * 3)
    assert jaccard.drop_near_copies(twice).count() == 1


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[base[:n], rng.integers(0, 2**63, 12).astype(np.uint64)]) for n in range(20, 300)]
    points = np.array([jaccard.point(s) for s in sets])
    tree = jaccard.RTree(points)
    for i, s in enumerate(sets):
        near = set(tree.near(points[i], len(s), (80, 100)).tolist())
        assert {j for j, t in enumerate(sets) if jaccard.linked(s, t, (80, 100))} <= near


def test_blocks_keep_linked_pairs_together():
    rng = np.random.default_rng(9)
    for num in (60, 80, 90):
        for n in (2, 5, 9, 10, 11, 19, 40, 100, 333):
            for _ in range(40):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                cut, new = rng.integers(0, 2 + n // 5), rng.integers(0, 2 + n // 5)
                b = np.unique(np.r_[a[cut:], rng.integers(0, 2**63, new).astype(np.uint64)])
                a = np.unique(a)
                if len(b) and jaccard.linked(a, b, (num, 100)) and not np.array_equal(a, b):
                    assert np.intersect1d(jaccard.block_keys(a, (num, 100)), jaccard.block_keys(b, (num, 100))).size
