import pytest
from cases import clashing, docs

from codecorpus.llm import dedup, extendible
from codecorpus.llm.common import table


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("capacity,hash_bits", [(8192, 64), (16, 64), (16, 5)])
def test_collisions_and_small_buckets(spark, capacity, hash_bits):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    rows = df.collect()
    expected, text = brute(rows), {r.doc_id: lower(r.text) for r in rows}
    found = dedup.exact_dedup(df, capacity, hash_bits).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size) == expected[text[r.doc_id]] and r.kept == (r.keep_id == r.doc_id)


def test_awkward_rows(spark):
    df = docs(spark)
    found = dedup.exact_dedup(clashing(df)).collect()
    assert len(found) == df.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.keep_id for r in by_id[1]] == [2] and by_id[2][0].kept
    assert by_id[3][0].keep_id == 4 and by_id[4][0].group_size == 2
    # Of rows equal in id and text one stays.
    assert sorted(r.kept for r in by_id[7]) == [False, True] and by_id[6][0].group_size == 3
    assert by_id[None][0].kept
    kept = dedup.drop_copies(df)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 2, 4, 5, 7, 8, 9, 10, 11]
    assert dedup.exact_dedup(docs(spark, [])).count() == 0


def test_directory_splits_only_what_is_too_large(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS hash", "1L AS load")
    keys = keys.union(spark.range(500).selectExpr("-7L AS hash", "1L AS load"))
    bits, slots = extendible.build(keys, 100, 64)
    placed = extendible.look_up(keys, bits, slots, 64).groupBy("bucket", "depth", "bucket_load").agg({"load": "sum", "hash": "approx_count_distinct"}).collect()
    loads = {r.bucket: r.bucket_load for r in placed}
    assert sum(loads.values()) == 1500
    for r in placed:
        assert r["sum(load)"] == r.bucket_load
        assert r.bucket_load <= 100 or r["approx_count_distinct(hash)"] == 1
        sibling = r.bucket[:-1] + ("1" if r.bucket[-1] == "0" else "0")
        parent = sum(n for b, n in loads.items() if b.startswith(r.bucket[:-1]))
        assert r.depth == 0 or parent > 100, (r, sibling)
    names = sorted(loads)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
