from cases import clashing, docs

from codecorpus.llm import sharding
from codecorpus.llm.common import shared_path, table


def test_shards_fit_and_hold_every_row(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    assigned = sharding.assign(df, 50_000)
    path = shared_path(spark, "test-shards")
    sharding.write(assigned, path)
    rows = sharding.read(spark, path, assigned).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in df.collect())
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert len(shards) > 20
    for name, own in shards.items():
        size = sum(len(r.text.encode()) for r in own)
        assert size == own[0].shard_bytes and len(own) == own[0].shard_docs and len(name) - 1 == own[0].shard_depth
        assert size <= 50_000 or len(own) == 1
        # Its parent would not have fitted.
        parent = sum(x[0].shard_bytes for n, x in shards.items() if n.startswith(name[:-1]))
        assert parent > 50_000


def test_awkward_rows(spark):
    df = docs(spark)
    found = sharding.assign(clashing(df), 1000).collect()
    assert len(found) == df.count()
    assert len({r.shard for r in found if r.doc_id == 7}) == 1  # they fit
    assert {r.n_bytes for r in found if r.doc_id == 3} == {0}
    path = shared_path(spark, "test-shards")
    assigned = sharding.assign(docs(spark, []), 1000)
    sharding.write(assigned, path)
    assert sharding.read(spark, path, assigned).count() == 0


def test_rows_of_one_id_split_too(spark):
    """A third of all rows without id, a third with one id, many of them equal: every shard fits."""
    rows = [(None, "x" * 2000 if i % 2 else "y" * 1900 + str(i), "en", "s", 1) for i in range(300)]
    rows += [(5, "z" * 1000, "en", "s", 1) for _ in range(300)] + [(i, "w" * 500, "en", "s", 1) for i in range(100, 400)]
    rows += [(6, "q" * 30_000, "en", "s", 1), (8, None, None, None, None)]
    df = docs(spark, rows).repartition(7)
    assigned = sharding.assign(clashing(df), 20_000)
    path = shared_path(spark, "test-shards")
    sharding.write(assigned, path)
    back = sharding.read(spark, path, assigned).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in back) == sorted((repr(r[0]), repr(r[1])) for r in rows)
    shards = {}
    for r in back:
        shards.setdefault(r.shard, []).append(r)
    for name, own in shards.items():
        size = sum(len((r.text or "").encode()) for r in own)
        assert size == own[0].shard_bytes and len(own) == own[0].shard_docs
        assert size <= 20_000 or len(own) == 1, name
    assert len(shards) > 50
