from collections import defaultdict

import pytest
from cases import clashing, docs
from pyspark.sql import functions as F

from codecorpus.llm import mixing
from codecorpus.llm.common import table


def targets(sizes):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        if not left:
            return capped
        level = (total - sum(capped.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in left}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_are_met(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    source = {r.doc_id: r.source for r in df.collect()}
    rows = mixing.mix(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
        assert all(0 <= a.position <= b.position < 1 for a, b in zip(r.passes, r.passes[1:]))
    expected = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s]) and abs(taken[s] - target[s]) <= 1


def test_positions_follow_the_schedule(spark):
    """Words used up to time t are the integral of the schedule."""
    rows = docs(spark, [(i, "a b c d", "en", f"src{i % 3}", 7) for i in range(600)])
    plan = mixing.mix(rows).join(rows.select("doc_id", "source"), "doc_id")
    flat = plan.select("source", "target", F.explode("passes").alias("p")).collect()
    for t in (0.25, 0.5, 0.9):
        for k, s in enumerate(("src0", "src1", "src2")):
            own = [r for r in flat if r.source == s]
            a = (k + 1 - 2) * 0.5
            used = sum(r.p["words"] for r in own if r.p["position"] < t)
            assert used == pytest.approx(own[0].target * (t + a * (t * t - t)), abs=8)


def test_awkward_rows(spark):
    df = docs(spark)
    found = mixing.mix(clashing(df)).collect()
    assert len(found) == df.count()
    assert {r.doc_id: r.size for r in found}[3] == 0 and {r.doc_id: r.taken for r in found}[5] == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    nothing = mixing.mix(docs(spark, [(1, None, None, "s", 0), (2, "", None, None, 0)])).collect()
    assert [r.taken for r in nothing] == [0, 0] and [r.target for r in nothing] == [0.0, 0.0]
    rows = mixing.training_rows(df, mixing.mix(df))
    assert rows.columns == df.columns and rows.count() > 0


def test_reruns_agree(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    once, again = (sorted((r.doc_id, r.taken) for r in mixing.mix(x).collect()) for x in (df, df.repartition(13)))
    assert once == again


def test_rows_come_in_order_as_often_as_taken(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    order = [r.doc_id for r in mixing.training_rows(df, mixing.mix(df)).collect()]
    seen = defaultdict(int)
    positions = []
    for i in order:
        whole = [p.position for p in plan[i].passes if 2 * p.words >= plan[i].size] or [2.0]
        positions.append(whole[seen[i]])
        seen[i] += 1
    assert positions == sorted(positions)
