import hashlib

import numpy as np
import pytest
from cases import clashing, docs

from codecorpus.llm import suffixes
from codecorpus.llm.common import table
from codecorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """Result rows by remembering every window of all documents in order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            window = data[i:i + length]
            if window in seen:
                gone[i:i + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert found(QUERIES["op3_suffix_dedup"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("together,partitions", [(256, 5), (2, 7)])
def test_shared_passages_and_edits(spark, together, partitions):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeß é"), rng.integers(1, 9)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(90)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = base[i % 6].split(" ")
        for _ in range(i % 4):
            parts[rng.integers(len(parts))] = word()
        where = rng.integers(len(parts))
        text = " ".join(parts[:where] + ([passage[i % 7:]] if i % 3 == 0 else []) + parts[where:])
        rows.append((i * 37 % 90, text + ("na" * 200 if i % 10 == 0 else ""), None, None, None))
    df = docs(spark, rows).repartition(4)
    assert found(suffixes.remove_repeats(df, partitions=partitions, together=together)) == brute([r[:2] for r in rows])


def test_awkward_rows(spark):
    rows = [r for r in docs(spark).collect() if r.doc_id != 7]
    df = docs(spark, [tuple(r) for r in rows])
    assert found(suffixes.remove_repeats(clashing(df))) == brute([(r.doc_id, r.text) for r in rows])
    twice = suffixes.remove_repeats(docs(spark, [(7, "x y z " * 50, None, None, 3)] * 2)).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == 300 - 6
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_kept_bytes(spark):
    rows = [(1, "ab" * 60, None, None, None), (2, "q" + "ab" * 55, None, None, None)]
    kept = {r.doc_id: r.kept for r in suffixes.remove_repeats(docs(spark, rows), with_bytes=True).collect()}
    assert kept == {1: b"ab", 2: b"q"}


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 5, 20_000), rng.integers(-3, 3, 20_000), rng.integers(0, 2**63, 20_000)]
    order = suffixes.multikey_quicksort(columns)
    assert (order == np.lexsort(columns[::-1])).all()
