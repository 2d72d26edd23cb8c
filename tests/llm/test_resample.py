"""Importance resampling against a plain sort."""

import hashlib
import math
import zlib

import pytest
from cases import ROWS, clashing, docs
from test_decontaminate import words

from codecorpus.llm import resample as R

TARGET = [(1, "alpha beta gamma alpha beta"), (2, None), (3, "x1 x2 x3 äöü word5")]


def brute(rows, target, share=(10, 100), least=20, buckets=10_000, longest=1):
    def feats(text):
        w = words(text)
        runs = [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return [zlib.crc32(f.encode()) % buckets for f in runs], len(w)

    docs_ = [(r[0], *feats(r[1]), r[1]) for r in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, f, _, _ in docs_:
        for b in f:
            s[b] += 1
    for _, text in target:
        for b in feats(text)[0]:
            t[b] += 1
    gain = R.gains(s, t)
    out = []
    for doc_id, f, n, text in docs_:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least])
    eligible = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(eligible[:share[0] * len(eligible) // share[1]]):
        ranks.setdefault(tuple(map(repr, r)), []).append(k + 1)
    rows = []
    for r in out:
        left = ranks.get(tuple(map(repr, r)))
        rows.append((*r[:4], left.pop() if left else None))
    return sorted(rows, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def target(spark, rows=TARGET):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_gain_is_floored():
    assert R.gains([1, 0], [0, 1]) == [math.floor(1000 * math.log(3 / 6)), math.floor(1000 * math.log(6 / 3))]


@pytest.mark.parametrize("share, least, longest", [((10, 100), 20, 1), ((50, 100), 1, 2), ((100, 100), 0, 3), ((7, 9), 8, 1)])
def test_against_plain_sort(spark, share, least, longest):
    got = found(R.resample(clashing(docs(spark)), target(spark), share=share, least_words=least, longest=longest))
    assert got == brute(ROWS, TARGET, share, least, longest=longest)


@pytest.mark.parametrize("share", [(1, 3), (2, 3), (5, 6)])
def test_ties_of_ids_and_texts(spark, share):
    """A third of all rows without id and equal in text, a third with one id
    and equal scores by different texts: the draw still has the exact size."""
    rows = [(None, "a b c")] * 40 + [(5, f"{'d e' if i % 2 else 'e d'}") for i in range(40)] + [(i, "f g") for i in range(100, 140)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(R.resample(table, target(spark), share=share, least_words=1))
    assert got == brute(rows, TARGET, share, 1)
    assert len({r[4] for r in got if r[4]}) == share[0] * 120 // share[1]


def test_copies_beyond_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    rows = [(1, "a b c")] * 100 + [(2, "d")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(R.resample(table, target(spark), share=(1, 2), least_words=1)) == brute(rows, TARGET, (1, 2), 1)


def test_drawn_rows_keep_their_columns(spark):
    table = clashing(docs(spark))
    picked = R.draw(table, target(spark), share=(1, 2), least_words=1)
    want = sorted((r[0] for r in brute(ROWS, TARGET, (1, 2), 1) if r[4]), key=repr)
    assert picked.columns == table.columns and sorted((r.doc_id for r in picked.collect()), key=repr) == want


def test_empty_tables(spark):
    assert R.resample(docs(spark, []), target(spark)).isEmpty()
    assert found(R.resample(docs(spark), target(spark, []))) == brute(ROWS, [])
