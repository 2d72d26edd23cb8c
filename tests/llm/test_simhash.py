import hashlib
import re

import xxhash
from cases import clashing, docs

from codecorpus.llm import simhash
from codecorpus.llm.common import table
from codecorpus.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spaces = re.findall(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    terms = [a + s + b for a, s, b in zip(words, spaces, words[1:])] + words[-1:]
    votes = [0] * 64
    for t in terms:
        h, w = xxhash.xxh64_intdigest(t.encode(), 42), len(t.encode())
        for b in range(64):
            votes[b] += w if h >> b & 1 else -w
    return sum(1 << b for b in range(64) if votes[b] > 0)


def expected(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        f, e, n = brute(text), brute(edited), brute(after)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}",
                  1 - (f ^ e).bit_count() / 64, 1 - (f ^ n).bit_count() / 64)
    return out


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    found = {r.doc_id: tuple(r)[1:7] for r in QUERIES["op1_simhash"](spark, SF).collect()}
    assert found == expected(rows)


def test_edited_texts_are_nearer_than_neighbours(spark):
    rows = QUERIES["op1_simhash"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def test_search_finds_every_fingerprint_in_the_radius(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(k % 6)) for k, b in enumerate(base * 5)]
    all_fps = sorted({simhash._signed(f & (2**64 - 1)) for f in base + near})
    df = spark.createDataFrame([(f,) for f in all_fps], "fp long")
    found = {(r.fp, r.other): r.distance for r in simhash.within_radius(df, df).collect()}
    mask = 2**64 - 1
    brute_pairs = {(a, b): ((a & mask) ^ (b & mask)).bit_count() for a in all_fps for b in all_fps}
    assert found == {p: d for p, d in brute_pairs.items() if d <= 3}


def test_near_counts_count_documents(spark):
    rows = spark.createDataFrame([(20, 5), (21, 5), (40, 4), (61, 2**40 - 1), (80, -1)], "doc_id long, fp long")
    assert {r.fp: r.near_docs for r in simhash.near_counts(rows).collect()} == {5: 3, 4: 3, -1: 1}


def test_awkward_rows(spark):
    found = simhash.with_edits(clashing(docs(spark)), buckets=5).collect()
    assert len(found) == docs(spark).count()
    rows = [(r.doc_id, r.text) for r in docs(spark).collect() if r.doc_id not in (7, None)]
    some = {r.doc_id: (r.n_chars, r.edited_sha256) for r in simhash.with_edits(docs(spark, [(i, t, None, None, 0) for i, t in rows]), buckets=4).collect()}
    assert some == {i: x[:2] for i, x in expected(rows).items()}
    alone = simhash.with_edits(docs(spark, [(1, "ab cd ef", None, None, 0)])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"ab cd ab").hexdigest() and alone[0].near_next == 1.0
    assert simhash.with_edits(docs(spark, [])).count() == 0
    assert {r.fp for r in simhash.fingerprints(docs(spark, [(1, None, None, None, 0), (2, "", None, None, 0)])).collect()} == {0}
