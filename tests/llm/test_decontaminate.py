"""Windows of a benchmark in documents, against a plain scan."""

import hashlib
import re

import pytest
from cases import LONG, ROWS, clashing, docs

from codecorpus.llm import decontaminate as D

ITEMS = [
    (1, "Alpha, beta gamma delta epsilon zeta eta theta"),  # fewer words than a window
    (2, " ".join(f"word{i} x{i}" for i in range(20, 32))),
    (3, "one"),
    (3, "one"),
    (4, " ".join(f"word{i} x{i}" for i in range(26, 40))),  # shares windows with 2
    (5, None),
    (6, " .,; "),
    (10, "ONE"),
    (None, "äöü ß"),
]
MORE = [(20, "so ONE, two. alpha beta gamma delta epsilon zeta eta theta! end", "en", "s", 1),
        (21, "a " * 3000 + "word29 x29 word30 x30 word31 x31 word32 x32 word33 x33 tail", "en", "s", 1),
        (22, "word29 x29 word30 x30 word31 x31 word32 x32 word33", "en", "s", 1)]


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items, size=10):
    grams = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                own = grams.get(tuple(w[i:i + k]))
                if own is not None:
                    hit |= set(range(i, i + k))
                    found |= own - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 700])
def test_against_plain_scan(spark, benchmark, block_bytes):
    """Short items, shared windows, null and repeated rows; one block and several."""
    table = clashing(docs(spark, ROWS + MORE))
    assert found(D.scan(table, benchmark, block_bytes=block_bytes)) == brute(ROWS + MORE, ITEMS)


def test_a_window_in_a_third_of_all_rows(spark, benchmark):
    rows = [(i if i % 2 else None, MORE[1][1] if i % 3 == 0 else f"clean text {i}", "en", "s", 1) for i in range(300)]
    assert found(D.scan(docs(spark, rows).repartition(7), benchmark)) == brute(rows, ITEMS)


def test_spans_are_maximal_runs(spark, benchmark):
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in D.scan(docs(spark, MORE), benchmark).collect()}
    assert spans == {20: [(1, 2), (3, 11)], 21: [(3000, 3010)], 22: []}


def test_removal(spark, benchmark):
    table = clashing(docs(spark, ROWS + MORE))
    left = D.decontaminate(table, benchmark)
    assert left.columns == table.columns and left.count() == len(ROWS + MORE)
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[20] == "so two. end" and texts[21] == "a " * 3000 + "tail" and texts[22] == MORE[2][1]
    assert texts[3] is None and texts[4] == "" and texts[6] == "" and texts[9] == "漢字 \U0001f600 ÀB" and len(texts[8]) < len(LONG)
    kept = {r.doc_id for r in D.decontaminate(table, benchmark, remove="documents").collect()}
    dirty = {r[0] for r in brute(ROWS + MORE, ITEMS) if r[-1]}
    assert kept == {r[0] for r in ROWS + MORE} - dirty
    # What is left of a document holds none of the windows of ten words.
    assert not any(r[2] for r in brute([(k, v) for k, v in texts.items() if k in (8, 10, 21)], ITEMS[1:2] + ITEMS[4:5]))


def test_empty_tables(spark, benchmark):
    none = spark.createDataFrame([], benchmark.schema)
    assert found(D.scan(docs(spark), none)) == brute(ROWS, [])
    assert D.scan(docs(spark, []), benchmark).isEmpty() and D.decontaminate(docs(spark, []), benchmark).isEmpty()
    assert D.decontaminate(docs(spark), none, remove="documents").count() == len(ROWS)
    with pytest.raises(ValueError):
        D.decontaminate(docs(spark), benchmark, remove="words")
