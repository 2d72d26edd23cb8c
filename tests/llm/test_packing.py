import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from cases import clashing, docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codecorpus.llm import packing
from codecorpus.llm.common import table
from codecorpus.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, expected, sequence=4096):
    """Every id in exactly one piece, right checksums, gapless sequences; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for doc_id, ids in expected.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            part = ids[p.start:p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding / max(1, sum(len(x) for x in expected.values()))


def test_query_against_the_tokenizer(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    expected = {r.doc_id: ids_of(tokenizer, r.text) for r in table(spark, sf, "documents").collect()}
    assert check(QUERIES["op5_packing"](spark, sf).collect(), expected) < 0.01


def test_many_partitions_merge_their_leftovers(spark, tokenizer):
    rows = table(spark, "/root/testdata/sf0.001", "documents").repartition(20)
    expected = {r.doc_id: ids_of(tokenizer, r.text) for r in rows.collect()}
    found = packing.pack(rows, sequence=512, open_windows=3, merge_partitions=8).collect()
    assert check(found, expected, 512) < 0.03


def test_awkward_rows(spark, tokenizer):
    rows = [r for r in docs(spark).collect() if r.doc_id not in (7,)]
    df = docs(spark, [tuple(r) for r in rows])
    expected = {r.doc_id: ids_of(tokenizer, r.text) for r in rows}
    check(packing.pack(clashing(df)).collect(), expected)
    # Equal rows are packed as often as they occur.
    twice = packing.pack(docs(spark, [(7, "one", None, None, 3)] * 2)).collect()
    assert sum(p.length for p in twice) == 2 * len(ids_of(tokenizer, "one"))
    assert packing.pack(docs(spark, [])).count() == 0


def test_words_equal_the_tokenizer_on_odd_text(tokenizer):
    texts = ["It's the dog's <|endoftext|> x", "İstanbul ΣΑΣ ǅ é é a b \x1c c", "a1b2 ... ,x, --- ß$$$ A!!", None, "",
             "3,14 don't we'll !!!'s '' '   z", "漢字かな交じり文 한국어 \U0001f600\U0001f600 ok"]
    words = packing._words(None)
    for text, raw in zip(texts, words.ids([None if t is None else t.encode() for t in texts])):
        assert raw == struct.pack(f"<{len(raw) // 4}I", *tokenizer.encode(text or "", add_special_tokens=False).ids), text


def test_leftovers_stand_behind_their_partition(spark):
    rows = docs(spark, [(i, "one two three " * (5 + i % 7), "en", "s", 1) for i in range(400)]).repartitionByRange(10, "doc_id")
    part = {r.doc_id: r.p for r in rows.select("doc_id", F.spark_partition_id().alias("p")).collect()}
    spans = defaultdict(set)
    for r in packing.pack(rows, sequence=256, open_windows=3, merge_partitions=4).collect():
        spans[r.sequence_id].add(part[r.doc_id])
    spans = [spans[i] for i in sorted(spans)]
    assert max(map(len, spans)) > 1  # merged sequences
    assert [min(s) for s in spans] == sorted(min(s) for s in spans)
