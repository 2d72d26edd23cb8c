import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from cases import docs
from pyspark.sql import functions as F
from test_jaccard import brute
from tokenizers import Tokenizer

from codecorpus.llm import mixing, quality
from codecorpus.llm.common import shared_path, table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_every_stage_against_plain_python(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    df, steps = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, f"test-{name}")
        stage(spark, df, SF).write.parquet(path)
        df = spark.read.parquet(path)
        steps.append(df)
        if name != "packing":
            assert df.columns == COLUMNS
    start = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    good, exact, near, mixed = ([r.doc_id for r in s.collect()] for s in steps[:4])
    # Quality: what the posterior says, computed from the classifier's own evidence.
    kept = {r.doc_id for r in quality.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).where("posterior >= 0.5").collect()}
    assert sorted(good) == sorted(kept)
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(clean & set(good)) >= 0.99 * len(clean)
    assert len(set(good) & (set(labels) - clean)) <= 0.1 * len(set(labels) - clean)
    # Exact copies: the largest id of each text.
    best = {}
    for i in good:
        best[lower(start[i].text)] = max(i, best.get(lower(start[i].text), -1))
    assert sorted(exact) == sorted(best.values())
    # Near copies: the smallest id of each group; documents without words stay.
    groups = brute([(i, start[i].text) for i in exact], 5, (80, 100))
    assert sorted(near) == sorted(i for i, n, c in groups if i == c or n == 0)
    # Mixing: each source's share in words.
    plan = {r.doc_id: r for r in mixing.mix(steps[2]).collect()}
    times = Counter(mixed)
    assert all(times[i] <= 3 for i in times) and set(times) <= set(near)
    for i, p in plan.items():
        assert times[i] == (1 if p.size == 0 else sum(2 * x.words >= p.size for x in p.passes))
    # Packing: all ids of all rows, once each.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for p in steps[4].collect():
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(times)
    for i, ps in pieces.items():
        ids = tokenizer.encode(start[i].text or "", add_special_tokens=False).ids + [2]
        assert sum(p.length for p in ps) == times[i] * len(ids)
        for p in ps:
            part = ids[p.start:p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns


def test_awkward_rows_pass_every_stage(spark):
    df = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, f"awkward-{name}")
        stage(spark, df, SF).write.parquet(path)
        df = spark.read.parquet(path)
    assert df.count() > 0
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_packing_keeps_the_order_of_the_files(spark):
    """Files of growing size, which a scan would read from the largest down."""
    path = shared_path(spark, "test-order")
    rows = [(i, " ".join(f"w{(i * k) % 9973}" for k in range(5000)), "en", "s", 1) for i in range(60)]
    files = docs(spark, rows).withColumn("f", F.floor(F.sqrt(F.col("doc_id"))).cast("int")).repartitionByRange(8, "f")
    files.sortWithinPartitions("doc_id").drop("f").write.parquet(path)
    df = spark.read.parquet(path)
    assert len(df.inputFiles()) > 3
    first = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, df, SF).collect():
        first[r.doc_id] = min(r.sequence_id, first.get(r.doc_id, r.sequence_id)) if r.start == 0 else first.get(r.doc_id, 1 << 63)
    assert sorted(first, key=first.get) == list(range(60))
