"""Costly steps run in many tasks, and their expressions work things out once."""

import pytest
from pyspark.sql import functions as F

from codecorpus.functions.text import character_runs
from codecorpus.operators import similarity as SIM
from codecorpus.operators import synth as SY
from codecorpus.plans import catalog as C


def tables(spark, path):
    events = [(i, i % 7, ("click", "error", "view")[i % 3]) for i in range(40)] + [(3, 1, "click"), (None, 1, "click")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{path}/events.parquet")
    docs = [(i, f"src{i % 3}", f"some words {i} of a text") for i in range(40)] + [(3, "src0", None), (None, "src1", "more")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    items = [(i, f"some words {i} asked") for i in range(6)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["test_split", "test_split_varied"])
def test_test_files_are_scanned_in_many_tasks(spark, tmp_path, name):
    """the join's partitions were merged into one before the scan."""
    out = C.QUERIES[name](spark, tables(spark, tmp_path))
    assert out.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    ids = [r.event_id for r in out.collect()]
    assert sorted(ids) == sorted([i for i in range(40) if i != 3] + [3] * 4)  # equal ids meet each other, null ids nothing


@pytest.mark.parametrize("name,module,function", [("name_mentions", "MN", "mentions"), ("generation_mentions", "MN", "generation_status"),
                                                  ("best_document", "SIM", "best_matches")])
def test_texts_of_one_file_are_searched_in_many_tasks(spark, tmp_path, monkeypatch, name, module, function):
    """a file of one row group was searched by one task."""
    own, tasks = getattr(getattr(C, module), function), []

    def watched(first, texts, *rest):
        tasks.append(texts.rdd.getNumPartitions())
        return own(first, texts, *rest)

    monkeypatch.setattr(getattr(C, module), function, watched)
    assert not C.QUERIES[name](spark, tables(spark, tmp_path)).isEmpty()
    assert tasks == [2 * spark.sparkContext.defaultParallelism]


def test_character_runs(spark):
    texts = ["abcde", "ab", "a", "", None, "a\nb\r\nc", "\U0001d11ea\U0001d11eb\U0001f600", "é日本語x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in (1, 2, 4):
        got = [r.g for r in rows.select(character_runs(F.col("t"), k).alias("g")).collect()]
        want = [None if t is None else [t[i:i + k] for i in range(len(t) - k + 1)] for t in texts]
        assert got == want


def test_counts_by_group(spark):
    rows = spark.createDataFrame([([f"m{i}" for i in range(n)],) for n in (0, 1, 7, 300)] + [(None,)], "members array<string>")
    got = SIM._with_counts(rows).select("counts", F.transform("members", lambda m: F.pmod(F.xxhash64(m), F.lit(SIM.GROUPS))).alias("g")).collect()
    assert [r.counts for r in got] == [None if not r.g else [r.g.count(x) for x in range(SIM.GROUPS)] for r in got]


def test_digests_of_a_value_are_worked_out_once():
    """inside lambdas every use of a column works it out anew."""
    assert str(SY._int_value(F.col("type"), F.col("key"))).count("md5") == 1
