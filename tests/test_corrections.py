"""Inputs on which earlier versions gave wrong or unstable answers."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from codecorpus.functions import text as TX
from codecorpus.operators import joins as J
from codecorpus.operators import results as R
from codecorpus.operators import samples as SM
from codecorpus.operators import sampling as G
from codecorpus.operators import spans as S
from codecorpus.operators import training as TR
from codecorpus.sources import files as SRC

SMALL = "/root/testdata/sf0.001"


def java(spark, text):
    df = spark.createDataFrame([("p", "A.java", text)], "proj_name string, relative_path string, source_code string")
    return S.scan_files(df, "source_code", "java")


def test_interface_methods_are_no_samples(spark):
    text = ("class A {\n  interface I { default int d() { return 1; } }\n  int own() { return 2; }\n"
            "  class Inner { int deep() { return 3; } }\n  enum E { X; int e() { return 4; } }\n}\n")
    rows = SM.java_methods(java(spark, text), ["proj_name"]).collect()
    assert sorted((r.class_name, r.func_name) for r in rows) == [("A", "deep"), ("A", "e"), ("A", "own")]


def test_test_cases_are_those_annotated_as_such(spark):
    text = ("class RegressionTest0 {\n  @TestFactory\n  public void factory() { a(); }\n  @Ignore @Test\n  public void test1() { b(); }\n"
            "  @Test(timeout = 5)\n  public void test2() { c(); }\n  @Test\n  public void test3() { d(); }\n}\n")
    df = spark.createDataFrame([(1, text, ["test1"])], "event_id long, test_code string, failing array<string>")
    r = R.split_tests(S.scan_files(df, "test_code", "java")).first()
    assert r.n_tests == 3
    assert "factory" in r.pass_test_code and "factory" in r.fail_test_code
    assert "test1" not in r.pass_test_code and "test2" in r.pass_test_code
    assert "test1" in r.fail_test_code and "test3" not in r.fail_test_code


def test_feedback_belongs_to_the_samples_own_file(spark):
    rows = [(1, "p", "A.java", "<file>p/A.java<line>2<col>1<err>x"), (2, "q", "A.java", "<file>q/A.java<line>1<col>1<err>y"),
            (3, "p", "A.java", "<file>p/A.java<line>99<col>1<err>z"), (4, "p", "A.java", "<success>"), (5, "p", "B.java", "<file>p/B.java<line>1<col>1<err>w")]
    fb = spark.createDataFrame(rows, "event_id long, proj_name string, relative_path string, compiler_feedback string")
    files = spark.createDataFrame([("p", "A.java", "one\ntwo\n"), ("q", "A.java", "eins\nzwei\n")], "proj_name string, relative_path string, source_code string")
    out = {r.event_id: (r.new_compiler_feedback, r.feedback_status) for r in R.enrich_feedback(fb, files, ["proj_name", "relative_path"]).collect()}
    assert out == {1: ("<file>p/A.java<line>2<col>1<line_of_code>two<err>x", "ok"), 2: ("<file>q/A.java<line>1<col>1<line_of_code>eins<err>y", "ok"),
                   3: (rows[2][3], "ok"), 4: ("<success>", "ok"), 5: (rows[4][3], "no_file")}


def test_every_event_keeps_its_feedback(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet").count()
    rows = E.queries()["feedback_lines"](spark, SMALL)
    assert rows.count() == events
    assert {r.feedback_status for r in rows.select("feedback_status").distinct().collect()} >= {"ok"}


def test_row_ids_tell_nulls_apart(spark):
    df = spark.createDataFrame([("k", None, "x"), ("k", "x", None), ("k", None, "x")], "a string, b string, c string")
    ids = [r._sid for r in J.with_row_id(df).collect()]
    assert ids[0] == ids[2] != ids[1]


def test_zip_keeps_surplus_rows(spark):
    a = spark.range(5).select(F.col("id").alias("a"))
    b = spark.range(3).select((F.col("id") * 10).alias("b"))
    rows = sorted((r.idx, r.a, r.b, r.status) for r in G.positional_zip(a, b, ["a"], ["b"]).fillna(-1).collect())
    assert rows == [(0, 0, 0, "ok"), (1, 1, 10, "ok"), (2, 2, 20, "ok"), (3, 3, -1, "no_right"), (4, 4, -1, "no_right")]


def test_lenient_text_keeps_real_replacement_characters(spark):
    df = spark.createDataFrame([(b"a\xff\xef\xbf\xbdb\r\nc",)], "content binary")
    assert df.select(TX.lenient_text(F.col("content")).alias("t")).first().t == "a�b\nc"


def test_lines_as_a_line_reader_gives_them(spark, tmp_path):
    for name, text in (("a", "x\ny\n"), ("b", "x\n\ny"), ("c", "")):
        (tmp_path / name).write_text(text)
    rows = sorted((os.path.basename(r.file), r.line_no, r.line) for r in SRC.read_lines(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, ""), ("b", 2, "y")]


def test_resumable_write_raises_on_broken_output(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    assert SRC.resumable_write(df, path, ["id"]) is not None and spark.read.parquet(path).count() == 5
    SRC.resumable_write(spark.range(8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        SRC.resumable_write(df, str(broken), ["id"])


def test_batched_map_leaves_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = TR.batched_map(spark.range(0, 25, 1, 1), lambda b: b.assign(id=len(b)), "id long", batch_size=10).collect()
    assert sorted(r.id for r in sizes) == [5] * 5 + [10] * 20 and spark.conf.get(key) == before


def test_first_contract_of_a_name_counts(spark):
    text = ("contract A {\n  uint256 public one;\n}\ncontract A {\n  uint256 public two;\n}\n"
            "contract B is A {\n}\ncontract C is B, A {\n}\ncontract D is D2 {\n}\ncontract D2 is D {\n  uint256 public d;\n}\n")
    df = spark.createDataFrame([(0, text)], "source_idx long, source_code string")
    rows = J.inherited_elements(S.scan_files(df, "source_code", "solidity"), ["source_idx"]).collect()
    assert sorted((r.contract_name, [e.strip() for e in r.inherit_elements]) for r in rows) == [
        ("A", []), ("A", []), ("B", ["uint256 public one;"]), ("C", ["uint256 public one;"]), ("D", ["uint256 public d;"]), ("D2", [])]


@pytest.mark.parametrize("name", ["function_spans", "test_split", "token_filter", "inherited_members", "commented_functions", "masked_samples"])
def test_building_a_query_runs_no_job(spark, name):
    """Only reading the parquet schema may run before the action."""
    for t in ("documents", "events"):
        spark.read.parquet(f"{SMALL}/{t}.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    try:
        E.queries()[name](spark, SMALL)
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # one schema job for each parquet table that the query opens
    assert len(jobs) <= 2, jobs


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from codecorpus.session import ensure_checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context))


def test_parameter_types_resolve_through_imports_generics_and_arrays(spark):
    files = [("p", "a/A.java", "package a;\nimport b.Foo;\nimport c.*;\npublic class A {\n  void one(Foo f) { x(); }\n  void two(List<Foo> f, Bar[] b) { x(); }\n"
                               "  void three(int a) { x(); }\n  void four() { x(); }\n  void five(Own o, b.Foo f) { x(); }\n}\n"),
             ("p", "b/Foo.java", "package b;\npublic class Foo {\n}\n"), ("p", "c/Bar.java", "package c;\npublic class Bar {\n}\n"),
             ("p", "a/Own.java", "package a;\npublic class Own {\n}\n"), ("q", "b/Foo.java", "package b;\npublic class Foo {\n int other; }\n")]
    keys = ["proj_name", "relative_path"]
    df = spark.createDataFrame(files, "proj_name string, relative_path string, source_code string")
    sc = S.scan_files(df, "source_code", "java").withColumn("imports", SM.imports(F.col("source_code")))
    samples = SM.java_method_table(sc, [*keys, "imports"]).where("has_body")
    unknown = samples.where("name = 'four'").withColumn("name", F.lit("six")).withColumn("parameters", F.lit(None).cast(samples.schema["parameters"].dataType))
    out = SM.param_context(samples.unionByName(unknown), SM.java_types(sc, keys), keys, imported="imports")
    got = {r.name: r.param_context for r in out.collect()}
    foo, bar, own = ("public class %s {\n}<param_class>" % n for n in ("Foo", "Bar", "Own"))
    assert got == {"one": foo, "two": foo + bar, "three": "<not_self_defined_class>", "four": "<no_param_class>", "five": own + foo, "six": "<error>"}


def test_no_masked_text_is_shuffled(spark):
    """Exchanges carry files or offsets, never a contract copy per function."""
    import re
    for name in ("fim_prompts", "task_sources"):
        p = E.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        for line in p.splitlines():
            if "Exchange" in line:
                assert not re.search("masked_contract|func_body", line), (name, line)


def test_comments_in_strings_stay_if_asked(spark):
    code = 'string u = "http://x"; // gone\nchar c = \'"\'; /* also "gone" */ string v = "a\\"/*b*/";\n/* open'
    df = spark.createDataFrame([(code,)], "s string")
    r = df.select(TX.remove_comments(F.col("s"), string_aware=True).alias("aware"), TX.remove_comments(F.col("s")).alias("plain")).first()
    assert r.aware == 'string u = "http://x"; \nchar c = \'"\';  string v = "a\\"/*b*/";\n/* open'
    assert r.plain.startswith('string u = "http:') and "//x" not in r.plain


def test_call_mentions(spark):
    df = spark.createDataFrame([("a.run(1)", "run"), ("run(1)", "run"), ("a.rerun(1)", "run"), ("a.run (1)", "run")], "t string, n string")
    assert [r[0] for r in df.select(TX.mentions_call(F.col("t"), F.col("n"))).collect()] == [True, False, False, False]
