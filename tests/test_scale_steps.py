"""Steps whose memory or shuffled bytes once grew faster than their input."""

import pyarrow as pa
from pyspark.sql import functions as F

from codecorpus.operators import joins as J
from codecorpus.operators import results as R
from codecorpus.operators import samples as SM
from codecorpus.operators import spans as S


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def test_scan_hands_on_spans_piece_by_piece():
    one = "class A { void f() { a(); b(); } }\n"
    texts = [one * (i % 5) for i in range(200)] + [None, one * 400, "", one]
    got = list(S._scan_batches("text", "java", True, piece_bytes=1000)(iter([batch(texts), batch([]), batch([one])])))
    assert len(got) > 5
    for rb in got:
        assert rb.num_rows == 1 or sum(len(t or "") for t in rb.column("text").to_pylist()) <= 1000
    whole = list(S._scan_batches("text", "java", True, piece_bytes=1 << 40)(iter([batch(texts), batch([one])])))
    assert pa.Table.from_batches(got).combine_chunks() == pa.Table.from_batches(whole).combine_chunks()
    assert pa.Table.from_batches(got).column("spans").to_pylist()[200] is None


FILES = [("p", "A.java", "class A {\n  void f(int a) { a(); }\n  class B { void g() { b(); } }\n  interface I { default void d() { c(); } }\n}\n"),
         ("p", "A.java", "class A {\n  int x;\n  void f() { other(); }\n}\n"),  # another file of the same key
         ("p", "E.java", "enum E { X; void f() { e(); } }\n"),  # methods in no class
         ("p", "F.java", "class F {\n  void f() { one(); }\n}\n"), ("p", "F.java", "class F {\n  void f() { one(); }\n}\n"),
         (None, "N.java", "class N {\n  void f() { n(); }\n}\n"), ("p", "T.java", None)]
KEYS = ["proj_name", "relative_path"]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def scanned_files(spark, rows, lang):
    df = spark.createDataFrame(rows, "proj_name string, relative_path string, source_code string").repartition(3)
    return S.materialize(S.scan_files(df, "source_code", lang), "file_row")


def test_java_refill_and_match_back_by_offsets(spark):
    sc = scanned_files(spark, FILES, "java")
    whole = SM.java_methods(sc, KEYS).withColumn("output", F.upper("func_body"))
    by_place = SM.java_methods(sc, [*KEYS, "file_row"], offsets=True).withColumn("output", F.upper("func_body"))
    assert "masked_class" not in by_place.columns
    filled = J.refill_java_class(by_place, sc, KEYS, "output", row="file_row")
    assert rows_of(filled) == rows_of(J.refill_java_class(whole, sc, KEYS, "output"))
    assert filled.where("status = 'not_found'").count() > 0
    expected = spark.createDataFrame([("p", "A.java", "f", " other(); "), ("p", "F.java", "f", "one();"), ("p", "E.java", "f", "e();"), (None, "N.java", "f", "n();")],
                                     "proj_name string, relative_path string, func_name string, func_body string")
    got = SM.java_match_back(by_place, expected, KEYS, sc, "file_row")
    assert rows_of(got) == rows_of(SM.java_match_back(whole, expected, KEYS)) and got.count() == 4


def test_contract_refill_by_offsets(spark):
    rows = [("p", "1", "contract C {\n  function f() public { a(); }\n  function f(int x) public { b(); }\n}\ncontract C { function g() public { c(); } }\n"),
            ("p", "1", "contract C { function h() public { d(); } }\n"), (None, "2", "contract D { function f() public { e(); } }\n")]
    sc = scanned_files(spark, rows, "solidity")
    whole = SM.contract_functions(sc, KEYS).withColumn("output", F.upper("func_body"))
    by_place = SM.contract_functions(sc, [*KEYS, "file_row"], masked=False, offsets=True).withColumn("output", F.upper("func_body"))
    filled = J.refill_contract(by_place, sc, KEYS, "output", row="file_row")
    assert rows_of(filled) == rows_of(J.refill_contract(whole, sc, KEYS, "output")) and filled.count() == 8


def test_refills_shuffle_no_masked_text(spark):
    """A masked text holds its file, so a shuffle of one a method grows with the square of a file."""
    n = 1500
    text = "class A {\n" + "".join(f"  void f{i}() {{ a{i}(); }}\n" for i in range(n)) + "}\n"
    sc = scanned_files(spark, [("p", "A.java", text)], "java")
    by_place = SM.java_methods(sc, [*KEYS, "file_row"], offsets=True)
    held = by_place.agg(*[F.sum(F.length(F.to_json(F.struct(c)))).alias(c) for c in by_place.columns]).first()
    assert sum(held) < 20 * len(text)


def test_generated_tests_are_not_broadcast(spark):
    runs = spark.createDataFrame([(1, 0, "f"), (2, 0, "g"), (3, 1, "f"), (None, 0, "f"), (4, 0, "f")], "id long, exit_code int, func_name string")
    tests = spark.range(1, 4).select("id", F.concat(F.lit("class T { void t() { f("), F.col("id").cast("string"), F.lit("); } }")).alias("text"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = R.generation_status(runs, tests, ["id"])
        assert "SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString()
        assert {(r.id, r.generate_status) for r in out.collect()} == {(1, True), (2, False), (3, False), (None, False), (4, False)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
