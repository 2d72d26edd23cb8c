"""Property checks: identities and invariants of the operators."""

from pyspark.sql import functions as F

from codecorpus.functions import text as TX
from codecorpus.operators import joins as J, samples as SM, sampling as G, spans as S, training as TR
from codecorpus.plans import fixtures as X

SMALL = "/root/testdata/sf0.001"


def _sol(spark):
    return S.scan_files(X.sol_files(X.table(spark, SMALL, "documents")), "source_code", "solidity")


def test_splice_of_cut_is_identity(spark):
    sc = _sol(spark)
    fns = SM.contract_functions(sc, ["source_idx"])
    c = SM.contracts(sc, ["source_idx"])
    j = fns.join(c, ["source_idx", "contract_name"])
    bad = j.where(TX.fill_marker(F.col("masked_contract"), F.col("func_body")) != F.col("contract_source"))
    assert bad.count() == 0


def test_remove_comments_idempotent(spark):
    f = X.sol_files(X.table(spark, SMALL, "documents"))
    once = f.select(TX.remove_comments(F.col("source_code")).alias("a"))
    assert once.where(TX.remove_comments(F.col("a")) != F.col("a")).count() == 0


def test_spans_nest_or_are_disjoint(spark):
    sp = S.extract_spans(X.java_files(X.table(spark, SMALL, "documents")), ["relative_path"])
    a = sp.where("kind in ('class','method')").alias("a")
    b = sp.where("kind in ('class','method')").alias("b")
    cross = a.join(b, (F.col("a.relative_path") == F.col("b.relative_path")) & (F.col("a.ord") < F.col("b.ord")))
    overlap = cross.where("a.start < b.start and b.start < a.end and a.end < b.end")
    assert overlap.count() == 0


def test_shards_partition_input(spark):
    d = X.table(spark, SMALL, "documents").select("doc_id")
    s = G.shard(d, ["doc_id"], 3)
    assert s.count() == d.count() == s.select("doc_id").distinct().count()
    sizes = sorted(r[1] for r in s.groupBy("shard").count().collect())
    assert max(sizes) - min(sizes) <= (d.count() + 2) // 3


def test_capped_sample_subset_and_bounded(spark):
    d = X.table(spark, SMALL, "documents").select("doc_id", "source")
    s = G.capped_sample(d, "source", "doc_id", 3)
    assert s.groupBy("source").count().where("count > 3").count() == 0
    assert s.join(d, ["doc_id", "source"], "left_anti").count() == 0


def test_labels_equal_ids_after_prefix_and_batches_padded(spark):
    rows = TR.instruction_rows(X.table(spark, SMALL, "conversations")).select(
        "conv_id", "turn", TR.instruction_prompt(F.col("instruction")).alias("s"),
        TR.target(F.col("output")).alias("t"))
    m = TR.loss_masked(rows, "s", "t")
    bad = m.where(F.slice("labels", F.col("source_len") + 1, 100000)
                  != F.slice("input_ids", F.col("source_len") + 1, 100000))
    assert bad.count() == 0
    b = TR.padded_batches(m, ["conv_id", "turn"], 4)
    assert b.groupBy("batch").agg(F.countDistinct(F.size("input_ids")).alias("k")).where("k > 1").count() == 0


def test_inheritance_terminates_on_cycles(spark):
    src = ("contract A is B { uint256 public a; }\ncontract B is A { uint256 public b; }\n"
           "contract C is A, B { function f() public { } }\n")
    df = spark.createDataFrame([(1, src)], "source_idx long, source_code string")
    sc = S.scan_files(df, "source_code", "solidity")
    out = {r["contract_name"]: list(r["inherit_elements"]) for r in J.inherited_elements(sc, ["source_idx"]).collect()}
    assert out["C"] == ["uint256 public a;", "uint256 public b;"]
    assert out["A"] == ["uint256 public b;"]


def test_typed_inputs_ranges_and_determinism(spark):
    src = ("contract A {\n  function f(uint8 a, int16 b, bool c, address d, string memory e, uint256[3] memory g,"
           " bytes32 h) public { }\n}\n")
    df = spark.createDataFrame([(7, src)], "source_idx long, source_code string")
    from codecorpus.operators import synth as SY
    from codecorpus import constants as K
    sc = S.scan_files(df, "source_code", "solidity")
    params = SY.function_params(sc, ["source_idx"])
    rows = {r["name"]: r["value"] for r in SY.typed_inputs(params, ["source_idx", "func_name", "pos"]).collect()}
    assert set(rows) == {"a", "b", "c", "d", "e", "g"}  # bytes32 is not elementary here
    assert 0 <= int(rows["a"]) < 256 and -32768 <= int(rows["b"]) < 32768
    assert rows["c"] in ("true", "false") and rows["d"] in K.ADDRESSES
    assert len(rows["e"]) == 10 and all(32 <= ord(ch) <= 126 for ch in rows["e"])
    g = rows["g"].strip("[]").split(", ")
    assert len(g) == 3 and all(0 <= int(x) < 2 ** 256 for x in g)
    again = {r["name"]: r["value"] for r in SY.typed_inputs(params, ["source_idx", "func_name", "pos"]).collect()}
    assert again == rows


def test_batched_map_and_group_partitioning(spark):
    import pandas as pd
    d = X.table(spark, SMALL, "documents").select("doc_id", "text")
    out = TR.batched_map(d, lambda pdf: pd.DataFrame({"doc_id": pdf["doc_id"], "n": pdf["text"].str.len()}),
                         "doc_id long, n long", batch_size=50)
    assert out.count() == d.count() and out.columns == ["doc_id", "n"]
    g = G.by_group(X.table(spark, SMALL, "documents").select("source"), "source", 4)
    per = g.select("source", F.spark_partition_id().alias("p")).distinct().groupBy("source").count()
    assert per.where("count > 1").count() == 0


def test_weighted_and_uniform_choice_frequencies(spark):
    rows = [(g, k, float(k)) for g in range(4000) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "g long, k long, w double")
    picked = G.weighted_choice(df, "g", "k", "w", seed=11, cols=["k"])
    freq = {r["k"]: r["count"] / 4000 for r in picked.groupBy("k").count().collect()}
    for k in (1, 2, 3, 4):
        assert abs(freq.get(k, 0) - k / 10) < 0.03, freq
    uni = G.uniform_choice(df, "g", "k", seed=0, cols=["k"])
    ufreq = {r["k"]: r["count"] / 4000 for r in uni.groupBy("k").count().collect()}
    for k in (1, 2, 3, 4):
        assert abs(ufreq.get(k, 0) - 0.25) < 0.03, ufreq
    zero = spark.createDataFrame([(1, 1, 0.0), (1, 2, 5.0)], "g long, k long, w double")
    assert [r["k"] for r in G.weighted_choice(zero, "g", "k", "w", cols=["k"]).collect()] == [2]


def test_flat_members_view_and_last_method_text(spark):
    src = ("class A {\n  void f(int a) { one(); }\n  static class B { void g() { } }\n"
           "  void f(String s) { two(); }\n}\n")
    df = spark.createDataFrame([("p", "A.java", src)], "proj_name string, relative_path string, source_code string")
    keys = ["proj_name", "relative_path"]
    flat = S.extract_spans(df, keys, "source_code", "java")
    m = S.members(flat, keys, "class", ["method"])
    assert sorted((r["container"], r["name"]) for r in m.collect()) == [("A", "f"), ("A", "f"), ("B", "g")]
    last = SM.last_method_text(SM.java_method_table(S.scan_files(df, "source_code", "java"), keys), keys)
    got = {r["name"]: r["raw"] for r in last.collect()}
    assert got == {"f": "void f(String s) { two(); }", "g": "void g() { }"}


def test_odd_log_values_do_not_fail(spark):
    from codecorpus.functions import logs as L
    from codecorpus.operators import results as R
    logs = spark.createDataFrame([
        (1, "p", "r.java", "<file>p/r.java<line>99999999999<col>1<err>x\nnoise", "a\nb"),
        (2, "p", "r.java", None, "x")], "id long, proj_name string, relative_path string, fb string, src string")
    files = logs.select("relative_path", F.col("src").alias("source_code")).dropDuplicates(["relative_path"])
    out = R.enrich_feedback(logs.select("id", "proj_name", "relative_path", F.col("fb").alias("compiler_feedback")),
                            files, ["relative_path"]).orderBy("id").collect()
    assert out[0]["new_compiler_feedback"] == "<file>p/r.java<line>99999999999<col>1<err>x"
    st = spark.createDataFrame([("99999999999) step done\n3) step done",), ("nothing",)], "s string")
    assert [r[0] for r in st.select(L.stage_reached(F.col("s"))).collect()] == [3, 0]


def test_plugin_tokenizer_matches_default_counts(spark):
    import re
    from codecorpus import constants as K
    d = X.table(spark, SMALL, "documents").select("doc_id", "text").limit(50)
    tok = lambda xs: [[1] * len(re.findall(K.RE_TOKEN, x)) for x in xs]
    out = d.select(TR.token_count(F.col("text")).alias("a"), TR.token_count(F.col("text"), tok).alias("b"))
    assert out.where("a <> b").count() == 0
