"""Limb arithmetic, batches with a manifest, numbered lines, profiles, benchmark rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codecorpus.functions import limbs as L
from codecorpus.operators import joins as J
from codecorpus.operators import profiles as PF
from codecorpus.operators import synth as SY
from codecorpus.plans import fixtures as X
from codecorpus.sources import batches as BT
from codecorpus.sources import files as FL
from codecorpus.sources import variants as VR


def test_hex_to_decimal(spark):
    r = random.Random(1)
    values = [0, 1, 9, 10**9 - 1, 10**9, 2**24, 2**255, 2**256 - 1] + [r.getrandbits(r.randrange(1, 300)) for _ in range(60)]
    df = spark.createDataFrame([(f"{v:x}",) for v in values] + [("",), (None,), ("000f",)], "h string")
    got = [x[0] for x in df.select(L.text(L.from_hex(F.col("h")))).collect()]
    assert got == [str(v) for v in values] + ["0", None, "15"]


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 7, 8, 9, 64, 104, 128, 255, 256, 300])
def test_low_bits_and_sign(spark, bits):
    r = random.Random(bits)
    values = [r.getrandbits(bits + 40) for _ in range(20)] + [0, 2 ** (bits - 1), 2 ** (bits - 1) - 1, 2**bits - 1]
    width = (bits + 43) // 4
    df = spark.createDataFrame([(f"{v:0{width}x}",) for v in values], "h string").withColumn("own", L.low_bits(F.col("h"), F.lit(bits)))
    got = df.select(L.text(L.from_hex(F.col("own"))), L.signed_text(F.col("own"), F.lit(bits))).collect()
    for v, (u, s) in zip(values, got):
        assert (int(u), int(s)) == (v % 2**bits, v % 2**bits - 2 ** (bits - 1))


def test_typed_inputs_equal_python_integers(spark):
    """All elementary types, arrays, widths that are no multiple of 8, null names and types."""
    types = [*X.PARAM_TYPES, "uint7", "int1", "uint512", "int[0]", None, "mapping(uint => uint)", "bool[12]"]
    rows = [(i, f"k{i}", t) for i, t in enumerate(types)] + [(90, None, "int8")]
    params = spark.createDataFrame(rows, "pos int, name string, type string")
    got = {r.pos: r.value for r in SY.typed_inputs(params, ["pos", "name"], seed=5).collect()}

    def integer(base, key):
        bits = int(base.lstrip("uint") or 256)
        h = b"".join(hashlib.md5(f"{key}:{j}".encode()).digest() for j in range((bits + 127) // 128))
        v = int.from_bytes(h, "big") % 2**bits
        return str(v if base[0] == "u" else v - 2 ** (bits - 1))

    for pos, name, t in rows:
        base = (t or "").split("[")[0]
        key = f"5:{pos}" + (f":{name}" if name else "")
        if base.lstrip("u").startswith("int"):
            n = int(t.split("[")[1][:-1]) if "[" in t else None
            want = integer(base, f"{key}:1") if n is None else "[" + ", ".join(integer(base, f"{key}:{i}") for i in range(1, n + 1)) + "]"
            if n != 0:
                assert got[pos] == want, t
    assert set(got) == {p for p, _, t in rows if t and (t.split("[")[0] in ("bool", "address", "string") or t.split("[")[0].lstrip("u").startswith("int"))}


def test_batches_survive_being_stopped(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(i if i % 7 else None, f"v{i}") for i in range(200)], "k long, v string")
    assert BT.manifest(spark, path).isEmpty()
    with pytest.raises(ValueError):
        BT.read_batches(spark, path)
    assert BT.write_batches(df, ["k"], path, 6, stop_after=2) == [0, 1]
    # A batch that was written but has no entry: its job ended in between.
    df.limit(5).write.parquet(f"{path}/data/2")
    assert BT.read_batches(spark, path).count() < 200
    calls = []

    def process(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rows

    with pytest.raises(RuntimeError):
        BT.write_batches(df, ["k"], path, 6, process)
    assert BT.write_batches(df, ["k"], path, 6, process) == [3, 4, 5]
    assert BT.write_batches(df, ["k"], path, 6) == []
    assert sorted(BT.read_batches(spark, path).collect(), key=str) == sorted(df.collect(), key=str)
    assert BT.manifest(spark, path).agg(F.sum("n")).first()[0] == 200
    with pytest.raises(ValueError):
        BT.write_batches(df, ["k"], path, 7)


def test_lines_of_a_file_that_is_split(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "small.txt").write_bytes("ä\r\n\nlast".encode())
    (tmp_path / "empty.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = FL.numbered_lines(spark, str(tmp_path)).collect()
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 10
    got = {}
    for r in rows:
        got.setdefault(r.file.split("/")[-1], []).append((r.line_no, r.line))
    assert sorted(got["big.txt"]) == list(enumerate(lines))
    assert sorted(got["small.txt"]) == [(0, "ä\r"), (1, ""), (2, "last")] and set(got) == {"big.txt", "small.txt"}


def test_text_files_round_trip(spark, tmp_path):
    rows = [("a.txt", "x\n\ny\n"), ("b c.txt", ""), ("d.txt", None)]
    FL.write_text_files(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "t"), "file", "text")
    got = {(r.file, r.line_no, r.line) for r in FL.numbered_lines(spark, str(tmp_path / "t"), "file").collect()}
    assert got == {("a.txt", 0, "x"), ("a.txt", 1, ""), ("a.txt", 2, "y"), ("a.txt", 3, ""), ("b c.txt", 0, ""), ("d.txt", 0, "")}


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (2, None), (None, "b"), (3, "a"), (3, None)], "`x.y` int, s string")
    got = {r["column"]: tuple(r)[1:] for r in PF.profile(df.withColumnRenamed("x.y", "x")).collect()}
    assert got == {"x": (6, 3, "2", 2), "s": (6, 2, "a", 2)}
    empty = {r["column"]: tuple(r)[1:] for r in PF.profile(df.withColumnRenamed("x.y", "x").where("false")).collect()}
    assert empty == {}
    nulls = spark.createDataFrame([(None,), (None,)], "v string")
    assert [tuple(r) for r in PF.profile(nulls).collect()] == [("v", 2, 0, None, None)]


def test_benchmark_rows_keep_every_output(spark):
    outputs = spark.createDataFrame([("c1", "o1"), ("c2", "o2"), ("c9", "o3"), (None, "o4")], "contract_idx string, output string")
    contracts = spark.createDataFrame([("c1", 1), ("c2", 7)], "contract_idx string, file_source_idx int")
    files = spark.createDataFrame([(1, "text")], "file_source_idx int, file_source string")
    got = {r.output: (r.file_source_idx, r.file_source, r.status) for r in J.benchmark_rows(outputs, contracts, files).collect()}
    assert got == {"o1": (1, "text", "ok"), "o2": (7, None, "no_file"), "o3": (None, None, "no_contract"), "o4": (None, None, "no_contract")}


def test_flat_comment_islands_of_a_long_file(spark):
    """5,000 commented functions of one file: the same rows as the array version has for a short one, in linear time."""
    from codecorpus.operators import spans as S

    code = "contract C {\n" + "".join(f"  // note {i}\n  function f{i}() public {{ x; }}\n" for i in range(5000)) + "}\n"
    files = spark.createDataFrame([(1, code)], "source_idx long, source_code string")
    got = J.commented_functions_flat(S.materialize(S.scan_files(files, "source_code", "solidity")), ["source_idx"])
    assert got.select("func_name", "func_requirement").distinct().count() == 5000


def test_json_arrays_of_differing_objects(spark, tmp_path):
    """A group of a third of all rows is many arrays; absent fields are null; a field of another kind is null."""
    rows = [("hot" if i % 3 == 0 else f"p{i % 5}", i if i % 2 else None, f"t\n\"{i}" if i % 4 else None, [i, i + 1] if i % 7 else []) for i in range(300)]
    path = str(tmp_path / "arrays")
    VR.write_json_arrays(spark.createDataFrame(rows, "p string, n int, t string, l array<int>").coalesce(1), path, "p", 20)
    items = VR.read_json_arrays(spark, path)
    assert VR.fields(items) == "OBJECT<l: ARRAY<BIGINT>, n: BIGINT, t: STRING>"
    got = items.select("p", VR.field("n", "int"), VR.field("t"), VR.field("l", "array<int>"), VR.field("gone")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((*r, None)) for r in rows)
    lines = spark.read.text(path).where("p = 'hot'")
    assert lines.count() > 4
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.json").write_text('{"n": 1}\n[{"n": "two"}, {"n": 3}]\nnot json\n[]\n')
    odd = VR.read_json_arrays(spark, str(tmp_path / "odd")).select(VR.field("n", "int")).collect()
    assert sorted((r.n is None, r.n or 0) for r in odd) == [(False, 1), (False, 3), (True, 0)]
