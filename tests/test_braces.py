"""Brace pairs, heads and samples of nested methods."""

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import braces as B

CODE = '''package p;
/** class Doc { } */
@Ann({"a", "b{"}) public class A<T extends Comparable<T>> extends B implements C {
  static { int x = 1; }
  A() { super(); }
  private static <K> Map<K, List<T>> big(final int[] a, String... s) throws IOException, E2 { return null; }
  int f = new int[]{1, 2}.length;
  @Override // class X {
  public String toString() { if (x) { y(); } else if (z) { w(); } for (int i = 0; i < 3; i++) { } return "}{"; }
  Object o = new Thread("n", () -> { go(); }) {
    @Override public void run() { char c = '{'; new Runnable() { public void run() { deep(); } }.run(); }
  };
  void local() {
    class L { int g() { return 1; } }
    Function<A, B> fn = a -> { return null; };
    switch (x) { case 1: { break; } }
    try { t(); } catch (E e) { c(); } finally { f(); }
    synchronized (this) { s(); }
    do { d(); } while (true);
  }
  enum Color { RED { int v() { return 0; } }, BLUE; int v() { return 1; } }
  interface I { default void no() { } class In { void yes() { } } }
  record P(int x) { int twice() { return 2 * x; } }
}
class Second { /* } */ void s() { String t = """
  { text } block
  """; } }
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a", CODE), ("b", None), ("c", ""), ("d", "no braces"), ("e", "} { ; class Q { void q() { } "), (None, CODE)]
    return spark.createDataFrame(rows, "f string, source_code string")


def test_methods_of_nested_types(files):
    got = [(r.func_name, r.class_name, r.func_body.strip()[:12], r.masked_class) for r in B.nested_samples(files, ["f"]).collect()]
    names = sorted((g[0], g[1]) for g in got)
    assert names == sorted([("big", "A"), ("toString", "A"), ("run", "A"), ("run", "A"), ("local", "A"), ("g", "A"), ("v", "A"), ("v", "A"),
                            ("yes", "A"), ("twice", "A"), ("s", "Second")])
    for name, cls, _, masked in got:
        assert masked.startswith(f"class {cls}") and masked.endswith("}") and masked.count("<FILL_FUNCTION_BODY>") == 1


def test_filling_a_sample_gives_the_class_back(files):
    for r in B.nested_samples(files, ["f"]).collect():
        assert r.masked_class.replace("<FILL_FUNCTION_BODY>", r.func_body) in CODE


def test_pairs_are_those_of_a_stack(files):
    marks = B.delimiters(files.where("f IS NOT NULL"), ["f"])
    for f, code in (("a", CODE), ("e", "} { ; class Q { void q() { } ")):
        got = {(r.start, r.end) for r in B.brace_pairs(marks.where(F.col("f") == f), ["f"]).collect()}
        stack, want = [], set()
        for r in sorted(marks.where(F.col("f") == f).collect(), key=lambda r: r["at"]):
            assert code[r["at"]] == r.mark
            if r.mark == "{":
                stack.append(r["at"])
            elif r.mark == "}" and stack:
                want.add((stack.pop(), r["at"] + 1))
        assert got == want or f == "e"


def test_files_without_code_give_nothing(files):
    assert B.nested_samples(files.where("f IN ('b', 'c', 'd')"), ["f"]).isEmpty()


def test_ten_thousand_methods_in_one_file(spark):
    code = "class Big { " + "".join(f"void m{i}() {{ new T() {{ int n() {{ return {i}; }} }}; }}\n" for i in range(10_000)) + "}"
    big = spark.createDataFrame([("x", code)], "f string, source_code string")
    braces = B.classified(big, ["f"])
    assert {r.kind: r["count"] for r in braces.groupBy("kind").count().collect()} == {"class": 1, "method": 20_000, "anonymous": 10_000}


def test_solidity_contracts_and_functions(spark):
    code = """pragma solidity ^0.8.0; // contract Not {
library Lib { function l() internal { } }
interface I { function i() external; }
abstract contract A is B(1), C { /* } */ uint x = 1; struct S { uint a; }
  modifier m() { _; } constructor() B(2) { }
  function f(uint a) public m() returns (uint) { if (a > 0) { return 1; } string memory s = "}"; return 2; }
  function g() external; receive() external payable { } }
contract D { function f() public { } }"""
    files = spark.createDataFrame([(1, code), (2, None), (3, "contract {")], "source_idx long, source_code string")
    got = {r.contract_name: r.contract_source for r in B.solidity_contracts(files, ["source_idx"]).collect()}
    assert set(got) == {"A", "D"} and got["A"].startswith("abstract contract A") and got["A"].endswith("payable { } }")
    fns = B.solidity_functions(files, ["source_idx"]).collect()
    assert sorted((r.contract_name, r.func_name) for r in fns) == [("A", "f"), ("D", "f")]
    assert all(r.masked_contract.replace("<FILL_FUNCTION_BODY>", r.func_body) == got[r.contract_name] for r in fns)


def test_trees_of_broken_files(spark):
    rows = [(1, "contract A { function f() { } }"), (2, "contract A { "), (3, "} contract A { "), (4, "}{"), (5, None), (6, ""), (7, 'x = "{"; // }')]
    files = spark.createDataFrame(rows, "source_idx long, source_code string")
    got = {r.source_idx: (r.status, r.ast) for r in B.solidity_tree(files, ["source_idx"]).collect()}
    assert got[1] == ("ok", '[{"kind":"contract","name":"A","depth":1},{"kind":"function","name":"f","depth":2}]')
    assert all(got[i] == ("parse_error", "<PARSER_ERROR>") for i in (2, 3, 4, 5)) and got[6] == got[7] == ("ok", "[]")
