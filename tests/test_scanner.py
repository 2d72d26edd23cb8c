"""Hand fixtures for the span scanner (FIXTURES.md §4)."""

from codecorpus.operators.scanner import scan


def spans(text, lang="java", **kw):
    return scan(text, lang, **kw)


def by_kind(ss, kind):
    return [s for s in ss if s["kind"] == kind]


def test_javadoc_annotated_constructor_and_overloads():
    src = ("package a.b;\n/** Doc. */\npublic class A {\n  /** ctor */\n  @Deprecated\n"
           "  public A(int x) { this.x = x; }\n  void f(int a) { }\n  void f(String s) { g(); }\n}\n")
    ss = spans(src)
    ctor = by_kind(ss, "constructor")
    assert [c["name"] for c in ctor] == ["A"]
    assert ctor[0]["modifiers"] == "@Deprecated public"
    fs = by_kind(ss, "method")
    assert [f["name"] for f in fs] == ["f", "f"]
    assert [p["type"] for p in fs[1]["params"]] == ["String"]
    assert by_kind(ss, "package")[0]["name"] == "a.b"


def test_literals_with_comment_and_brace_chars():
    src = 'class A {\n  String s = "//{";\n  char c = \'{\';\n  void f() { String t = "}"; }\n}\n'
    ss = spans(src)
    assert not by_kind(ss, "comment")
    f = by_kind(ss, "method")[0]
    assert src[f["body_start"]:f["body_end"]] == ' String t = "}"; '
    assert [x["name"] for x in by_kind(ss, "field")] == ["s", "c"]


def test_nested_class_interface_and_generics():
    src = ("public class O<T> extends B<T> implements I, J {\n  static class N {\n"
           "    <R> java.util.List<R> g(java.util.Map<String, R> m) { return null; }\n  }\n"
           "  interface K { void h(int a); }\n}\n")
    ss = spans(src)
    o, n, k = by_kind(ss, "class")
    assert (o["bases"], o["interfaces"]) == (["B<T>"], ["I", "J"])
    g = [s for s in by_kind(ss, "method") if s["name"] == "g"][0]
    assert g["type"] == "java.util.List<R>" and g["parent_ord"] == n["ord"]
    assert g["params"] == [{"type": "java.util.Map<String, R>", "name": "m"}]
    h = [s for s in by_kind(ss, "method") if s["name"] == "h"][0]
    assert h["body_start"] is None and h["parent_ord"] == k["ord"]


def test_lambda_body_does_not_open_members():
    src = "class A {\n  void f() { run(() -> { int y = 1; }); }\n  void g() { }\n}\n"
    names = [s["name"] for s in by_kind(spans(src), "method")]
    assert names == ["f", "g"]


def test_unterminated_comment_and_final_line_comment():
    ss = spans("class A { void f() { } }\n/* open")
    assert [s["name"] for s in by_kind(ss, "method")] == ["f"]
    ss = spans("class A { }\n// x\n")
    c = by_kind(ss, "comment")[0]
    assert (c["start"], c["end"]) == (12, 16)


def test_crlf_and_non_bmp_offsets():
    src = "class A {\r\n  // 😀 smile\r\n  void f() { x(); }\r\n}\r\n"
    f = by_kind(spans(src), "method")[0]
    assert src[f["body_start"]:f["body_end"]] == " x(); "


def test_tabs_between_modifiers():
    src = "class A {\n  private\tstatic\tint x;\n}\n"
    x = by_kind(spans(src), "field")[0]
    assert x["modifiers"] == "private static" and x["type"] == "int"


def test_solidity_contract_members():
    src = ("pragma solidity ^0.8.0;\nabstract contract A is B(1), C.D {\n  uint256 private p;\n"
           "  mapping(address => uint) public m;\n  function f(string memory s) external view returns (uint) { return 1; }\n"
           "  function g() internal virtual;\n  constructor() { }\n}\n")
    ss = spans(src, "solidity")
    c = by_kind(ss, "contract")[0]
    assert c["name"] == "A" and c["bases"] == ["B", "C.D"]
    vs = by_kind(ss, "state_var")
    assert [(v["name"], v["visibility"]) for v in vs] == [("p", "private"), ("m", "public")]
    f, g = by_kind(ss, "function")
    assert f["params"] == [{"type": "string", "name": "s"}] and f["type"] == "uint"
    assert f["visibility"] == "external" and g["body_start"] is None
    assert by_kind(ss, "constructor")


def test_body_tokens_calls_and_locals():
    src = "class A {\n  void f() { int n = 0; List<String> xs = g(); xs.add(\"a\"); }\n}\n"
    ss = spans(src, body_tokens=True)
    assert sorted((s["name"], s["type"]) for s in by_kind(ss, "local")) == [("n", "int"), ("xs", "List<String>")]
    assert {(s["name"], s["type"]) for s in by_kind(ss, "call")} == {("g", "plain"), ("add", "member")}


def test_java_declaration_forms():
    src = ("public class A {\n"
           "  static { init(); }\n"
           "  enum E { X { void g() { } }, Y; void h() { } }\n"
           "  record R(int a, String b) { R { } int twice() { return a * 2; } }\n"
           "  @interface Ann { String value(); }\n"
           "  Runnable r = new Runnable() { public void run() { } };\n"
           "  int[] xs = {1, 2}, ys;\n"
           "  public <T extends Comparable<T>> T max(java.util.List<? extends T> v) throws Exception { return null; }\n"
           "}\n")
    ss = spans(src)
    classes = {c["name"]: c["type"] for c in by_kind(ss, "class")}
    assert classes == {"A": "class", "E": "enum", "R": "record", "Ann": "annotation"}
    fields = [f["name"] for f in by_kind(ss, "field")]
    assert fields == ["r", "xs", "ys"]
    methods = {m["name"]: m for m in by_kind(ss, "method")}
    assert set(methods) == {"h", "twice", "value", "max"}  # run() and g() live in bodies
    assert methods["max"]["type"] == "T" and methods["max"]["params"][0]["name"] == "v"
    assert methods["value"]["body_start"] is None


def test_solidity_declaration_forms():
    src = ("library L { function add(uint a, uint b) internal pure returns (uint) { return a + b; } }\n"
           "contract A {\n  using L for uint;\n  struct S { uint a; }\n  enum K { P, Q }\n"
           "  event Moved(address indexed who);\n  mapping(address => uint256) public bal;\n"
           "  uint public constant MAX = 10;\n"
           "  modifier only() { require(msg.sender != address(0)); _; }\n"
           "  fallback() external payable { }\n  receive() external payable { }\n"
           "  function f() public only returns (uint) { assembly { let x := 1 } return MAX; }\n}\n")
    ss = spans(src, "solidity")
    assert {c["name"]: c["type"] for c in by_kind(ss, "contract")} == {"L": "library", "A": "contract"}
    assert [v["name"] for v in by_kind(ss, "state_var")] == ["bal", "MAX"]
    assert by_kind(ss, "state_var")[1]["modifiers"] == "constant"
    assert [m["name"] for m in by_kind(ss, "modifier")] == ["only"]
    fs = by_kind(ss, "function")
    assert [f["name"] for f in fs] == ["add", None, None, "f"]
    assert fs[-1]["modifiers"] == "only" and fs[-1]["type"] == "uint"
    assert [s["name"] for s in by_kind(ss, "struct")] == ["S"]


def test_file_without_package_or_class(spark):
    from codecorpus.operators import samples as SM, spans as S
    df = spark.createDataFrame([("p", "X.java", "interface I { default void f() { } }\nenum E { A; void g() { } }\n")],
                               "proj_name string, relative_path string, source_code string")
    sc = S.scan_files(df, "source_code", "java")
    rows = SM.java_methods(sc, ["proj_name", "relative_path"]).collect()
    # interface methods give no row; enums are no classes
    assert [(r["func_name"], r["class_name"], r["status"]) for r in rows] == [("g", None, "no_class")]
    assert SM.java_types(sc, ["proj_name", "relative_path"]).first()["qualified_name"] == "I"


def test_fast_path_equals_full_tokenization():
    """Skipping function bodies must give exactly the spans of the full scan."""
    import random
    from codecorpus.operators import scanner as SC
    rnd = random.Random(3)
    pieces = ["class A {", "contract C is B {", "}", "{", ";", "void f() {", "function g() public {", " x = 1;",
              "\"s{\"", "'}'", "// c\n", "/* b */", "\n", " ", "int y;", "@Ann", "(", ")", "=", "interface I {",
              "enum E {A, B}", "struct S { uint a; }", "uint public v;", "static {", "new R() { void r() { } }",
              "return;", "if (a) { b; }", "x"]
    compared = 0
    for _ in range(4000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        for lang in ("java", "solidity"):
            try:
                fast = SC._scan(t, lang, False, True)
            except SC._Fallback:
                continue
            assert fast == SC._scan(t, lang, False, False), t
            compared += 1
    assert compared > 1000
