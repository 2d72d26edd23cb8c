"""Stand-in inputs built from the driver's test tables.

The reference reads crawled repositories, compiler output and test logs.  These
builders turn ``documents`` and ``events`` into tables of that *schema* only:
source files (``sol_files``, ``java_files``) and raw tool logs.  They do none of
the operators' work; every query parses, joins and aggregates what is built
here through the library's own code.  The recipe is in FIXTURES.md §3.

All builders are Column expressions (no Python per row), so they scale with
the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus import constants as K

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Cleaned lines of a document: non [A-Za-z0-9 ] removed, trimmed, empty dropped.
# Runs that stay are joined: replacing the others takes seven times as long.
DOC_LINES = ("filter(transform(split(text, '\\n'), "
             "x -> trim(array_join(regexp_extract_all(x, '[A-Za-z0-9 ]++', 0), ''))), x -> x <> '')")


def doc_lines(documents: DataFrame, *also: str) -> DataFrame:
    """(doc_id, source, *also, ls array<string>) from documents (spread over the
    cluster first when the table arrives in a few large splits).  Documents that
    bring columns ``also`` of a joined table were dealt by that join."""
    from codecorpus.operators.spans import balance
    rows = documents.select("doc_id", "source", "text", *also)
    return (rows if also else balance(rows)).select("doc_id", "source", *also, F.expr(DOC_LINES).alias("ls"))


def _sol_members(suffix: str) -> str:
    """SQL expression of the four members of a base contract with ``suffix``."""
    return (f"concat('  uint256 public s', {suffix}, ';\\n',"
            f" '  uint256 private p', {suffix}, ';\\n',"
            f" '  function g', {suffix}, '() internal {{ return; }}\\n',"
            f" '  function h', {suffix}, '() external {{ return; }}\\n')")


def sol_files(documents: DataFrame, *also: str) -> DataFrame:
    """One Solidity-like source file per document.

    Columns: source_idx long, proj_name string, source_code string, *also.
    Layout: optional interface, an inheritance chain Base<d>_0..Base<d>_<d%4>,
    a diamond side contract for d%10=0, then contract C<d> with one function
    per cleaned line (overloads share f<i div 2>) and comments before some.
    """
    d = "cast(doc_id as string)"
    chain = (
        "array_join(transform(sequence(0, cast(doc_id % 4 as int)), k -> concat("
        f"'contract Base', {d}, '_', k,"
        f" if(k > 0, concat(' is Base', {d}, '_', k - 1), ''), ' {{\\n',"
        + _sol_members(f"concat({d}, '_', k)") + ", '}\\n')), '')"
    )
    iface = (f"if(doc_id % 5 = 1, concat('interface I', {d}, ' {{\\n',"
             f" '  function ping', {d}, '(uint256 x) external returns (bool);\\n}}\\n'), '')")
    side = (f"if(doc_id % 10 = 0, concat('contract Side', {d}, ' is Base', {d}, '_0 {{\\n',"
            f" '  uint256 internal q', {d}, ';\\n',"
            f" '  function m', {d}, '(uint256 v) public virtual returns (uint256) {{ return v; }}\\n',"
            f" '}}\\n'), '')")
    funcs = (
        "array_join(transform(ls, (x, i) -> concat("
        "case i % 3 when 0 then concat('  // note ', i, '\\n')"
        " when 1 then concat('  /* note ', i, ' */\\n  // more ', i, '\\n') else '' end,"
        "'  function f', cast(i div 2 as string), '(uint256 a, address b) public { ', x, ' }\\n')), '')"
    )
    head = (f"concat('contract C', {d}, ' is Base', {d}, '_', cast(doc_id % 4 as string),"
            f" if(doc_id % 10 = 0, concat(', Side', {d}), ''), ' {{\\n')")
    text = (f"concat('pragma solidity ^0.8.0;\\n', {iface}, {chain}, {side}, {head}, {funcs}, '}}\\n')")
    return doc_lines(documents, *also).select(
        F.col("doc_id").alias("source_idx"),
        F.concat(F.lit("own_"), F.col("source")).alias("proj_name"),
        F.expr(text).alias("source_code"), *also)


def java_files(documents: DataFrame) -> DataFrame:
    """One Java-like source file per document.

    Columns: proj_name, relative_path, source_code.  Every fifth document puts
    its last method in a nested class, every seventh has an interface with a
    bodiless method; doc_id%10=9 lives under src/test/java.
    """
    d = "cast(doc_id as string)"
    n = "size(ls)"
    methods = (
        "array_join(transform(ls, (x, i) -> concat("
        f"if(doc_id % 5 = 0 AND i = {n} - 1, concat('  static class N', {d}, ' {{\\n'), ''),"
        "case i % 3 when 0 then concat('  /** note ', i, ' */\\n')"
        " when 1 then concat('  // more ', i, '\\n') else '' end,"
        "'  public void f', cast(i div 2 as string), '(int a, ',"
        f" if(i % 2 = 1, concat('C', cast(doc_id + 7 as string)), 'String'), ' b) {{ ', x, ' }}\\n',"
        f"if(doc_id % 5 = 0 AND i = {n} - 1, '  }}\\n', ''))), '')"
    )
    iface = (f"if(doc_id % 7 = 0, concat('  interface J', {d}, ' {{\\n',"
             f" '    void ping', {d}, '(int a);\\n  }}\\n'), '')")
    text = (
        f"concat('package p', cast(doc_id % 7 as string), ';\\n\\n',"
        f" 'import java.util.List;\\n\\n',"
        f" '/** Class C', {d}, '. */\\n',"
        f" 'public class C', {d}, ' {{\\n',"
        f" '  private int x', {d}, ';\\n',"
        f" '  private static final String NAME', {d}, ' = \"a//b{{\";\\n',"
        f" {methods}, {iface}, '}}\\n')"
    )
    path = _java_path("doc_id")
    return doc_lines(documents).select(
        "doc_id",
        F.concat(F.lit("own_"), F.col("source")).alias("proj_name"),
        F.expr(path).alias("relative_path"),
        F.expr(text).alias("source_code"))


def nested_java_files(documents: DataFrame) -> DataFrame:
    """One Java-like file per document whose lines are bodies of plain methods,
    of methods of anonymous classes and of methods of local classes in turn.
    Columns as in ``java_files``."""
    d = "cast(doc_id as string)"
    one = (
        "case i % 3"
        " when 0 then concat('  void f', i, '(int a) {', ' ', x, ' ', '}\n')"
        " when 1 then concat('  Runnable r', i, ' = new Thread() {\n    public void run', i, '() {', ' ', x, ' ', '}\n  };\n')"
        " else concat('  int g', i, '() {\n    class L', i, ' {\n      String h', i, '(String s) {', ' ', x, ' ',"
        " '}\n    }\n    return 0;\n  }\n') end")
    text = (
        f"concat('package p;\n\npublic class C', {d}, ' {{\n  private int x = \"{{\".length(); // }}\n  C', {d},"
        " '(int a) { super(); }\n', "
        f"array_join(transform(ls, (x, i) -> {one}), ''),"
        f" '  interface J', {d}, ' {{ default void q(int a) {{ return; }} }}\n}}\n')".replace("'(int a) {{", "'(int a) {"))
    return doc_lines(documents).select(
        F.concat(F.lit("own_"), F.col("source")).alias("proj_name"),
        F.expr(_java_path("doc_id")).alias("relative_path"), F.expr(text).alias("source_code"))


#: Parameter types that ``typed_params`` deals out in turn.
PARAM_TYPES = ("uint256", "int256", "uint8", "int8", "uint", "int", "int128[3]", "uint72[2]", "bool", "bool[2]",
               "address", "string", "string[2]", "bytes32", "int104")


def typed_params(documents: DataFrame) -> DataFrame:
    """(source_idx, contract_name, func_name, pos, type, name): two parameter
    declarations per document, of every kind of elementary type and one that is
    not."""
    types = F.array(*[F.lit(t) for t in PARAM_TYPES])
    rows = documents.select(F.col("doc_id").alias("source_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    nth = F.pmod(2 * F.col("source_idx") + F.col("pos"), F.lit(len(PARAM_TYPES))).cast("int")
    return rows.select("source_idx", F.concat(F.lit("C"), "source_idx").alias("contract_name"), F.lit("f").alias("func_name"), "pos",
                       F.get(types, nth).alias("type"), F.concat(F.lit("p"), "pos").alias("name"))


def compiled_classes(java: DataFrame) -> DataFrame:
    """Listing of compiled class files: present for doc_id%4<>3 (FIXTURES §3.2)."""
    return java.where("doc_id % 4 <> 3").select(
        "proj_name",
        F.expr("replace(replace(relative_path, '/src/main/java', '/target/classes'),"
               " '.java', '.class')").alias("class_path"))


# ---------------------------------------------------------------------------
# Tool logs from events (FIXTURES §3.3)
# ---------------------------------------------------------------------------

_KINDS_SQL = "array(" + ", ".join(f"'{k}'" for k in K.SOLIDITY_ERROR_KINDS) + ")"


def solidity_logs(events: DataFrame) -> DataFrame:
    """(event_id, proj_name, stdout, stderr) of one compiler run per event."""
    kind = f"element_at({_KINDS_SQL}, cast(event_id % 9 as int) + 1)"
    err = (
        "case when event_id % 11 = 0 then concat('Error HH600: Compilation failed for run ',"
        " event_id, '\\n\\nsee above')"
        f" else concat({kind}, ': problem ', event_id, '\\n --> contracts/sample.sol:',"
        " event_id % 50 + 1, ':5:', '\\n\\nWarning: unused local variable',"
        " if(event_id % 4 = 0, concat('\\n\\n', "
        f"element_at({_KINDS_SQL}, cast((event_id + 4) % 9 as int) + 1), ': second ', event_id), ''),"
        " '\\n\\nError HH600: Compilation failed') end"
    )
    return events.select(
        "event_id",
        F.concat(F.lit("own_src"), (F.col("user_id") % 20).cast("string")).alias("proj_name"),
        F.expr("concat('Compiling 1 file with 0.8.19\\n',"
               " if(event_type <> 'error', 'Compiled 1 Solidity file successfully\\n', ''))")
        .alias("stdout"),
        F.expr(f"if(event_type = 'error', {err}, '')").alias("stderr"))


def _java_path(doc: str) -> str:
    """SQL expression of the path of a document's Java file (FIXTURES §3.2)."""
    return (f"concat('mod/src/', if({doc} % 10 = 9, 'test', 'main'), '/java/p', cast({doc} % 7 as string),"
            f" '/C', cast({doc} as string), '.java')")


def maven_logs(events: DataFrame, documents: DataFrame, base: str = "/work/projects") -> DataFrame:
    """(event_id, proj_name, relative_path, log) of one Maven build per event.

    An event builds the project of document ``event_id div 5`` (events beyond
    the last document name a file that does not exist).  Error events carry
    1 + event_id%3 error lines, the first about that file, the others about the
    next ones; the first line is repeated, with noise lines in between.
    """
    rows = events.withColumn("doc", F.expr("event_id div 5")).join(
        documents.select(F.col("doc_id").alias("doc"), "source"), "doc", "left")
    proj = "concat('own_', coalesce(source, concat('src', cast(user_id % 20 as string))))"
    line = (
        "j -> concat('[ERROR] ', '" + base + "/', " + proj + ", '/', " + _java_path("(doc + j)") + ","
        " ':[', cast(1 + (event_id + 3 * j) % 12 as string), ',',"
        " cast(1 + (event_id * (j + 1)) % 20 as string), '] ',"
        " element_at(array('cannot find symbol', 'incompatible types: int cannot be converted to String',"
        " '\\';\\' expected', 'missing return statement'), cast((event_id + j) % 4 as int) + 1))"
    )
    errs = f"transform(sequence(0, cast(event_id % 3 as int)), {line})"
    log = (
        "if(event_type = 'error', array_join(concat(array('[INFO] Scanning for projects...'),"
        f" flatten(transform({errs}, e -> array(e, '[INFO] -------------'))),"
        f" array(element_at({errs}, 1), '[INFO] BUILD FAILURE')), '\\n'),"
        " '[INFO] Scanning for projects...\\n[INFO] BUILD SUCCESS')"
    )
    return rows.select(
        "event_id",
        F.expr(proj).alias("proj_name"),
        F.expr(_java_path("doc")).alias("relative_path"),
        F.expr("event_type = 'purchase' AND event_id % 7 = 0").alias("fill_failed"),
        F.expr(log).alias("log"))


def test_logs(events: DataFrame) -> DataFrame:
    """(event_id, proj_name, exit_code, stdout) of one generated-test run per event.

    Stage lines ``k) ... done`` up to 1 + event_id%13; clicks report
    ``FAILURES!!!`` with failing tests ``n) test<k>(RegressionTest0)``.
    """
    stages = ("array_join(transform(sequence(1, cast(1 + event_id % 13 as int)),"
              " k -> concat(k, ') step ', k, ' done')), '\\n')")
    fails = ("array_join(transform(sequence(1, cast(1 + event_id % 3 as int)),"
             " n -> concat(n, ') test', cast((event_id + n) % 10 as string), '(RegressionTest0)')), '\\n')")
    out = (f"concat({stages}, if(event_type = 'click', concat('\\nThere were failures:\\n', {fails},"
           " '\\nFAILURES!!!'), '\\nOK'))")
    return events.select(
        "event_id",
        F.concat(F.lit("own_src"), (F.col("user_id") % 20).cast("string")).alias("proj_name"),
        F.expr("cast(if(event_type in ('click', 'error'), 1, 0) as int)").alias("exit_code"),
        F.expr(out).alias("stdout"))


def test_files(events: DataFrame, *also: str) -> DataFrame:
    """(event_id, *also, test_code): the generated JUnit file of each test run,
    ten test methods ``test0``..``test9``."""
    one = ("'\\n  @Test\\n  public void test', k, '() throws Throwable {\\n    int v = ', k,"
           " ';\\n    if (v > 0) { v--; }\\n  }\\n'")
    body = f"array_join(transform(sequence(0, 9), k -> concat({one})), '')"
    return events.select("event_id", *also, F.expr(
        "concat('package p;\\n\\nimport org.junit.Test;\\n\\npublic class RegressionTest0 {\\n', "
        + body + ", '}\\n')").alias("test_code"))


def varied_test_files(events: DataFrame, *also: str) -> DataFrame:
    """(event_id, *also, test_code): JUnit files that differ by event: 0 to 11 tests,
    annotations with and without arguments, braces in literals, ``@Test`` in
    comments, and methods that are no tests between them."""
    one = ("concat('\n  @Test', if(k % 2 = 1, concat('(timeout = ', event_id, ')'), ''),"
           " '\n  public void test', k, '() throws Throwable {\n    String s = \"}\" + ', event_id * k, '; // @Test\n  }\n',"
           " if(k % 3 = 0, concat('  private int helper', k, '() { return ', event_id, '; }\n'), ''))")
    body = f"if(event_id % 12 = 0, '', array_join(transform(sequence(0, cast(event_id % 12 as int) - 1), k -> {one}), ''))"
    return events.select("event_id", *also, F.expr(
        "concat('package p', event_id % 5, ';\n\nimport org.junit.Test;\n\npublic class RegressionTest0 {\n', " + body + ", '}\n')")
        .alias("test_code"))


def target_listing(java: DataFrame) -> DataFrame:
    """(proj_name, target_dir, name): build outputs found in each module's
    target folder: a fat jar for doc_id%3=0, a plain jar for doc_id%3=1."""
    mod = F.split_part(F.col("relative_path"), F.lit("/src/"), F.lit(1))
    return java.where("doc_id % 3 < 2").select(
        "proj_name", F.concat(mod, F.lit("/target")).alias("target_dir"),
        F.expr("concat('x-', doc_id, if(doc_id % 3 = 0, '-jar-with-dependencies.jar', '.jar'))").alias("name"))
