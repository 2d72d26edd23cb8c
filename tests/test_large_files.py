"""Memory of the sample builders stays linear in one file: many functions in a
single source file, with the session's default heap."""

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import joins as J
from codecorpus.operators import samples as SM
from codecorpus.operators import spans as S

N = 3000


def solidity(n):
    body = "".join(f"  // note {i}\n  function f{i}(uint256 a) public {{ uint256 x = {i}; return x + a; }}\n" for i in range(n))
    return "contract C {\n" + body + "}\n"


def java(n):
    body = "".join(f"  public int f{i}(int a) {{ int x = {i}; return x + a; }}\n" for i in range(n))
    return "public class C {\n" + body + "}\n"


@pytest.fixture(scope="module")
def scanned(spark):
    sol = spark.createDataFrame([(0, solidity(N))], "source_idx long, source_code string")
    jav = spark.createDataFrame([("p", "C.java", java(N))], "proj_name string, relative_path string, source_code string")
    return (S.materialize(S.scan_files(sol, "source_code", "solidity")), S.materialize(S.scan_files(jav, "source_code", "java")))


def checked(df, masked, body):
    """All rows are built; row count and what the texts add up to."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.length(masked)), F.sum(F.length(body))).first())


def test_function_and_method_samples(scanned):
    sol, jav = scanned
    size = len(solidity(N)) - 1  # without the final line end
    n, masked, bodies = checked(SM.contract_functions(sol, ["source_idx"]), "masked_contract", "func_body")
    assert n == N and masked == N * (size + len("<FILL_FUNCTION_BODY>")) - bodies
    n, masked, whole = checked(SM.contract_functions(sol, ["source_idx"], whole=True), "masked_contract", "function")
    assert n == N and masked == N * (size + len("<FILL_FUNCTION>")) - whole
    n, masked, bodies = checked(SM.java_methods(jav, ["proj_name"]), "masked_class", "func_body")
    # The class text starts at its keyword.
    assert n == N and masked == N * (len(java(N)) - 1 - len("public ") + len("<FILL_FUNCTION_BODY>")) - bodies


def test_commented_functions(scanned):
    n, masked, bodies = checked(J.commented_functions(scanned[0], ["source_idx"]), "masked_contract", "func_body")
    assert n == N and masked == N * (len(solidity(N)) - 1 + len("<FILL_FUNCTION_BODY>")) - bodies


def test_members_of_many_contracts(spark):
    text = "".join(f"contract B{i} {'is B%d ' % (i - 1) if i % 50 else ''}{{\n  uint256 public s{i};\n}}\n" for i in range(2000))
    df = spark.createDataFrame([(0, text)], "source_idx long, source_code string")
    rows = J.inherited_elements(S.scan_files(df, "source_code", "solidity"), ["source_idx"]).collect()
    assert len(rows) == 2000 and sorted({len(r.inherit_elements) for r in rows}) == list(range(50))
