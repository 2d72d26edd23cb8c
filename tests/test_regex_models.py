"""The single-regex Spark expressions for E2 and E6 against small Python
models of the loops they replace, on seeded random strings."""

import random
import re

from pyspark.sql import functions as F

from codecorpus.functions import text as TX


def remove_comments_model(src: str) -> str:
    """Scan left to right: ``//`` runs to (not incl.) the next newline, or to
    the end of the text if there is none (then a final newline goes too);
    ``/* ... */`` is removed whole; an unterminated ``/*`` is kept."""
    out, i, n = [], 0, len(src)
    while i < n:
        two = src[i:i + 2]
        if two == "//":
            j = src.find("\n", i + 2)
            if j == -1 or j == n - 1:  # runs to the end: swallow a final newline
                break
            i = j
            continue
        if two == "/*":
            j = src.find("*/", i + 2)
            if j == -1:
                out.append(src[i:])
                break
            i = j + 2
            continue
        out.append(src[i])
        i += 1
    return "".join(out)


def strip_private_model(code: str) -> str:
    """Remove ``private<ws>`` after white space until none is left."""
    while True:
        m = re.search(r"[ \t\n](private[ \t\n])", code)
        if not m:
            return code
        code = code[:m.start(1)] + code[m.end(1):]


def _strings(alphabet, n, size, seed):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size))),) for _ in range(n)]


def test_remove_comments_matches_scanner_model(spark):
    rows = _strings(["/", "*", "\n", "a", " ", "//", "/*", "*/"], 3000, 14, 7)
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(TX.remove_comments(F.col("s"))).collect()]
    bad = [(s, g) for (s,), g in zip(rows, got) if remove_comments_model(s) != g]
    assert not bad, bad[:5]


def test_strip_private_matches_fixed_point_loop(spark):
    rows = _strings(["private", " ", "\t", "\n", "x", "p", "private "], 3000, 10, 11)
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(TX.strip_private(F.col("s"))).collect()]
    bad = [(s, g) for (s,), g in zip(rows, got) if strip_private_model(s) != g]
    assert not bad, bad[:5]


def _layout(rnd, idx):
    """A contract of random segments; returns text and, per function, the
    expected requirement from a direct backward walk."""
    kinds = ["func", "line", "block", "empty_line", "empty_block", "var"]
    segs, text = [], f"contract T{idx} {{\n"
    for k in range(rnd.randint(1, 12)):
        kind = rnd.choice(kinds)
        word = rnd.choice(["alpha", "beta gamma", " spaced ", "x"])
        body = {"func": f"function f{k}() public {{ y{k}; }}", "line": f"// {word}",
                "block": f"/* {word} */", "empty_line": "//", "empty_block": "/**/",
                "var": f"uint public v{k};"}[kind]
        start = len(text)
        text += body
        segs.append((kind, start, len(text), body))
        text += rnd.choice(["\n", "\n\n", " ", "\n  \t"])
        if kind in ("line", "empty_line") and text[-1] != "\n":
            text += "\n"
    text += "}\n"
    expected = {}
    for j, (kind, s, e, body) in enumerate(segs):
        if kind != "func":
            continue
        parts, pos, t = [], s, j - 1
        while t >= 0:
            pk, ps, pe, pb = segs[t]
            if pk not in ("line", "block", "empty_line", "empty_block") or text[pe:pos].strip(" \n\t\r"):
                break
            inner = pb[2:] if pk in ("line", "empty_line") else pb[2:-2]
            parts.append(inner.strip())
            pos, t = ps, t - 1
        req = "\n".join(x for x in reversed(parts) if x)
        if req:
            expected[f"f{j}"] = req
    return text, expected


def test_comment_adjacency_matches_backward_walk(spark):
    from codecorpus.operators import joins as J, spans as S
    rnd = random.Random(5)
    files, want = [], {}
    for i in range(400):
        text, exp = _layout(rnd, i)
        files.append((i, text))
        want.update({(i, k): v for k, v in exp.items()})
    df = spark.createDataFrame(files, "source_idx long, source_code string")
    got = {(r["source_idx"], r["func_name"]): r["func_requirement"]
           for r in J.commented_functions(S.scan_files(df, "source_code", "solidity"), ["source_idx"]).collect()}
    assert got == want


def test_inheritance_matches_python_bfs(spark):
    from codecorpus.operators import joins as J, spans as S
    rnd = random.Random(9)
    files, want = [], {}
    for i in range(120):
        n = rnd.randint(1, 6)
        names = [f"K{i}_{k}" for k in range(n)]
        bases = {nm: rnd.sample(names, rnd.randint(0, min(3, n))) for nm in names}
        text, members = "", {}
        for nm in names:
            vis = rnd.choice(["public", "private", "internal"])
            fvis = rnd.choice(["public", "external", "internal", "private"])
            members[nm] = []
            text += f"contract {nm}" + (f" is {', '.join(bases[nm])}" if bases[nm] else "") + " {\n"
            text += f"  uint256 {vis} s_{nm};\n  function g_{nm}() {fvis} {{ return; }}\n}}\n"
            if vis != "private":
                members[nm].append(f"uint256 {vis} s_{nm};")
            if fvis not in ("external", "private"):
                members[nm].append(f"function g_{nm}() {fvis} {{<BODY>}}")
        files.append((i, text))
        for root in names:
            seen, queue, out = {root}, list(bases[root]), []
            while queue:  # breadth first, each contract once
                b = queue.pop(0)
                if b in seen:
                    continue
                seen.add(b)
                out.extend(members[b])
                queue.extend(bases[b])
            want[(i, root)] = out
    df = spark.createDataFrame(files, "source_idx long, source_code string")
    rows = J.inherited_elements(S.scan_files(df, "source_code", "solidity"), ["source_idx"]).collect()
    got = {(r["source_idx"], r["contract_name"]): list(r["inherit_elements"]) for r in rows}
    assert got == want


def test_flat_comment_adjacency_equals_array_version(spark):
    from codecorpus.operators import joins as J, spans as S
    rnd = random.Random(13)
    files = [(i, _layout(rnd, i)[0]) for i in range(300)]
    sc = S.scan_files(spark.createDataFrame(files, "source_idx long, source_code string"), "source_code", "solidity")
    cols = ["source_idx", "contract_name", "func_name", "masked_contract", "func_body", "func_requirement"]
    a = J.commented_functions(sc, ["source_idx"]).select(*cols)
    b = J.commented_functions_flat(sc, ["source_idx"]).select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
