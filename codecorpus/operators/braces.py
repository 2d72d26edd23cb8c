"""D1, D13 and H16 without a scanner: classes and methods, also those inside
bodies (anonymous and local classes), from braces alone.

A file is cut into tokens by one regular expression (comments, literals,
delimiters, the rest).  Windows over a file's tokens give every delimiter its
offset (running sum of lengths) and depth (running sum of braces).  Braces pair
without a stack: at one depth opening and closing ones take turns, so a brace
closes with the next one of its depth.  The text between a brace and the
delimiter before it is its head, and column expressions tell from the head
whether it opens a type, an anonymous class, a method or a mere block.  What
contains what is left to the interval join (``intervals``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codecorpus import constants as K
from codecorpus.operators import intervals
from codecorpus.operators.samples import _explode_cut, cut

_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_LITERAL = r"\"\"\"[\s\S]*?\"\"\"|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
TOKEN = rf"{_COMMENT}|{_LITERAL}|[{{}};()]|[^/\"'{{}};()]++|[/\"']"
_BLANKED = rf"^(?:{_COMMENT}|{_LITERAL})$"

_TYPE = r"(?<![\w.$])(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)"
_ANONYMOUS = r"(?s)(?<![\w.$])new\s+[\w$.]+\s*(?:<[^(){};]*>)?\s*\(.*\)\s*$"
_ANNOTATION = r"@[\w$.]+\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?"
_METHOD = (r"(?s)^([\w$.<>\[\],?&\s]+[\s>\]])([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?:\[\s*\]\s*)*"
           r"(?:throws\s+[\w$.,\s<>]+)?$")
_MODIFIER = r"(?<![\w$])(?:public|protected|private|static|final|abstract|native|synchronized|strictfp|default)(?![\w$])|^\s*<[^()]*>(?=\s)"
_NOT_A_TYPE = r"(?<![\w$])(?:new|return|throw|else|case|do|try|assert)(?![\w$])"
_NOT_A_NAME = ("if", "for", "while", "switch", "catch", "synchronized", "try", "super", "this")
_CONSTANT = r"(?s)^[,\s]*(?!(?:static|do|try|else|finally)\s*$)[A-Za-z_$][\w$]*\s*(?:\(.*\)\s*)?$"
_SOLIDITY_TYPE = r"(?<![\w.$])(?:abstract\s+)?(contract|interface|library)\s+([A-Za-z_$][\w$]*)"
_SOLIDITY_FUNCTION = r"(?<![\w$])function\s+([A-Za-z_$][\w$]*)\s*\("
TYPE_KINDS = ("class", "enum", "record", "anonymous", "constant")


def _pieces(text: str) -> Column:
    """Length and, of a delimiter or parenthesis, the character of every token."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), F.when(t.isin("{", "}", ";", "(", ")"), t).alias("mark")))


def delimiters(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """``keys, at, mark, depth, before`` of every ``{``, ``}`` and ``;`` outside
    comments and literals: offset, character, depth of the braces (of a pair the
    same), and where its head begins: behind the last delimiter, or opening
    parenthesis, that stands in the same parentheses."""
    rows = files.select(*keys, F.posexplode_outer(_pieces(text)).alias("i", "p")).select(*keys, "i", "p.n", "p.mark")
    w = Window.partitionBy(*keys).orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("mark") == "{", 1).when(F.col("mark") == "}", -1).otherwise(0)
    inner = F.when(F.col("mark") == "(", 1).when(F.col("mark") == ")", -1).otherwise(0)
    placed = rows.withColumn("end", F.sum("n").over(upto)).withColumn("_depth", F.sum(step).over(upto)) \
        .withColumn("_inner", F.sum(inner).over(upto)).where("mark <> ')'")
    depth = F.col("_depth") + F.when(F.col("mark") == "}", 1).otherwise(0)
    before = F.lag("end").over(Window.partitionBy(*keys, "_inner").orderBy("i"))
    placed = placed.withColumn("before", F.coalesce(before, F.lit(0)))
    return placed.where("mark <> '('").select(*keys, (F.col("end") - 1).cast("int").alias("at"), "mark", depth.cast("int").alias("depth"),
                                              F.col("before").cast("int").alias("before"))


def brace_pairs(marks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, end, depth, head_start`` of every pair of braces: its span
    (half open), and where the head of the first begins.  An opening brace
    that nothing closes has no pair."""
    w = Window.partitionBy(*keys, "depth").orderBy("at")
    paired = marks.where("mark <> ';'").withColumn("_next", F.lead(F.struct("at", "mark")).over(w))
    return paired.where("mark = '{' AND _next.mark = '}'").select(
        *keys, F.col("at").alias("start"), (F.col("_next.at") + 1).alias("end"), "depth", F.col("before").alias("head_start"))


def _blanked(head: Column) -> Column:
    """A head of the same length, comments and literals replaced by blanks."""
    parts = F.regexp_extract_all(head, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(_BLANKED), F.repeat(F.lit(" "), F.length(t))).otherwise(t)), "")


def heads(files: DataFrame, keys: list[str], text: str = "source_code", marks: DataFrame | None = None) -> DataFrame:
    """``keys, start, end, depth, head_start, head`` of every pair of braces:
    the head's comments and literals are blanks.  Each file's text is joined
    once with its pairs."""
    pairs = brace_pairs(delimiters(files, keys, text) if marks is None else marks, keys)
    per_file = pairs.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "depth", "head_start")).alias("_pairs"))
    rows = files.select(*keys, F.col(text).alias("_text")).join(per_file, keys).select(*keys, "_text", F.inline_outer("_pairs"))
    # Heads are cut in the stage that multiplies the rows, so that it hands on no row with a whole text.
    raw = F.col("_raw")
    cuts = rows.withColumn("_raw", cut(F.col("_text"), F.col("head_start"), F.col("start"))).drop("_text")
    return cuts.withColumn("head", F.when(F.length(raw) > 0, _blanked(raw)).otherwise("")).drop("_raw")


PAIRS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "depth", "head_start")]))


@F.pandas_udf(PAIRS)
def _paired_on_row(lengths: pd.Series, marks: pd.Series) -> pd.Series:
    """``delimiters`` and ``brace_pairs`` of one file from its tokens in order:
    the same running sums of lengths, braces and parentheses, and a brace
    closes with the next one of its depth."""
    def pairs(ns, ms):
        if ns is None:
            return None
        end = depth = inner = 0
        behind, opened, out = {}, {}, []  # end of the last delimiter by parentheses; opening brace by depth
        for n, m in zip(ns, ms):
            end += n
            if m is None:
                continue
            if m == ")":
                inner -= 1
                continue
            inner += m == "("
            depth += m == "{"
            before = behind.get(inner, 0)
            behind[inner] = end
            if m == "{":
                opened[depth] = (end - 1, before)
            elif m == "}":
                first = opened.pop(depth, None)
                if first:
                    out.append({"start": first[0], "end": end, "depth": depth, "head_start": first[1]})
                depth -= 1
        return out

    return pd.Series([pairs(n, m) for n, m in zip(lengths, marks)], dtype="object")


def heads_on_row(files: DataFrame, text: str = "source_code") -> DataFrame:
    """Files with ``_heads``, what ``heads`` gives for files whose keys no other
    file has, as an array: everything is worked out on the file's own row."""
    from codecorpus.session import ship_library
    ship_library(files.sparkSession)
    df = files.withColumn("_p", _pieces(text))
    df = df.withColumn("_pairs", _paired_on_row(F.col("_p.n"), F.col("_p.mark"))).drop("_p")
    return df.withColumn("_heads", F.transform("_pairs", lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), p["depth"].alias("depth"), p["head_start"].alias("head_start"),
        F.when(p["head_start"] < p["start"], _blanked(cut(F.col(text), p["head_start"], p["start"]))).otherwise("").alias("head")))).drop("_pairs")


def _samples_on_row(files: DataFrame, keys: list[str], kind: str, member_of: tuple[str, ...], outermost: str, text: str) -> DataFrame:
    """``intervals.method_samples`` for files that carry their ``_braces``."""
    df = files.withColumn("_around", intervals.enclosing_on_row(
        F.col("_braces.start"), F.col("_braces.end"), F.transform("_braces", lambda x: x["kind"] == outermost)))
    at = lambda i: F.try_element_at("_braces", i + 1)
    found = F.zip_with("_braces", "_around", lambda x, y: F.struct(x.alias("x"), at(y["outermost"]).alias("c"), at(y["innermost"])["kind"].alias("inside")))
    found = F.filter(found, lambda m: (m["x"]["kind"] == kind) & F.coalesce(m["inside"], F.lit("")).isin(*member_of))
    df = df.withColumn("_methods", F.transform(found, lambda m: F.struct(
        m["x"]["start"].alias("ord"), m["c"]["name"].alias("class_name"), m["x"]["name"].alias("func_name"),
        (m["x"]["start"] + 1).alias("_a"), (m["x"]["end"] - 1).alias("_b"), m["c"]["kw_start"].alias("_c_start"), m["c"]["end"].alias("_c_end"))))
    return intervals.cut_samples(df.select(*keys, text, "_methods"), keys, text)


def _kind_java(head: Column, type_kind: Column, plain: Column, result: Column, name: Column) -> tuple[Column, Column]:
    """Kind of a pair of braces, and whether it is a method, from its head and
    what was cut from that."""
    typed = F.regexp_replace(result, _MODIFIER, " ").rlike(r"\S")
    is_method = (name != "") & ~name.isin(*_NOT_A_NAME) & typed & ~result.rlike(_NOT_A_TYPE)
    kind = (F.when(type_kind != "", type_kind).when(head.rlike(_ANONYMOUS), F.lit("anonymous"))
            .when(is_method, F.lit("method")).when(plain.rlike(_CONSTANT), F.lit("constant")).otherwise(F.lit("block")))
    return kind, is_method


def nested_samples_on_row(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """What ``nested_samples`` gives for files whose keys no other file has:
    every step on the file's own row, without a join or a window."""
    df = heads_on_row(files, text)
    # a step a column: lambdas do not share what they work out
    df = df.withColumn("_heads", F.transform("_heads", lambda h: F.struct(h.alias("h"), F.trim(F.regexp_replace(h["head"], _ANNOTATION, " ")).alias("plain"))))
    df = df.withColumn("_heads", F.transform("_heads", lambda x: F.struct(
        x["h"].alias("h"), x["plain"].alias("plain"), F.regexp_extract(x["h"]["head"], _TYPE, 1).alias("type_kind"), F.regexp_extract(x["h"]["head"], _TYPE, 2).alias("type_name"),
        F.regexp_extract(x["plain"], _METHOD, 1).alias("result"), F.regexp_extract(x["plain"], _METHOD, 2).alias("name"))))

    def brace(x):
        h, typed = x["h"], x["type_kind"] != ""
        kind, _ = _kind_java(h["head"], x["type_kind"], x["plain"], x["result"], x["name"])
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), kind.alias("kind"), F.when(typed, x["type_name"]).otherwise(x["name"]).alias("name"),
                        F.when(typed, h["head_start"] + F.regexp_instr(h["head"], F.lit(_TYPE)) - 1).cast("int").alias("kw_start"))

    return _samples_on_row(df.withColumn("_braces", F.transform("_heads", brace)), keys, "method", TYPE_KINDS, "class", text)


def solidity_functions_on_row(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """What ``solidity_functions`` gives for files whose keys no other file has:
    every step on the file's own row, without a join or a window."""
    df = heads_on_row(files, text)
    df = df.withColumn("_heads", F.transform("_heads", lambda h: F.struct(
        h.alias("h"), F.regexp_extract(h["head"], _SOLIDITY_TYPE, 1).alias("kind"), F.regexp_extract(h["head"], _SOLIDITY_TYPE, 2).alias("name"),
        F.regexp_extract(h["head"], _SOLIDITY_FUNCTION, 1).alias("function"))))

    def brace(x):
        h, typed, function = x["h"], x["kind"] != "", x["function"]
        kind = F.when(typed, x["kind"]).when(function != "", F.lit("function")).otherwise(F.lit("block"))
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), kind.alias("kind"), F.when(typed, x["name"]).otherwise(function).alias("name"),
                        F.when(typed, h["head_start"] + F.regexp_instr(h["head"], F.lit(_SOLIDITY_TYPE)) - 1).cast("int").alias("kw_start"))

    found = _samples_on_row(df.withColumn("_braces", F.transform("_heads", brace)), keys, "function", ("contract",), "contract", text)
    return found.select(*keys, F.col("class_name").alias("contract_name"), "func_name", "func_body", F.col("masked_class").alias("masked_contract"))


def classified(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """``keys, start, end, depth, kind, name, kw_start`` of every pair of
    braces of Java files.  ``kind``: class, interface, enum, record, anonymous, method,
    constant (of an enum; constructors look alike) or block; ``name`` of types and methods; ``kw_start`` is the offset of a
    type's keyword."""
    known = heads(files, keys, text)
    plain = F.trim(F.regexp_replace("head", _ANNOTATION, " "))
    known = known.withColumn("_plain", plain)
    head, p = F.col("head"), F.col("_plain")
    type_kind, type_name = F.regexp_extract(head, _TYPE, 1), F.regexp_extract(head, _TYPE, 2)
    result, name = F.regexp_extract(p, _METHOD, 1), F.regexp_extract(p, _METHOD, 2)
    kind, is_method = _kind_java(head, type_kind, p, result, name)
    return known.select(*keys, "start", "end", "depth", kind.alias("kind"), F.when(type_kind != "", type_name).when(is_method, name).alias("name"),
                        F.when(type_kind != "", F.col("head_start") + F.regexp_instr(head, F.lit(_TYPE)) - 1).cast("int").alias("kw_start"))


def nested_samples(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """D1 + F5 + E8 + H16 for every method with a body, those of anonymous and
    local classes included: ``class_name`` (of the outermost class),
    ``func_name``, ``masked_class``, ``func_body``, ``status``.

    A method stands directly in a class, enum, record, anonymous class or
    constant; interfaces and blocks give none, and neither do constructors.
    """
    from codecorpus.session import checkpoint
    braces = checkpoint(classified(files, keys, text))
    methods = braces.where("kind = 'method'").select(
        *keys, F.col("start").alias("ord"), "name", "start", "end", (F.col("start") + 1).alias("body_start"), (F.col("end") - 1).alias("body_end"))
    return intervals.method_samples(files, braces.drop("depth"), methods, keys, text, TYPE_KINDS)


def solidity_braces(files: DataFrame, keys: list[str], text: str = "source_code", marks: DataFrame | None = None) -> DataFrame:
    """As ``classified``, for Solidity: contract, interface, library, function or block."""
    head = F.col("head")
    kind, name, function = F.regexp_extract(head, _SOLIDITY_TYPE, 1), F.regexp_extract(head, _SOLIDITY_TYPE, 2), F.regexp_extract(head, _SOLIDITY_FUNCTION, 1)
    typed = kind != ""
    return heads(files, keys, text, marks).select(
        *keys, "start", "end", "depth", F.when(typed, kind).when(function != "", F.lit("function")).otherwise(F.lit("block")).alias("kind"),
        F.when(typed, name).when(function != "", function).alias("name"),
        F.when(typed, F.col("head_start") + F.regexp_instr(head, F.lit(_SOLIDITY_TYPE)) - 1).cast("int").alias("kw_start"))


def solidity_contracts(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """D3 + C5: one row per contract (kind contract only) with its source."""
    found = solidity_braces(files, keys, text).where("kind = 'contract'")
    per_file = found.groupBy(*keys).agg(F.collect_list(F.struct(F.col("name").alias("contract_name"), F.col("kw_start").alias("_a"),
                                                                F.col("end").alias("_b"))).alias("_contracts"))
    both = files.select(*keys, text).join(per_file, keys)
    return _explode_cut(both, keys, F.col("_contracts"), text, lambda t: [
        "contract_name", cut(t, F.col("_a"), F.col("_b")).alias("contract_source")])


def solidity_functions(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """Functions with a body that stand in a contract, their body, and the contract with that body masked."""
    from codecorpus.session import checkpoint
    braces = checkpoint(solidity_braces(files, keys, text))
    functions = braces.where("kind = 'function'").select(
        *keys, F.col("start").alias("ord"), "name", "start", "end", (F.col("start") + 1).alias("body_start"), (F.col("end") - 1).alias("body_end"))
    found = intervals.method_samples(files, braces.drop("depth"), functions, keys, text, ("contract",), "contract")
    return found.select(*keys, F.col("class_name").alias("contract_name"), "func_name", "func_body", F.col("masked_class").alias("masked_contract"))


def solidity_tree(files: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """D6 + C9: ``keys, ast, status``: a file's contracts, interfaces, libraries
    and functions with bodies in order, as JSON (kind, name, depth).  A file
    whose braces do not pair, or that has no text, cannot be read: it keeps its
    row with the sentinel and ``status='parse_error'``."""
    from codecorpus.session import checkpoint
    marks = checkpoint(delimiters(files, keys, text))
    opens, closes = F.count_if(F.col("mark") == "{"), F.count_if(F.col("mark") == "}")
    # A closing brace too many brings the depth below its first level.
    paired = (opens == closes) & (F.coalesce(F.min(F.when(F.col("mark") == "}", F.col("depth"))), F.lit(1)) >= 1)
    state = marks.groupBy(*keys).agg(paired.alias("_paired"))
    node = F.struct("start", "kind", "name", "depth")
    nodes = solidity_braces(files, keys, text, marks).where("kind <> 'block'").groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
    rows = files.select(*keys, F.col(text).isNotNull().alias("_text")).join(state, keys, "left").join(nodes, keys, "left")
    ok = F.col("_text") & F.coalesce("_paired", F.lit(True))
    tree = F.transform(F.coalesce("_nodes", F.array()), lambda n: F.struct(n["kind"].alias("kind"), n["name"].alias("name"), n["depth"].alias("depth")))
    return rows.select(*keys, F.when(ok, F.to_json(tree)).otherwise(F.lit(K.PARSER_ERROR)).alias("ast"),
                       F.when(ok, F.lit("ok")).otherwise(F.lit("parse_error")).alias("status"))
