"""Code-sample operators over scanned files.

Input is a *scanned* table (``spans.scan_files``): file columns + an ordered
``spans`` array.  Each operator filters / transforms that array and cuts text
with ``substring`` on the same row, then explodes the small result structs,
so the file text is never joined back or shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus import constants as K




def span_at(ord_: Column) -> Column:
    """The span with a given ord (spans are stored in ord order)."""
    return F.try_element_at(F.col("spans"), ord_ + 1)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end], 0-based half-open."""
    return text.substr(start + 1, end - start)


def _explode(df: DataFrame, keys: list[str], arr: Column) -> DataFrame:
    """One row per struct of ``arr``, keeping ``keys``.

    ``inline_outer`` + a marker instead of ``inline``: for ``inline`` the
    optimizer infers a ``size(arr) > 0`` filter and pushes it below the
    projections, which would evaluate the whole per-file array expression a
    second time (with its lambdas inlined).
    """
    wrapped = F.transform(arr, lambda x: F.struct(F.lit(True).alias("_ok"), x.alias("_v")))
    return (df.select(*keys, wrapped.alias("_r")).select(*keys, F.inline_outer("_r"))
            .where(F.col("_ok").isNotNull()).select(*keys, "_v.*"))


def _explode_cut(df: DataFrame, keys: list[str], arr: Column, text: str, columns) -> DataFrame:
    """``_explode`` of offsets, then text cut per output row.

    ``arr`` holds offsets and names only; ``columns(t)`` gives the result
    columns from the text ``t`` and the exploded fields.  A row's memory stays
    linear in its file, however many texts are cut from it.
    """
    rows = _explode(df.withColumn("_text", F.col(text)), [*keys, "_text"], arr)
    return rows.select(*keys, *columns(F.col("_text")))


# ---------------------------------------------------------------------------
# Solidity
# ---------------------------------------------------------------------------

def contracts(scanned: DataFrame, keys: list[str], text: str = "source_code",
              types=("contract",)) -> DataFrame:
    """D3 + C5: one row per contract (``type`` in ``types``) with its source."""
    cs = F.filter(F.col("spans"), lambda s: (s["kind"] == "contract") & s["type"].isin(*types))
    arr = F.transform(cs, lambda s: F.struct(
        s["name"].alias("contract_name"), s["ord"].alias("contract_ord"), s["start"].alias("_a"), s["end"].alias("_b")))
    return _explode_cut(scanned, keys, arr, text, lambda t: [
        "contract_name", "contract_ord", cut(t, F.col("_a"), F.col("_b")).alias("contract_source")])


def _in_contract(s: Column, types) -> Column:
    c = span_at(s["parent_ord"])
    return (s["parent_ord"].isNotNull() & (c["kind"] == "contract") & c["type"].isin(*types))


def contract_functions(scanned: DataFrame, keys: list[str], text: str = "source_code",
                       types=("contract",), whole: bool = False,
                       with_source: bool = False, masked: bool = True, offsets: bool = False) -> DataFrame:
    """D4 (``whole=False``) / D5 (``whole=True``): functions with a body.

    D4: ``func_body`` between the braces and ``masked_contract`` = contract
    text with that body replaced by ``<FILL_FUNCTION_BODY>`` (``masked=False``
    skips it; with ``with_source``, also the contract text, cut on the same
    row; with ``offsets``, the struct ``masked_at`` (see ``masked_text``)).
    D5: ``function`` = signature + body, ``masked_contract`` with the whole
    function replaced by ``<FILL_FUNCTION>``.
    """
    rows = function_offsets(scanned.withColumn("_text", F.col(text)), [*keys, "_text"], types)
    return cut_functions(rows, keys, "_text", whole, with_source, masked, offsets)


def function_offsets(scanned: DataFrame, keys: list[str], types=("contract",)) -> DataFrame:
    """Functions with a body: names and offsets only, for joins that run before any text is cut."""
    fs = F.filter(F.col("spans"), lambda s: (s["kind"] == "function") & s["body_start"].isNotNull()
                  & _in_contract(s, types))

    def offsets(s):
        c = span_at(s["parent_ord"])
        return F.struct(
            c["name"].alias("contract_name"), s["name"].alias("func_name"), s["ord"].alias("func_ord"),
            s["start"].alias("func_start"), s["end"].alias("_end"), s["body_start"].alias("body_start"),
            s["body_end"].alias("_body_end"), c["start"].alias("_c_start"), c["end"].alias("_c_end"))

    return _explode(scanned, keys, F.transform(fs, offsets))


def cut_functions(rows: DataFrame, keys: list[str], text: str, whole: bool = False,
                  with_source: bool = False, masked: bool = True, offsets: bool = False) -> DataFrame:
    """The columns of ``contract_functions`` for rows of ``function_offsets`` that carry their file's text."""
    t = F.col(text)
    a, b, c0, c1 = F.col("body_start"), F.col("_body_end"), F.col("_c_start"), F.col("_c_end")
    if whole:
        return rows.select(
            *keys, "contract_name", "func_name",
            F.concat(cut(t, c0, F.col("func_start")), F.lit(K.FILL_FUNCTION), cut(t, F.col("_end"), c1)).alias("masked_contract"),
            cut(t, F.col("func_start"), F.col("_end")).alias("function"))
    out = ["contract_name", "func_name", "func_ord", "func_start", "body_start", cut(t, a, b).alias("func_body")]
    if masked:
        out.append(F.concat(cut(t, c0, a), F.lit(K.FILL_FUNCTION_BODY), cut(t, b, c1)).alias("masked_contract"))
    if offsets:
        out.append(F.struct(c0.alias("start"), a.alias("body_start"), b.alias("body_end"), c1.alias("end")).alias("masked_at"))
    if with_source:
        out.append(cut(t, c0, c1).alias("contract_source"))
    return rows.select(*keys, *out)


def masked_text(text: Column, at: Column) -> Column:
    """The masked text that ``masked_at`` (offsets in ``text`` of a container
    and of a body in it) stands for; null outside any container."""
    return F.concat(cut(text, at["start"], at["body_start"]), F.lit(K.FILL_FUNCTION_BODY), cut(text, at["body_end"], at["end"]))


def with_texts(rows: DataFrame, scanned: DataFrame, keys: list[str], row: str, text: str = "source_code",
               target: str | None = None) -> DataFrame:
    """``rows`` (of files told apart by ``row``) with ``_own``, the text of the
    file that each was cut from; ``target`` (a join type) also adds
    ``_target``, the text of every file of its ``keys``.

    The rows of a file are gathered first, and come apart again beside its
    texts: a text is shuffled once for its file, not once for each row."""
    cols = [c for c in rows.columns if c not in keys and c != row]
    per_file = rows.groupBy(*keys, row).agg(F.collect_list(F.struct(*cols)).alias("_rows"))
    both = per_file.join(scanned.select(row, F.col(text).alias("_own")), row)
    if target:
        both = both.join(scanned.select(*keys, F.col(text).alias("_target")), keys, target)
    return both.select(*keys, row, "_own", *(["_target"] if target else []), F.inline_outer("_rows"))


def visible_members(scanned: DataFrame, keys: list[str], text: str = "source_code",
                    as_array: bool = False):
    """Members a child inherits from one contract (F15 element text).

    Non-private state variables (their text) and functions neither external
    nor private: signature + ``{<BODY>}``, or the whole text without body.
    Rows: keys, contract_name, member_ord, element.
    """
    t = F.col(text)
    ms = F.filter(F.col("spans"), lambda s: (
        ((s["kind"] == "state_var") & (F.coalesce(s["visibility"], F.lit("")) != "private"))
        | ((s["kind"] == "function")
           & ~F.coalesce(s["visibility"], F.lit("")).isin("external", "private")))
        & s["parent_ord"].isNotNull() & (span_at(s["parent_ord"])["kind"] == "contract"))
    arr = F.transform(ms, lambda s: F.struct(
        span_at(s["parent_ord"])["name"].alias("contract_name"),
        s["parent_ord"].alias("contract_ord"), s["ord"].alias("member_ord"),
        F.when((s["kind"] == "function") & s["body_start"].isNotNull(),
               F.concat(cut(t, s["start"], s["body_start"] - 1), F.lit(K.BODY_PLACEHOLDER)))
        .otherwise(cut(t, s["start"], s["end"])).alias("element")))
    return arr if as_array else _explode(scanned, keys, arr)


# ---------------------------------------------------------------------------
# Java
# ---------------------------------------------------------------------------

def java_methods(scanned: DataFrame, keys: list[str], text: str = "source_code", offsets: bool = False) -> DataFrame:
    """D1 + F5 + E8 + H16: one masked sample per method with a body.

    The class is the *outermost* ``class`` declaration containing the body,
    found by walking up the method's parents.  Methods declared directly in an
    interface give no row.  A method in no class gets a NULL class and no
    masked text (``status='no_class'``).  ``offsets`` gives the struct
    ``masked_at`` (see ``masked_text``) in the place of ``masked_class``.
    """
    ms = F.filter(F.col("spans"), lambda s: (s["kind"] == "method") & s["body_start"].isNotNull()
                  & (F.coalesce(span_at(s["parent_ord"])["type"], F.lit("")) != "interface"))

    def places(s):
        c = span_at(outermost_class(s))
        return F.struct(
            c["name"].alias("class_name"), s["name"].alias("func_name"), s["ord"].alias("func_ord"),
            s["body_start"].alias("_a"), s["body_end"].alias("_b"), c["kw_start"].alias("_c_start"), c["end"].alias("_c_end"))

    at = F.struct(F.col("_c_start").alias("start"), F.col("_a").alias("body_start"), F.col("_b").alias("body_end"), F.col("_c_end").alias("end"))
    return _explode_cut(scanned, keys, F.transform(ms, places), text, lambda t: [
        "class_name", "func_name", "func_ord",
        at.alias("masked_at") if offsets else masked_text(t, at).alias("masked_class"),
        cut(t, F.col("_a"), F.col("_b")).alias("func_body"),
        F.when(F.col("_c_start").isNull(), F.lit("no_class")).otherwise(F.lit("ok")).alias("status")])


def outermost_class(s: Column) -> Column:
    """ord of the outermost ``class`` around a span, or NULL: one step up per nesting level."""
    none = F.lit(None).cast("int")
    walk = F.aggregate(
        F.sequence(F.lit(0), F.coalesce(s["depth"], F.lit(0)) + 1),
        F.struct(s["parent_ord"].alias("at"), none.alias("found")),
        lambda acc, _: F.struct(
            span_at(acc["at"])["parent_ord"].alias("at"),
            F.when((span_at(acc["at"])["kind"] == "class") & (span_at(acc["at"])["type"] == "class"), acc["at"])
            .otherwise(acc["found"]).alias("found")))
    return walk["found"]


def _normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def with_expected(files: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Files that have expected rows, with ``_expected``: their names and
    normalised bodies.  Meant for files before they are scanned."""
    e = expected.dropna(subset=keys).select(*keys, F.struct("func_name", _normalised(F.col("func_body")).alias("_nb")).alias("_e"))
    return files.join(e.groupBy(*keys).agg(F.collect_set("_e").alias("_expected")), keys)


def java_match_back_on_row(samples: DataFrame) -> DataFrame:
    """What ``java_match_back`` gives for samples that carry the ``_expected``
    rows of their file (``with_expected``): nothing is joined."""
    nb = _normalised(F.col("func_body"))
    met = F.filter("_expected", lambda e: (e["func_name"] == F.col("func_name")) & (e["_nb"] == F.col("_nb")))
    s = samples.withColumn("_nb", nb)
    return s.where(F.size(met) > 0).drop("_nb", "_expected")


def java_match_back(samples: DataFrame, expected: DataFrame, keys: list[str], scanned: DataFrame | None = None,
                    row: str | None = None, text: str = "source_code") -> DataFrame:
    """F17 + C8: keep masked samples whose name and whitespace-normalised body
    equal an expected (func_name, func_body); all matches are kept.

    Equi-join on (file keys, func_name, normalised body), so candidates are
    only compared within one file and one name.

    Samples that hold ``masked_at`` for ``masked_class`` get it from the files
    (``scanned``, told apart by ``row``) after the join.
    """
    s = samples.withColumn("_nb", _normalised(F.col("func_body")))
    e = expected.select(*keys, "func_name", _normalised(F.col("func_body")).alias("_nb")).distinct()
    found = s.join(e, [*keys, "func_name", "_nb"], "left_semi").drop("_nb")
    if scanned is None:
        return found
    return (with_texts(found, scanned, keys, row, text)
            .withColumn("masked_class", masked_text(F.col("_own"), F.col("masked_at"))).drop("_own", "masked_at", row))


# ---------------------------------------------------------------------------
# Java type index, skeletons, fields, methods (D7-D11, D16), parameter context
# ---------------------------------------------------------------------------

def _package(spans: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(spans, lambda s: s["kind"] == "package"),
                                    lambda s: s["name"]), F.lit(1))


def _enclosing_type(s: Column) -> Column:
    """Nearest enclosing class / interface / enum / record (Q29: by parent)."""
    return span_at(s["parent_ord"])


def java_types(scanned: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """D7 + D10 + D11: one row per top-level type.

    ``abstract``: the type's text with every method body (from the end of
    the signature to the closing brace) replaced by ``;``.
    ``abstract_compact``: also without Javadoc comments and annotations (and
    the blanks after them).  Both are built by cutting the text between the
    sorted removal ranges of the type (no parser re-run).
    """
    t = F.col(text)
    sp = F.col("spans")
    df = scanned.withColumn("_types", F.filter(sp, lambda s: (s["kind"] == "class") & (s["depth"] == 0)))

    def ranges(ty, compact):
        bodies = F.transform(
            F.filter(sp, lambda m: m["kind"].isin("method", "constructor") & m["body_start"].isNotNull()
                     & (m["start"] >= ty["start"]) & (m["end"] <= ty["end"])),
            lambda m: F.struct(m["head_end"].alias("a"), m["body_end"].alias("_e"),
                               (m["body_end"] + 1).alias("b"), F.lit(";").alias("r")))
        if not compact:
            return bodies
        docs = F.transform(
            F.filter(sp, lambda c: ((c["kind"] == "annotation")
                                    | ((c["kind"] == "comment") & cut(t, c["start"], c["start"] + 3).eqNullSafe("/**")))
                     & (c["start"] > ty["start"]) & (c["end"] <= ty["end"])
                     & (c["parent_ord"].isNull() | (span_at(c["parent_ord"])["kind"] == "class"))),
            lambda c: F.struct(c["start"].alias("a"), c["end"].alias("_e"), c["gap_end"].alias("b"),
                               F.lit("").alias("r")))
        return F.concat(bodies, docs)

    def rebuild(ty, rs):
        pieces = F.transform(rs, lambda r, i: F.concat(
            cut(t, F.when(i == 0, ty["start"]).otherwise(F.try_element_at(rs, F.greatest(i, F.lit(1)))["b"]), r["a"]),
            r["r"]))
        last = F.when(F.size(rs) > 0, F.try_element_at(rs, F.lit(-1))["b"]).otherwise(ty["start"])
        return F.concat(F.array_join(pieces, ""), cut(t, last, ty["end"]))

    df = df.withColumn("_r1", F.transform("_types", lambda ty: F.array_sort(ranges(ty, False))))
    df = df.withColumn("_r2", F.transform("_types", lambda ty: F.array_sort(ranges(ty, True))))
    pkg = _package(sp)
    arr = F.transform("_types", lambda ty, i: F.struct(
        ty["name"].alias("name"),
        F.coalesce(ty["modifiers"], F.lit("")).alias("modifiers"),
        F.when(pkg.isNull(), ty["name"]).otherwise(F.concat(pkg, F.lit("."), ty["name"])).alias("qualified_name"),
        F.coalesce(F.array_join(ty["bases"], " "), F.lit("")).alias("extend"),
        F.coalesce(F.array_join(ty["interfaces"], " "), F.lit("")).alias("implements"),
        cut(t, ty["start"], ty["end"]).alias("raw"),
        rebuild(ty, F.try_element_at(F.col("_r1"), i + 1)).alias("abstract"),
        rebuild(ty, F.try_element_at(F.col("_r2"), i + 1)).alias("abstract_compact")))
    return _explode(df, keys, arr)


def java_fields(scanned: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """One row per declared field variable, with its nearest enclosing type."""
    t = F.col(text)
    fs = F.filter(F.col("spans"), lambda s: s["kind"] == "field")
    arr = F.transform(fs, lambda s: F.struct(
        _enclosing_type(s)["name"].alias("class"), s["type"].alias("type"),
        F.coalesce(s["modifiers"], F.lit("")).alias("modifiers"), s["name"].alias("name"),
        cut(t, s["start"], s["end"]).alias("raw")))
    return _explode(scanned, keys, arr)


def java_method_table(scanned: DataFrame, keys: list[str], text: str = "source_code") -> DataFrame:
    """Methods and constructors with parameters (constructors return ``void``)."""
    t = F.col(text)
    ms = F.filter(F.col("spans"), lambda s: s["kind"].isin("method", "constructor"))
    arr = F.transform(ms, lambda s: F.struct(
        _enclosing_type(s)["name"].alias("class"), s["name"].alias("name"),
        F.coalesce(s["type"], F.lit("void")).alias("return_type"),
        F.coalesce(s["modifiers"], F.lit("")).alias("modifiers"), s["params"].alias("parameters"),
        s["ord"].alias("ord"), s["body_start"].isNotNull().alias("has_body"),
        _package(F.col("spans")).alias("package"), cut(t, s["start"], s["end"]).alias("raw")))
    return _explode(scanned, keys, arr)


def last_method_text(methods: DataFrame, keys: list[str]) -> DataFrame:
    """Raw text of the last method with each name (file order)."""
    return methods.groupBy(*keys, "name").agg(F.max_by("raw", "ord").alias("raw"))


def imports(text: Column) -> Column:
    """Names in the single-type and on-demand (``.*``) imports of a Java file."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)\s*;"), F.lit(1))


def param_context(samples: DataFrame, types: DataFrame, keys: list[str], project: str = "proj_name",
                  package: str = "package", imported: str | None = None) -> DataFrame:
    """per sample, the skeletons (``abstract``) of its parameter types
    that are defined in the same project, in parameter order, each followed by
    ``<param_class>``; ``<no_param_class>`` without parameters,
    ``<not_self_defined_class>`` when none is a project type and ``<error>``
    when the parameters are unknown (NULL).

    Arrays count as their elements, generic types as the type and its
    arguments.  A name with dots is qualified; another resolves through the
    single-type imports, the file's package and the on-demand imports
    (``imported``: a column with ``imports``), in this order.  The type index
    is de-duplicated per (project, qualified name) before the join, and the
    per-sample concatenation is a grouped ``array_join`` ordered by position.
    """
    from codecorpus.operators.joins import with_row_id
    s = with_row_id(samples)
    known = F.coalesce(F.col(imported), F.array().cast("array<string>")) if imported else F.array().cast("array<string>")
    p = s.select("_sid", project, package, known.alias("_imports"), F.col("parameters").isNull().alias("unknown"),
                 F.posexplode_outer("parameters").alias("pos", "p")).dropDuplicates(["_sid", "pos"])
    names = F.filter(F.regexp_extract_all(F.col("p.type"), F.lit(r"[A-Za-z_$][\w$.]*[\w$]|[A-Za-z_$]"), F.lit(0)),
                     lambda n: ~n.isin("extends", "super", "final"))
    p = p.select("*", F.posexplode_outer(names).alias("sub", "name"))
    name, dotted = F.col("name"), F.col("name").contains(".")
    single = F.filter("_imports", lambda m: F.element_at(F.split(m, "[.]"), -1) == name)
    wild = F.transform(F.filter("_imports", lambda m: m.endswith(".*")), lambda m: F.concat(F.regexp_replace(m, r"\*$", ""), name))
    places = F.when(dotted, F.array(name)).otherwise(F.concat(single, F.array(F.concat_ws(".", F.col(package), name)), wild))
    p = p.select("_sid", project, "unknown", "pos", "p", "sub", F.posexplode_outer(F.when(name.isNotNull(), places)).alias("rank", "qualified_name"))
    ty = types.groupBy(project, "qualified_name").agg(F.min_by("abstract", F.col(keys[-1])).alias("abstract"))
    j = p.join(ty, [project, "qualified_name"], "left")
    best = j.groupBy("_sid", "pos", "sub").agg(
        F.any_value("unknown").alias("unknown"), F.count("p").alias("params"),
        F.min(F.when(F.col("abstract").isNotNull(), F.struct("rank", "abstract"))).alias("hit"))
    g = best.groupBy("_sid").agg(
        F.bool_or("unknown").alias("unknown"), F.sum("params").alias("n_params"),
        F.array_sort(F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("pos", "sub", "hit.abstract")))).alias("found"))
    ctx = (F.when(F.col("unknown"), F.lit(K.CONTEXT_ERROR))
           .when(F.col("n_params") == 0, F.lit(K.NO_PARAM_CLASS))
           .when(F.size("found") == 0, F.lit(K.NOT_SELF_DEFINED_CLASS))
           .otherwise(F.array_join(F.transform("found", lambda x: F.concat(x["abstract"], F.lit(K.PARAM_CLASS))), "")))
    return s.join(g.select("_sid", ctx.alias("param_context")), "_sid").drop("_sid")


def _children(scanned: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Flat (keys, parent_ord, kind, name, type, ord) of body-token spans."""
    arr = F.transform(F.filter(F.col("spans"), lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(
        s["parent_ord"].alias("parent_ord"), s["kind"].alias("kind"), s["name"].alias("name"),
        s["type"].alias("type"), s["ord"].alias("ord")))
    return _explode(scanned, keys, arr)


def used_context(scanned: DataFrame, keys: list[str], text: str = "source_code",
                 member_calls_only: bool = True) -> DataFrame:
    """D13 + D16 + C10 + C11 + G7 (H17): for the last method with each name,
    the sorted distinct types of declared names it mentions (fields, its
    parameters and locals; the last declaration of a name wins; primitive /
    library types skipped by prefix) and the sorted distinct methods it
    calls.  Needs a scan with ``body_tokens=True``.

    Locals and calls are grouped per (file, method) from the flat span rows
    (linear in file size); the method text is cut on the file's row.
    """
    methods = _last_methods(scanned, keys, text)
    kids = _children(scanned, keys, ["local", "call"])
    if member_calls_only:
        kids = kids.where((F.col("kind") == "local") | (F.col("type") == "member"))
    per = kids.groupBy(*keys, F.col("parent_ord").alias("func_ord")).agg(
        F.collect_list(F.when(F.col("kind") == "local", F.struct("name", "type", "ord"))).alias("_locs"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "call", F.col("name")))).alias("re_method"))
    return _used(methods.join(per, [*keys, "func_ord"], "left"), keys)


def _last_methods(scanned: DataFrame, keys: list[str], text: str, *also) -> DataFrame:
    """The last method with each name: its text and the names declared around
    and by it; ``also`` gives columns from the method (a span), its place in
    ``_ms`` (all methods) and ``_ms``."""
    t, sp, ms = F.col(text), F.col("spans"), F.col("_ms")
    df = scanned.withColumn("_ms", F.filter(sp, lambda m: m["kind"].isin("method", "constructor")
                                            & m["body_start"].isNotNull()))
    fields = F.transform(F.filter(sp, lambda s: s["kind"] == "field"), lambda s: F.struct(
        s["name"].alias("name"), s["type"].alias("type"), s["ord"].alias("ord")))
    placed = F.transform(ms, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    last = F.filter(placed, lambda x: ~F.exists(ms, lambda o: (o["name"] == x["m"]["name"]) & (o["ord"] > x["m"]["ord"])))

    def columns(m, i):
        return F.struct(
            m["ord"].alias("func_ord"), m["name"].alias("func_name"), cut(t, m["start"], m["end"]).alias("_body"),
            F.concat(fields, F.transform(m["params"], lambda p: F.struct(
                p["name"].alias("name"), p["type"].alias("type"), m["ord"].alias("ord")))).alias("_decl"), *[c(ms, i, m) for c in also])

    return _explode(df, keys, F.transform(last, lambda x: columns(x["m"], x["i"])))


def used_context_on_row(scanned: DataFrame, keys: list[str], text: str = "source_code", member_calls_only: bool = True) -> DataFrame:
    """What ``used_context`` gives where no other file has the keys: a method's
    locals and calls come from its own file's row, and nothing is joined.  A
    null key meets neither, as in a join."""
    methods = _last_methods(scanned, keys, text, lambda ms, i, m: _own_children(ms, i, m, ["local", "call"]).alias("_kids"))
    none = F.array().cast("array<struct<kind:string,name:string,type:string,ord:int>>")
    methods = methods.withColumn("_kids", F.when(_known_keys(keys), F.col("_kids")).otherwise(none))
    called = _names(F.col("_kids"), lambda s: (s["kind"] == "call") & ((s["type"] == "member") if member_calls_only else F.lit(True)))
    locs = F.transform(F.filter("_kids", lambda s: s["kind"] == "local"), lambda s: F.struct(
        s["name"].alias("name"), s["type"].alias("type"), s["ord"].alias("ord")))
    return _used(methods.withColumn("_locs", locs).withColumn("re_method", F.array_sort(called)), keys)


def _used(j: DataFrame, keys: list[str]) -> DataFrame:
    from codecorpus.functions import text as TX

    decl = F.concat(F.col("_decl"), F.coalesce(F.col("_locs"), F.array().cast(
        "array<struct<name:string,type:string,ord:int>>")))
    j = j.withColumn("_all", decl)
    latest = F.filter(F.col("_all"), lambda d: ~F.exists(F.col("_all"), lambda e: (e["name"] == d["name"]) & (e["ord"] > d["ord"])))
    used = F.filter(latest, lambda d: d["name"].isNotNull() & d["type"].isNotNull()
                    & TX.mentions_variable(F.col("_body"), d["name"]) & ~TX.skipped_type(d["type"]))
    return j.select(*keys, "func_name",
                    F.array_sort(F.array_distinct(F.transform(used, lambda d: d["type"]))).alias("re_type"),
                    F.coalesce("re_method", F.array().cast("array<string>")).alias("re_method"))


def accessible_identifiers(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """D14 + I2: identifiers used in each function's body minus the names
    declared locally there (``array_except``), sorted.  Needs
    ``body_tokens=True``; identifiers are grouped per (file, function)."""
    fs = F.filter(F.col("spans"), lambda s: (s["kind"] == "function") & s["body_start"].isNotNull()
                  & s["parent_ord"].isNotNull())
    funcs = _explode(scanned, keys, F.transform(fs, lambda f: F.struct(
        span_at(f["parent_ord"])["name"].alias("contract_name"), f["name"].alias("func_name"),
        f["ord"].alias("func_ord"))))
    kids = _children(scanned, keys, ["ident", "local"])
    per = kids.groupBy(*keys, F.col("parent_ord").alias("func_ord")).agg(
        F.array_sort(F.array_except(F.collect_set(F.when(F.col("kind") == "ident", F.col("name"))),
                                    F.collect_set(F.when(F.col("kind") == "local", F.col("name")))))
        .alias("identifiers"))
    return funcs.join(per, [*keys, "func_ord"], "left").withColumn(
        "identifiers", F.coalesce("identifiers", F.array().cast("array<string>")))


def _own_children(fs: Column, i: Column, f: Column, kinds: list[str]) -> Column:
    """The body-token spans of ``f``, function ``i`` of ``fs`` (in file order):
    they come between it and the next function, which does not lie inside it."""
    following = F.coalesce(F.try_element_at(fs, i + 2)["ord"], F.size("spans"))
    between = F.slice(F.col("spans"), f["ord"] + 2, F.greatest(following - f["ord"] - 1, F.lit(0)))
    return F.transform(F.filter(between, lambda s: (s["parent_ord"] == f["ord"]) & s["kind"].isin(*kinds)), lambda s: F.struct(
        s["kind"].alias("kind"), s["name"].alias("name"), s["type"].alias("type"), s["ord"].alias("ord")))


def _names(children: Column, condition) -> Column:
    """What ``collect_set`` of the names of the children that meet ``condition`` gives."""
    return F.array_distinct(F.transform(F.filter(children, lambda s: condition(s) & s["name"].isNotNull()), lambda s: s["name"]))


def _known_keys(keys: list[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def accessible_identifiers_on_row(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """What ``accessible_identifiers`` gives where no other file has the keys:
    a function's identifiers come from its own file's row, and nothing is
    joined.  A null key meets no identifiers, as in a join."""
    fs = F.filter(F.col("spans"), lambda s: (s["kind"] == "function") & s["body_start"].isNotNull())
    funcs = _explode(scanned.withColumn("_fs", fs), keys, F.filter(F.transform("_fs", lambda f, i: F.struct(
        span_at(f["parent_ord"])["name"].alias("contract_name"), f["name"].alias("func_name"), f["ord"].alias("func_ord"),
        f["parent_ord"].alias("_parent"), _own_children(F.col("_fs"), i, f, ["ident", "local"]).alias("_kids"))),
        lambda f: f["_parent"].isNotNull()))
    own = F.array_sort(F.array_except(_names(F.col("_kids"), lambda s: s["kind"] == "ident"), _names(F.col("_kids"), lambda s: s["kind"] == "local")))
    return funcs.withColumn("identifiers", F.when(_known_keys(keys), own).otherwise(F.array().cast("array<string>"))).drop("_kids", "_parent")


def ast_json(scanned: DataFrame, keys: list[str], text: str = "source_code",
             error_sentinel: str = "<PARSER_ERROR>") -> DataFrame:
    """D6 + C9: the file's spans as a JSON column; a file the scanner could
    not read (NULL spans) gets the sentinel and ``status='parse_error'``."""
    return scanned.select(
        *keys,
        F.when(F.col("spans").isNull(), F.lit(error_sentinel)).otherwise(F.to_json("spans")).alias("ast"),
        F.when(F.col("spans").isNull(), F.lit("parse_error")).otherwise(F.lit("ok")).alias("status"))
