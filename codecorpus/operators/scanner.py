"""Brace-, comment- and string-aware declaration scanner for Java and Solidity.

``scan(text, lang)`` returns span tuples (see ``FIELDS``); it is the only
per-row Python in the span job and is called inside ``mapInArrow`` by
``operators.spans``.  Offsets are 0-based code-point indices, half-open;
``body_start``/``body_end`` exclude the braces.

It is a scanner, not a parser: it recognises type declarations (class /
interface / enum / record, contract / interface / library), members (methods,
functions, constructors, fields, state variables), annotations, comments and
a package line, and skips everything inside bodies except, on request,
calls / locals / identifiers (``body_tokens=True``).
"""

from __future__ import annotations

import re

FIELDS = ("kind", "name", "ord", "start", "end", "kw_start", "body_start", "body_end",
          "parent_ord", "depth", "visibility", "modifiers", "type", "params", "bases",
          "interfaces", "n_statements", "head_end", "gap_end")

# one token per match; leading white space is consumed by the same match
_TOKEN = re.compile(r'''\s*(?:
 (//[^\n]*)
|(/\*.*?\*/)
|(/\*.*)
|(""".*?(?:"""|\Z))
|("(?:[^"\\\n]|\\.)*"?)
|('(?:[^'\\\n]|\\.)*'?)
|([A-Za-z_$][A-Za-z0-9_$]*)
|([0-9][A-Za-z0-9_.]*)
|(\S)
)''', re.S | re.X)
# group numbers: 1 line comment, 2 block comment, 3 unterminated block,
# 4 text block, 5 string, 6 char, 7 identifier, 8 number, 9 punctuation

JAVA_TYPE_KW = {"class", "interface", "enum", "record"}
SOL_TYPE_KW = {"contract", "interface", "library"}
JAVA_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized",
                  "native", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"}
SOL_VISIBILITY = {"public", "private", "internal", "external"}
SOL_STORAGE = {"memory", "storage", "calldata"}
SOL_VAR_MODIFIERS = {"constant", "immutable", "override", "transient"}
STATEMENT_KW = {"return", "new", "throw", "if", "else", "for", "while", "do", "switch", "case",
                "try", "catch", "finally", "break", "continue", "assert", "yield", "emit",
                "require", "revert", "delete", "this", "super"}


def _tokens(text: str):
    """(kind, start, end, value) for code tokens; comments returned apart."""
    toks, comments = [], []
    append = toks.append
    for m in _TOKEN.finditer(text):
        k = m.lastindex
        s, e = m.span(k)
        if k == 7:
            append(("id", s, e, m.group(7)))
        elif k == 9:
            append(("p", s, e, m.group(9)))
        elif k == 1:
            comments.append(("line", s, e))
        elif k == 2:
            comments.append(("block", s, e))
        elif k == 3:
            break  # unterminated block comment: rest of the file is not code
        elif k == 8:
            append(("n", s, e, None))
        else:
            append(("s", s, e, None))
    return toks, comments


# Body skipper: inside a function body only braces, statement ends, strings
# and comments matter when body tokens are not wanted.
_SKIP = re.compile(r"""(//[^\n]*)|(/\*.*?\*/)|(/\*.*)|(\"\"\".*?(?:\"\"\"|\Z))|("(?:[^"\\\n]|\\.)*"?)|('(?:[^'\\\n]|\\.)*'?)|(\{)|(\})|(;)""", re.S)
_NONWS = re.compile(r"\S")


class _Fallback(Exception):
    """Raised by the fast path on unterminated constructs."""


class _Lexer:
    """Tokens on demand; function bodies can be skipped without tokenizing."""

    def __init__(self, text):
        self.text, self.pos, self.toks, self.comments = text, 0, [], []
        self.stmts, self.cut, self.done = {}, len(text), False

    def advance(self):
        """Append the next token; False at the end of the code."""
        text, toks = self.text, self.toks
        while not self.done:
            m = _TOKEN.match(text, self.pos)
            if m is None:
                self.done = True
                return False
            k = m.lastindex
            s, e = m.span(k)
            self.pos = m.end()
            if k == 7:
                toks.append(("id", s, e, m.group(7)))
            elif k == 9:
                toks.append(("p", s, e, m.group(9)))
            elif k == 1:
                self.comments.append(("line", s, e))
                continue
            elif k == 2:
                self.comments.append(("block", s, e))
                continue
            elif k == 3:
                self.done, self.cut = True, s
                return False
            elif k == 8:
                toks.append(("n", s, e, None))
            else:
                toks.append(("s", s, e, None))
            return True
        return False

    def tokenize_block(self, open_idx):
        """Tokenize through the brace closing toks[open_idx]; its index."""
        depth = 1
        while self.advance():
            t = self.toks[-1]
            if t[0] == "p" and t[3] == "{":
                depth += 1
            elif t[0] == "p" and t[3] == "}":
                depth -= 1
                if depth == 0:
                    return len(self.toks) - 1
        raise _Fallback

    def skip_block(self, open_idx):
        """Skip to the brace closing toks[open_idx] (the last token), record
        comments and the number of top-level statements; return the index of
        the appended closing-brace token."""
        text = self.text
        level, stmts, cur, pos = 0, 0, False, self.pos
        for m in _SKIP.finditer(text, pos):
            g = m.lastindex
            s0 = m.start()
            if level == 0 and not cur and text[pos:s0].strip():
                cur = True
            pos = m.end()
            if g == 1:
                self.comments.append(("line", s0, pos))
            elif g == 2:
                self.comments.append(("block", s0, pos))
            elif g == 3:
                raise _Fallback
            elif g in (4, 5, 6):
                if level == 0:
                    cur = True
            elif g == 7:
                level += 1
            elif g == 8:
                if level == 0:
                    self.pos = pos
                    self.toks.append(("p", s0, pos, "}"))
                    self.stmts[open_idx] = stmts + (1 if cur else 0)
                    return len(self.toks) - 1
                level -= 1
                if level == 0:
                    stmts += 1
                    cur = False
            elif level == 0:  # ';'
                stmts += 1
                cur = False
        raise _Fallback


def _match_close(toks, i, open_, close):
    """Index of the token closing the bracket opened at toks[i]."""
    depth = 0
    for j in range(i, len(toks)):
        v = toks[j][3]
        if toks[j][0] == "p":
            if v == open_:
                depth += 1
            elif v == close:
                depth -= 1
                if depth == 0:
                    return j
    return len(toks) - 1


def _split_top(toks, lo, hi, sep=","):
    """Split toks[lo:hi] at top-level ``sep`` (outside () <> [] {})."""
    parts, cur, depth = [], [], 0
    for j in range(lo, hi):
        t = toks[j]
        v = t[3] if t[0] == "p" else None
        if v in ("(", "[", "{", "<"):
            depth += 1
        elif v in (")", "]", "}", ">"):
            depth -= 1
        if v == sep and depth == 0:
            parts.append(cur)
            cur = []
        else:
            cur.append(t)
    if cur:
        parts.append(cur)
    return parts


def _text(text, toks):
    """Source text of a token run with whitespace runs collapsed."""
    if not toks:
        return None
    return " ".join(text[toks[0][1]:toks[-1][2]].split())


def _params(text, toks, lang):
    out = []
    for part in _split_top(toks, 0, len(toks)):
        part = [t for t in part if not (t[0] == "id" and t[3] in ("final",))]
        # drop annotations
        clean, k = [], 0
        while k < len(part):
            if part[k][3] == "@" and k + 1 < len(part):
                k += 2
                if k < len(part) and part[k][3] == "(":
                    depth = 0
                    while k < len(part):
                        if part[k][3] == "(":
                            depth += 1
                        elif part[k][3] == ")":
                            depth -= 1
                            if depth == 0:
                                k += 1
                                break
                        k += 1
                continue
            clean.append(part[k])
            k += 1
        part = clean
        if not part:
            continue
        if lang == "solidity":
            part = [t for t in part if not (t[0] == "id" and t[3] in SOL_STORAGE)]
            if len(part) >= 2 and part[-1][0] == "id" and part[-2][3] not in ("(", ","):
                out.append({"type": _text(text, part[:-1]), "name": part[-1][3]})
            else:
                out.append({"type": _text(text, part), "name": None})
        else:
            if len(part) >= 2 and part[-1][0] == "id":
                out.append({"type": _text(text, part[:-1]), "name": part[-1][3]})
            else:
                out.append({"type": _text(text, part), "name": None})
    return out


def _top_index(toks, value, lo=0, hi=None):
    """First index of a top-level punctuation ``value`` (outside () [] {})."""
    depth = 0
    for j in range(lo, len(toks) if hi is None else hi):
        v = toks[j][3] if toks[j][0] == "p" else None
        if v in ("(", "[", "{"):
            if depth == 0 and v == value:
                return j
            depth += 1
        elif v in (")", "]", "}"):
            depth -= 1
        elif v == value and depth == 0:
            return j
    return -1


def _strip_annotations(decl):
    """Split leading/interleaved Java annotations off a declaration's tokens."""
    anns, rest, k = [], [], 0
    while k < len(decl):
        t = decl[k]
        if t[3] == "@" and k + 1 < len(decl) and decl[k + 1][0] == "id" and decl[k + 1][3] != "interface":
            j = k + 2
            while j + 1 < len(decl) and decl[j][3] == "." and decl[j + 1][0] == "id":
                j += 2
            if j < len(decl) and decl[j][3] == "(":
                j = k + 2 + _match_close(decl[k + 2:], j - (k + 2), "(", ")") + 1
            anns.append(decl[k:j])
            k = j
            continue
        rest.append(t)
        k += 1
    return anns, rest


def scan(text: str, lang: str = "java", body_tokens: bool = False):
    """Spans of one file as a list of dicts keyed by ``FIELDS``.

    Without body tokens, function and initializer bodies are skipped by a
    braces / strings / comments pattern (same spans, less work); an
    unterminated construct falls back to full tokenization.
    """
    if not body_tokens:
        try:
            return _scan(text, lang, False, True)
        except _Fallback:
            pass
    return _scan(text, lang, body_tokens, False)


def _scan(text: str, lang: str, body_tokens: bool, fast: bool):
    lang = "solidity" if lang.lower().startswith("sol") else "java"
    if fast:
        lex = _Lexer(text)
        toks, comments = lex.toks, lex.comments
    else:
        toks, comments = _tokens(text)
    spans = []

    def add(**kw):
        row = dict.fromkeys(FIELDS)
        row.update(kw)
        spans.append(row)
        return len(spans) - 1

    if not fast:
        for kind, s, e in comments:
            add(kind="comment", start=s, end=e, type=kind, depth=None)

    type_kw = SOL_TYPE_KW if lang == "solidity" else JAVA_TYPE_KW
    # stack of open containers: (span index or None for file, type name)
    stack = [(None, None)]
    decl = []
    i = 0

    def body_scan(lo, hi, parent):
        """Statements / calls / locals / identifiers inside a body toks[lo:hi]."""
        if fast:  # counted while the body was skipped
            return lex.stmts[lo - 1]
        stmts, cur, depth = 0, False, 0
        stmt_start = True
        for j in range(lo, hi):
            t = toks[j]
            v = t[3]
            if t[0] == "p":
                if v == "{":
                    depth += 1
                    stmt_start = True
                elif v == "}":
                    depth -= 1
                    if depth == 0:
                        stmts += 1
                        cur = False
                    stmt_start = True
                    continue
                elif v == ";":
                    if depth == 0:
                        stmts += 1
                        cur = False
                    stmt_start = True
                    continue
            if depth == 0:  # a non-terminator token at body level opens a statement
                cur = True
            if not body_tokens:
                stmt_start = False
                continue
            if t[0] == "id":
                nxt = toks[j + 1][3] if j + 1 < hi else None
                prev = toks[j - 1][3] if j > lo else None
                if nxt == "(" and v not in STATEMENT_KW:
                    add(kind="call", name=v, start=t[1], end=t[2], parent_ord=parent,
                        type="member" if prev == "." else "plain")
                elif v not in STATEMENT_KW:
                    add(kind="ident", name=v, start=t[1], end=t[2], parent_ord=parent)
                if stmt_start and v not in STATEMENT_KW:
                    # local declaration: Type [<..>] [[]] name (= | ; | :)
                    k = j + 1
                    if k < hi and toks[k][3] == "<":
                        k = j + 1 + _match_close(toks[j + 1:hi], 0, "<", ">") + 1
                    while k + 1 < hi and toks[k][3] == "[" and toks[k + 1][3] == "]":
                        k += 2
                    while lang == "solidity" and k < hi and toks[k][3] in SOL_STORAGE:
                        k += 1
                    if (k + 1 < hi and toks[k][0] == "id" and toks[k][3] not in STATEMENT_KW
                            and toks[k + 1][3] in ("=", ";", ":")):
                        add(kind="local", name=toks[k][3], start=toks[j][1], end=toks[k][2],
                            parent_ord=parent, type=" ".join(text[toks[j][1]:toks[k - 1][2]].split()))
            stmt_start = t[0] == "p" and v in ("(",) and j > lo and toks[j - 1][3] == "for"
        return stmts + (1 if cur else 0)

    def close_member(decl, end_tok, body):
        """Record a member declaration; ``body`` = (open idx, close idx) or None."""
        parent, parent_name = stack[-1]
        depth = len(stack) - 1
        anns, core = (_strip_annotations(decl) if lang == "java" else ([], decl))
        for a in anns:
            add(kind="annotation", name="".join(x[3] or "" for x in a[1:2]), start=a[0][1],
                end=a[-1][2], parent_ord=parent, depth=depth)
        if not core:
            return
        start = decl[0][1]
        end = end_tok[2]
        ann_text = " ".join(_text(text, a) for a in anns)
        vals = [t[3] for t in core]
        # package / import / pragma / using
        if vals[0] in ("package",) and lang == "java":
            add(kind="package", name="".join(v or "" for v in vals[1:]), start=start, end=end, depth=depth)
            return
        if vals[0] in ("import", "pragma", "using", "event", "error"):
            return
        # type declaration at this point is only via '{' (handled by caller)
        paren = _top_index(core, "(")
        eq = _top_index(core, "=")
        is_func = paren > 0 and (eq < 0 or paren < eq)
        if lang == "solidity":
            if vals[0] in ("function", "constructor", "modifier", "fallback", "receive"):
                close_p = _match_close(core, paren, "(", ")") if paren >= 0 else len(core) - 1
                name = (core[1][3] if vals[0] in ("function", "modifier") and len(core) > 1
                        and core[1][0] == "id" else None)
                kind = {"function": "function", "constructor": "constructor",
                        "modifier": "modifier"}.get(vals[0], "function")
                tail = [t for t in core[close_p + 1:]]
                vis = next((t[3] for t in tail if t[0] == "id" and t[3] in SOL_VISIBILITY), None)
                ret = None
                for q, t in enumerate(tail):
                    if t[3] == "returns" and q + 1 < len(tail) and tail[q + 1][3] == "(":
                        rc = _match_close(tail, q + 1, "(", ")")
                        ret = _text(text, tail[q + 2:rc])
                        tail = tail[:q] + tail[rc + 1:]
                        break
                mods = [t[3] for t in tail if t[0] == "id" and t[3] not in SOL_VISIBILITY]
                if vals[0] in ("fallback", "receive"):
                    mods = [vals[0]] + mods
                ps = _params(text, core[paren + 1:close_p], lang) if paren >= 0 else []
                row = dict(kind=kind, name=name, start=start, end=end, kw_start=core[0][1],
                           parent_ord=parent, depth=depth, visibility=vis,
                           modifiers=" ".join(mods) or None, type=ret, params=ps)
                if body:
                    row.update(body_start=toks[body[0]][2], body_end=toks[body[1]][1],
                               head_end=toks[body[0] - 1][2])
                idx = add(**row)
                if body:
                    spans[idx]["n_statements"] = body_scan(body[0] + 1, body[1], idx)
                return
            if vals[0] in ("struct", "enum"):
                add(kind=vals[0], name=core[1][3] if len(core) > 1 else None, start=start, end=end,
                    kw_start=core[0][1], parent_ord=parent, depth=depth)
                return
            if parent is None:
                return
            # state variable: type [visibility] [constant] name [= value]
            head = core[:eq] if eq > 0 else core
            names = [t for t in head if t[0] == "id"]
            if not names:
                return
            name_tok = names[-1]
            vis = next((t[3] for t in head if t[0] == "id" and t[3] in SOL_VISIBILITY), None)
            mods = [t[3] for t in head[:-1] if t[0] == "id" and t[3] in SOL_VAR_MODIFIERS]
            typ = [t for t in head[:-1] if not (t[0] == "id" and (t[3] in SOL_VISIBILITY or t[3] in SOL_VAR_MODIFIERS))]
            add(kind="state_var", name=name_tok[3], start=start, end=end, kw_start=core[0][1],
                parent_ord=parent, depth=depth, visibility=vis, modifiers=" ".join(mods) or None,
                type=_text(text, typ))
            return
        # --- java members
        if parent is None:
            return
        k = 0
        mods = []
        while k < len(core) and core[k][0] == "id" and core[k][3] in JAVA_MODIFIERS:
            mods.append(core[k][3])
            k += 1
        vis = next((m for m in mods if m in ("public", "private", "protected")), None)
        modtext = " ".join(x for x in ([ann_text] if ann_text else []) + mods) or None
        if is_func:
            name_tok = core[paren - 1]
            if name_tok[0] != "id":
                return
            close_p = _match_close(core, paren, "(", ")")
            rtype_toks = core[k:paren - 1]
            # skip generic method type parameters <T>
            if rtype_toks and rtype_toks[0][3] == "<":
                c = _match_close(rtype_toks, 0, "<", ">")
                rtype_toks = rtype_toks[c + 1:]
            is_ctor = not rtype_toks and name_tok[3] == parent_name
            row = dict(kind="constructor" if is_ctor else "method", name=name_tok[3], start=start,
                       end=end, kw_start=(rtype_toks[0][1] if rtype_toks else name_tok[1]),
                       parent_ord=parent, depth=depth, visibility=vis, modifiers=modtext,
                       type=_text(text, rtype_toks) if rtype_toks else None,
                       params=_params(text, core[paren + 1:close_p], lang))
            if body:
                row.update(body_start=toks[body[0]][2], body_end=toks[body[1]][1],
                           head_end=toks[body[0] - 1][2])
            idx = add(**row)
            if body:
                spans[idx]["n_statements"] = body_scan(body[0] + 1, body[1], idx)
            return
        # field(s): Type a [= x], b [= y];
        rest = core[k:]
        parts = _split_top(rest, 0, len(rest))
        if not parts:
            return
        first = parts[0]
        feq = _top_index(first, "=")
        head = first[:feq] if feq > 0 else first
        if len(head) < 2 or head[-1][0] != "id":
            return
        typ = _text(text, head[:-1])
        for q, part in enumerate(parts):
            peq = _top_index(part, "=")
            ph = part[:peq] if peq > 0 else part
            if not ph or ph[-1][0] != "id":
                continue
            add(kind="field", name=ph[-1][3], start=start, end=end, kw_start=core[0][1],
                parent_ord=parent, depth=depth, visibility=vis, modifiers=modtext, type=typ)

    while True:
        if i >= len(toks) and not (fast and lex.advance()):
            break
        t = toks[i]
        v = t[3] if t[0] == "p" else None
        if v == "}":
            if len(stack) > 1:
                idx, _ = stack.pop()
                spans[idx]["end"] = t[2]
                spans[idx]["body_end"] = t[1]
            decl = []
            i += 1
            continue
        if v == ";":
            if decl:
                close_member(decl, t, None)
            decl = []
            i += 1
            continue
        if v != "{":
            decl.append(t)
            i += 1
            continue
        # '{' at container level: type declaration, member with body, or other block
        anns, core = (_strip_annotations(decl) if lang == "java" else ([], decl))
        vals = [x[3] for x in core]
        kw = next((q for q, x in enumerate(core) if x[0] == "id" and x[3] in type_kw
                   and (q == 0 or core[q - 1][3] != ".")), -1)
        if lang == "java" and kw < 0 and "@" in vals:
            q = vals.index("@")
            if q + 1 < len(vals) and vals[q + 1] == "interface":
                kw = q + 1
        paren = _top_index(core, "(")
        eq = _top_index(core, "=")
        if kw >= 0 and (paren < 0 or paren > kw) and kw + 1 < len(core) and core[kw + 1][0] == "id":
            parent, _ = stack[-1]
            depth = len(stack) - 1
            for a in anns:
                add(kind="annotation", name=a[1][3] if len(a) > 1 else None, start=a[0][1],
                    end=a[-1][2], parent_ord=parent, depth=depth)
            name = core[kw + 1][3]
            mods = [x[3] for x in core[:kw] if x[0] == "id"]
            bases, ifaces = [], []
            if lang == "solidity":
                if "is" in vals[kw + 2:]:
                    q = kw + 2 + vals[kw + 2:].index("is")
                    for part in _split_top(core, q + 1, len(core)):
                        path = []
                        for x in part:
                            if x[0] == "id":
                                path.append(x[3])
                            elif x[3] == ".":
                                continue
                            else:
                                break
                        if path:
                            bases.append(".".join(path))
                kind, typ = "contract", core[kw][3]
            else:
                cur = None
                for q in range(kw + 2, len(core)):
                    x = core[q]
                    if x[0] == "id" and x[3] in ("extends", "implements", "permits"):
                        cur = x[3]
                        seg_start = q + 1
                        parts = _split_top(core, seg_start, len(core))
                        names = []
                        for part in parts:
                            if part and part[0][0] == "id" and part[0][3] not in ("implements", "permits"):
                                # stop at next keyword
                                stop = next((r for r, y in enumerate(part) if y[0] == "id" and y[3] in ("implements", "permits") and r > 0), len(part))
                                names.append(_text(text, part[:stop]))
                                if stop < len(part):
                                    break
                            else:
                                break
                        if cur == "extends":
                            if core[kw][3] == "interface":
                                ifaces.extend(names)
                            else:
                                bases.extend(names)
                        elif cur == "implements":
                            ifaces.extend(names)
                kind, typ = "class", ("annotation" if core[kw][3] == "interface" and kw > 0 and core[kw - 1][3] == "@" else core[kw][3])
            vis = next((m for m in mods if m in ("public", "private", "protected")), None)
            ann_text = " ".join(_text(text, a) for a in anns)
            idx = add(kind=kind, name=name, start=decl[0][1], end=None, kw_start=core[kw][1] if typ != "annotation" else core[kw - 1][1],
                      body_start=t[2], parent_ord=parent, depth=depth, visibility=vis,
                      modifiers=" ".join(([ann_text] if ann_text else []) + mods) or None, type=typ,
                      bases=bases, interfaces=ifaces)
            stack.append((idx, name))
            decl = []
            i += 1
            continue
        is_member_func = paren > 0 and (eq < 0 or paren < eq) and len(stack) > 1
        if lang == "solidity" and core and core[0][3] in ("function", "constructor", "modifier", "fallback", "receive"):
            is_member_func = len(stack) > 1 or core[0][3] == "function"
        if not fast:
            close = _match_close(toks, i, "{", "}")
        elif is_member_func:  # only a function body's inside is never looked at again
            close = lex.skip_block(i)
        else:
            close = lex.tokenize_block(i)
        if is_member_func:
            close_member(decl, toks[close], (i, close))
            decl = []
            i = close + 1
            continue
        if eq >= 0 or (lang == "solidity" and core and core[0][3] in ("struct", "enum")) or \
                (lang == "java" and core and core[-1][3] in ("enum",)):
            # initializer braces inside a declaration, or a struct / enum body
            if lang == "solidity" and core and core[0][3] in ("struct", "enum"):
                close_member(decl + toks[i:close + 1], toks[close], None)
                decl = []
            else:
                decl.extend(toks[i:close + 1])
            i = close + 1
            continue
        # other block (initializer, enum constant body...): skip it
        decl = []
        i = close + 1

    if fast:
        for kind, s, e in comments:
            add(kind="comment", start=s, end=e, type=kind, depth=None)
    # unterminated containers end at end of text
    for idx, _ in stack[1:]:
        spans[idx]["end"] = len(text)
        spans[idx]["body_end"] = len(text)
        spans[idx]["n_statements"] = None
    # final order: by start, enclosing span first; parent references were
    # creation indexes and are translated to the final ``ord``.
    order = sorted(range(len(spans)), key=lambda k: (spans[k]["start"], -(spans[k]["end"] or 0), k))
    final = {old: new for new, old in enumerate(order)}
    out = []
    for new, old in enumerate(order):
        r = spans[old]
        r["ord"] = new
        if r["parent_ord"] is not None:
            r["parent_ord"] = final[r["parent_ord"]]
        out.append(r)
    # comments and annotations: where the next code or comment starts
    if fast:  # skipped bodies have no tokens: the next code is the next non-blank
        for r in out:
            if r["kind"] in ("comment", "annotation"):
                m = _NONWS.search(text, r["end"])
                r["gap_end"] = m.start() if m and m.start() < lex.cut else len(text)
    else:
        starts = sorted([tk[1] for tk in toks] + [c[1] for c in comments])
        import bisect
        for r in out:
            if r["kind"] in ("comment", "annotation"):
                k = bisect.bisect_left(starts, r["end"])
                r["gap_end"] = starts[k] if k < len(starts) else len(text)
    # a comment's parent is the innermost declaration containing it
    open_ = []
    for r in out:
        while open_ and (open_[-1]["end"] or 0) <= r["start"]:
            open_.pop()
        if r["kind"] == "comment":
            if open_:
                r["parent_ord"] = open_[-1]["ord"]
            continue
        if r["kind"] in ("contract", "class", "function", "method", "constructor", "modifier"):
            open_.append(r)
    return out
