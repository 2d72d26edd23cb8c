"""String Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codecorpus import constants as K

# ASCII blanks (Java's \s also has vertical tab; spelled out so both engines agree)
BLANKS = r"[ \t\n\x0B\f\r]"
# Unicode white space removed by Python's str.strip() (Java regex escapes)
PY_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"


#: A string literal (kept as group 1) or a comment.
STRINGS_OR_COMMENTS = (r"""("(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+')|//[^\n]*|/\*(?s:.*?)\*/""")


def normalize_newlines(s: Column) -> Column:
    """A2 / E5: CRLF -> LF (all occurrences)."""
    return F.replace(s, F.lit("\r\n"), F.lit("\n"))


def lenient_text(content: Column) -> Column:
    """A2: bytes -> text, undecodable bytes dropped, line ends normalised."""
    # U+FFFD that is really in the file is set aside under a private character.
    aside = F.replace(content.cast("string"), F.lit("\ufffd"), F.lit("\U0010fffe"))
    text = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    return normalize_newlines(F.replace(text, F.lit("\U0010fffe"), F.lit("\ufffd")))


def remove_comments(s: Column, string_aware: bool = False) -> Column:
    """Line and block comments removed (an unterminated block comment is
    kept).  By default string literals are not recognised, so ``"http://x"``
    starts a comment (Q10); ``string_aware`` keeps them whole."""
    if string_aware:
        return F.regexp_replace(s, STRINGS_OR_COMMENTS, "$1")
    return F.regexp_replace(s, K.RE_COMMENTS, "$1")


def comment_content(s: Column) -> Column:
    """Comment text without its 2-char marks, trimmed like JS ``trim``."""
    body = F.when(s.startswith("//"), s.substr(F.lit(3), F.length(s)))\
        .otherwise(s.substr(F.lit(3), F.length(s) - 4))
    return strip_py(body)


def strip_py(s: Column) -> Column:
    """Python ``str.strip()`` / JS ``trim()``."""
    return F.regexp_replace(s, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def collapse_ws(s: Column) -> Column:
    """``' '.join(s.split())`` on ASCII blanks."""
    return F.trim(F.regexp_replace(s, BLANKS + "+", " "))


def strip_private(s: Column) -> Column:
    """Remove ``private`` modifiers that follow white space, to a fixed point."""
    return F.regexp_replace(s, K.RE_PRIVATE, "")


def fill_marker(masked: Column, filler: Column, marker: str = K.FILL_FUNCTION_BODY,
                newline: bool = False) -> Column:
    """Put a candidate into the marker (Solidity variant adds '\\n')."""
    f = F.concat(filler, F.lit("\n")) if newline else filler
    return F.replace(masked, F.lit(marker), f)


def non_control_length(s: Column) -> Column:
    """Characters other than \\n \\t \\r \\a."""
    return F.length(F.regexp_replace(s, r"[\n\t\r\x07]", ""))


def is_blank(s: Column) -> Column:
    """Only [\\t\\n\\r ] (NULL is blank too, so it is dropped)."""
    return F.coalesce(F.regexp_replace(s, r"[\t\n\r ]", "") == "", F.lit(True))


def elementary_kind(t: Column) -> Column:
    """Elementary Solidity type class of a type name."""
    return (F.when(t.rlike(r"^uint[0-9]*$"), F.lit("uint"))
            .when(t.rlike(r"^int[0-9]*$"), F.lit("int"))
            .when(t == "bool", F.lit("bool"))
            .when(t == "address", F.lit("address"))
            .when(t == "string", F.lit("string")))


def skipped_type(t: Column) -> Column:
    """Primitive / library types skipped by *prefix* match."""
    return t.rlike(K.RE_SKIPPED_TYPE)


def mentions_variable(text: Column, name: Column) -> Column:
    """C11: ``\\bname\\b`` occurs in text."""
    # pattern from a column; \Q..\E quotes the name ('$' is legal in Java names)
    return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))


def mentions_call(text: Column, name: Column) -> Column:
    """C11: ``.name(`` occurs in text."""
    return F.contains(text, F.concat(F.lit("."), name, F.lit("(")))


def candidates(s: Column, sep: str = "<candidate>") -> Column:
    """All pieces before the last ``<candidate>`` separator."""
    import re
    parts = F.split(s, re.escape(sep))  # split takes a regex
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def line_col_to_offset(text: Column, line: Column, col: Column) -> Column:
    """0-based character offset of a 1-based line and 0-based column
    (the location convention of syntax-tree ``loc`` fields)."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), F.lit(0),
                         lambda a, x: a + F.length(x) + 1)
    return F.when(line >= 1, before + col)


#: Characters outside the basic plane.
WIDE = r"[\x{10000}-\x{10FFFF}]"


def character_runs(text: Column, k: int) -> Column:
    """Every run of ``k`` characters.  One regular expression cuts them, at a
    fraction of what a slice per character costs; characters outside the basic
    plane, between whose halves it would also start, are sliced."""
    chars = F.split(text, "")
    n = F.size(chars)
    starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
    sliced = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, k), ""))
    return F.when(text.rlike(WIDE), sliced).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1)))
