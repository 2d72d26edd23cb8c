"""Unsigned integers of any width as arrays of limbs, in column expressions.

A number is an array of longs in base 10**9, least first.  Used where values
exceed every SQL numeric type (256-bit inputs, K1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 1_000_000_000
#: Hex digits that are taken up at a time.
STEP = 6


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _times(limbs: Column, factor: int, plus: Column) -> Column:
    """``limbs * factor + plus``."""
    start = F.struct(plus.alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(s, x):
        t = x * factor + s["carry"]
        return F.struct(F.floor(t / F.lit(BASE)).cast("long").alias("carry"), F.concat(s["out"], F.array(F.pmod(t, F.lit(BASE)))).alias("out"))

    return F.aggregate(limbs, start, step, lambda s: F.when(s["carry"] > 0, F.concat(s["out"], F.array(s["carry"]))).otherwise(s["out"]))


def from_hex(digits: Column) -> Column:
    """The number that a string of hex digits writes (the empty string: 0, null: null)."""
    n = F.ceil(F.length(digits) / STEP).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def words(padded):
        return F.transform(places, lambda i: F.conv(F.substring(padded, i * STEP + 1, F.lit(STEP)), 16, 10).cast("long"))

    limbs = let(F.lpad(digits, n * STEP, "0"), lambda padded: F.aggregate(
        words(padded), F.array(F.lit(0).cast("long")), lambda acc, w: _times(acc, 16 ** STEP, w)))
    return F.when(n.isNotNull(), limbs)


def minus(a: Column, b: Column) -> Column:
    """``a - b`` for ``a >= b``; the highest limbs may be 0."""
    start = F.struct(F.lit(0).cast("long").alias("borrow"), F.array().cast("array<bigint>").alias("out"))

    def step(s, i):
        t = F.get(a, i) - F.coalesce(F.get(b, i), F.lit(0)) - s["borrow"]
        return F.struct(F.when(t < 0, 1).otherwise(0).cast("long").alias("borrow"),
                        F.concat(s["out"], F.array(F.when(t < 0, t + BASE).otherwise(t))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, lambda s: s["out"])


def text(limbs: Column) -> Column:
    """Decimal digits."""
    parts = F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0"))
    return F.regexp_replace(F.array_join(parts, ""), r"^0+(?=.)", "")


def signed_text(digits: Column, bits: Column) -> Column:
    """Decimal text of ``v - 2**(bits - 1)``, for the ``bits``-wide number v that
    the hex digits write."""
    half = F.concat(F.substring(F.lit("1248"), F.pmod(bits - 1, F.lit(4)) + 1, F.lit(1)), F.repeat(F.lit("0"), F.floor((bits - 1) / 4).cast("int")))
    wide = F.lpad(digits, F.length(half), "0")
    low = F.get(F.array(*[F.lit(k) for k in (1, 2, 4, 8)]), F.pmod(bits - 1, F.lit(4)))
    top = F.conv(F.substring(wide, 1, 1), 16, 10).cast("int")
    rest = F.substring(wide, F.lit(2), F.length(wide))
    cleared = F.concat(F.lower(F.conv((top - low).cast("string"), 10, 16)), rest)
    below = let(from_hex(half), lambda h: text(minus(h, from_hex(digits))))
    return F.when(top >= low, text(from_hex(cleared))).otherwise(F.concat(F.lit("-"), below))


def low_bits(digits: Column, bits: Column) -> Column:
    """Hex digits of the lowest ``bits`` of what ``digits`` write (at least that many)."""
    n = F.ceil(bits / 4).cast("int")
    own = F.right(digits, n)
    keep = F.get(F.array(*[F.lit(k) for k in (16, 2, 4, 8)]), F.pmod(bits, F.lit(4)))
    top = F.pmod(F.conv(F.substring(own, 1, 1), 16, 10).cast("int"), keep)
    return F.when(n > 0, F.concat(F.lower(F.conv(top.cast("string"), 10, 16)), F.substring(own, F.lit(2), n))).otherwise("")
