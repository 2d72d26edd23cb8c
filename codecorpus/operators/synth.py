"""Synthetic call inputs (D12, E18, K1, K2): random argument values for the
elementary parameters of functions, md5-keyed so they are reproducible.

All values are Column expressions; integers of up to 256 bits exceed every SQL
numeric type, so md5 bits become decimal text by arithmetic on limb arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codecorpus import constants as K
from codecorpus.functions import limbs as L
from codecorpus.functions import text as TX
from codecorpus.operators.samples import _explode, span_at


def _int_value(type_name: Column, key: Column) -> Column:
    """Decimal text of a uniform intN / uintN value (N defaults to 256): the
    lowest N bits of the md5 digests of ``key:0``, ``key:1``, ... in turn,
    less 2**(N - 1) if signed."""
    width = F.regexp_extract(type_name, r"^u?int([0-9]*)$", 1)
    bits = F.when(width == "", 256).otherwise(width.try_cast("int"))
    blocks = F.greatest(F.ceil(bits / 128).cast("int"), F.lit(1))

    # What is used more than once is bound by ``let``: inside a lambda Spark works it out at every use.
    def value(own, n):
        # A width of 0 has the one value 0, or without the sign bit's place no negative half.
        signed = F.when(n > 0, L.signed_text(own, n)).otherwise("0")
        return F.when(type_name.startswith("u"), L.text(L.from_hex(own))).otherwise(signed)

    digests = L.let(key, lambda k: F.array_join(F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda j: F.md5(F.concat_ws(":", k, j.cast("string")))), ""))
    return L.let(bits, lambda n: L.let(L.let(digests, lambda d: L.low_bits(d, n)), lambda own: value(own, n)))


def _scalar_value(kind: Column, key: Column) -> Column:
    """Value of one bool / address / string element (as text)."""
    h = F.md5(key)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    addresses = F.array(*[F.lit(a) for a in K.ADDRESSES])
    chars = F.concat(*[F.chr(F.lit(32) + byte(i) % 95) for i in range(K.STRING_LEN)])
    return (F.when(kind == "bool", F.when(byte(0) % 2 == 1, F.lit("true")).otherwise(F.lit("false")))
            .when(kind == "address", F.try_element_at(addresses, byte(0) % 5 + 1))
            .when(kind == "string", chars))


def function_params(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contract_name, func_name, func_ord, pos, type, name) of
    every parameter of every function."""
    fs = F.filter(F.col("spans"), lambda s: (s["kind"] == "function") & s["parent_ord"].isNotNull())
    arr = F.flatten(F.transform(fs, lambda s: F.transform(s["params"], lambda p, i: F.struct(
        span_at(s["parent_ord"])["name"].alias("contract_name"), s["name"].alias("func_name"),
        s["ord"].alias("func_ord"), i.alias("pos"), p["type"].alias("type"), p["name"].alias("name")))))
    return _explode(scanned, keys, arr)


def typed_inputs(params: DataFrame, key_cols: list[str], seed: int = K.SEED_GENERATOR) -> DataFrame:
    """K1 + K2: a value for every elementary parameter (arrays ``T[n]`` get n
    values); other types are skipped.  ``value`` is text; arrays render as
    ``[v1, v2, ...]``."""
    arr_m = F.regexp_extract("type", r"^(.+)\[([0-9]+)\]$", 2)
    base = F.when(arr_m != "", F.regexp_extract("type", r"^(.+)\[([0-9]+)\]$", 1)).otherwise(F.col("type"))
    p = params.withColumn("_base", base).withColumn("_n", F.when(arr_m != "", arr_m.try_cast("int")))
    p = p.where(TX.elementary_kind(F.col("_base")).isNotNull())
    key = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    p = p.withColumn("_kind", TX.elementary_kind(F.col("_base"))).withColumn("_key", key) \
        .withColumn("_cnt", F.coalesce(F.col("_n"), F.lit(1)))
    item = lambda i: F.concat_ws(":", F.col("_key"), i.cast("string"))
    vals = F.transform(F.sequence(F.lit(1), F.col("_cnt")), lambda i: F.when(
        F.col("_kind").isin("uint", "int"), _int_value(F.col("_base"), item(i))).otherwise(_scalar_value(F.col("_kind"), item(i))))
    value = F.when(F.col("_n").isNull(), F.try_element_at(vals, F.lit(1))).otherwise(
        F.concat(F.lit("["), F.array_join(vals, ", "), F.lit("]")))
    return p.withColumn("value", value).drop("_base", "_n", "_kind", "_key", "_cnt")
