"""Tenant keys: a 64-bit hash of the tenant id, and arithmetic on it.

Spark has no unsigned 64-bit type and ANSI arithmetic raises on overflow, so a
key is a two's-complement ``long`` and is computed on 32-bit halves, where no
product passes 2**42.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a, 64 bits, and the finaliser of MurmurHash3
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = (1 << 40) + 0x1B3
FMIX_1, FMIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

_M32 = 0xFFFFFFFF
_M64 = (1 << 64) - 1


def key_of(tenant: int) -> int:
    """FNV-1a over the eight big-endian bytes of an id; unsigned."""
    h = FNV_OFFSET
    for byte in (tenant & _M64).to_bytes(8, "big"):
        h = (h ^ byte) * FNV_PRIME & _M64
    return h


def fmix64(x: int) -> int:
    """Spread all bits of a 64-bit value; unsigned."""
    for factor in (FMIX_1, FMIX_2):
        x = (x ^ x >> 33) * factor & _M64
    return x ^ x >> 33


def fmix64_array(x: np.ndarray) -> np.ndarray:
    """:func:`fmix64` of a ``uint64`` array."""
    for factor in (FMIX_1, FMIX_2):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def signed(x: int) -> int:
    """The ``long`` that holds an unsigned 64-bit value."""
    return x - (1 << 64) if x >> 63 else x


def unsigned(x: int) -> int:
    return x & _M64


def _step(hi: Column, lo: Column, byte: Column) -> tuple[Column, Column]:
    """One byte: xor into the low half, times the prime modulo 2**64."""
    lo = lo.bitwiseXOR(byte)
    low = lo * F.lit(0x1B3)
    high = hi * F.lit(0x1B3) + F.shiftright(low, 32) + F.shiftleft(lo, 8)
    return high.bitwiseAND(F.lit(_M32)), low.bitwiseAND(F.lit(_M32))


def key_column(tenant: Column) -> Column:
    """Key of a tenant column as one expression (``long``)."""
    t = tenant.cast("long")
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & _M32).cast("long").alias("lo"))
    bytes_ = F.array(*(F.shiftright(t, s).bitwiseAND(F.lit(0xFF).cast("long")) for s in range(56, -8, -8)))

    def merge(acc: Column, byte: Column) -> Column:
        hi, lo = _step(acc["hi"], acc["lo"], byte)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    return F.when(t.isNotNull(), F.aggregate(bytes_, start, merge, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"])))


def with_key(df: DataFrame, tenant: str = "tenant_id", out: str = "key") -> DataFrame:
    """``df`` with the key of a tenant column, a projection a byte.

    The same value as :func:`key_column`, inside whole-stage code generation:
    use it for whole tables.
    """
    text, cols = [f"CAST(`{tenant}` AS BIGINT) AS __t", f"{FNV_OFFSET >> 32}L AS __hi0", f"{FNV_OFFSET & _M32}L AS __lo0"], df.columns
    for k in range(8):
        # one byte: xor into the low half, times the prime modulo 2**64; each alias uses those before it
        text.append(f"__lo{k} ^ (shiftright(__t, {56 - 8 * k}) & 255L) AS __x{k}")
        text.append(f"(__hi{k} * {0x1B3}L + shiftright(__x{k} * {0x1B3}L, 32) + shiftleft(__x{k}, 8)) & {_M32}L AS __hi{k + 1}")
        text.append(f"(__x{k} * {0x1B3}L) & {_M32}L AS __lo{k + 1}")
    text.append(f"CASE WHEN __t IS NOT NULL THEN shiftleft(__hi8, 32) | __lo8 END AS `{out}`")
    return df.selectExpr(*(f"`{c}`" for c in cols if c != out), *text).select(*(f"`{c}`" for c in cols if c != out), f"`{out}`")


def fenced(df: DataFrame) -> DataFrame:
    """``df`` with a fence: conditions above it are not written into the expressions
    below, where each use of a key would spell out all of its eight steps again."""
    return df.withColumn("__fence", F.monotonically_increasing_id()).where("__fence >= 0")


def umod(key: Column, n: int) -> Column:
    """Unsigned remainder of a key."""
    if n < 1:
        raise ValueError("modulus must be positive")
    if n & (n - 1) == 0:
        return key.bitwiseAND(F.lit(n - 1).cast("long"))
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M32))
    return ((hi % n) * ((1 << 32) % n) + lo % n) % n


def unsigned_text(key: Column) -> Column:
    """Decimal text of the unsigned value."""
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M32))
    return (hi.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + lo.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
