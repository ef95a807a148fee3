"""Sizes in bits of integer codes and coded lists, as column expressions (exact integer arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SKIP = 64


def _c(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def hi(x) -> Column:
    """Place of the highest bit set; x of 1 or more."""
    return (F.length(F.bin(_c(x))) - 1).cast("long")


def gamma(x) -> Column:
    return 2 * hi(x) + 1


def delta(x) -> Column:
    return hi(x) + 2 * hi(hi(x) + 1) + 1


def vbyte(x) -> Column:
    return (8 * F.ceil(F.length(F.bin(_c(x))) / 7)).cast("long")


def unary(x) -> Column:
    return _c(x) + 1


def low_width(m, u) -> Column:
    """Low bits a value of an Elias-Fano list of m values below u."""
    a, b = hi(m) + 1, hi(u) + 1
    return F.when(b < a, 1).when(a == b, 1).otherwise(b - a).cast("long")


def header(m, u) -> Column:
    return gamma(m) + gamma(u)


def elias_fano_body(m, last) -> Column:
    """Low parts, unary high parts and the closing bit; u = last + 1."""
    w = low_width(m, _c(last) + 1)
    return _c(m) * w + _c(m) + F.expr("1L") + F.floor(_c(last) / F.pow(F.lit(2.0), w)).cast("long")


def elias_fano(m, last) -> Column:
    return header(m, _c(last) + 1) + elias_fano_body(m, last)


def elias_fano_skip(m, last, skip: int = SKIP) -> Column:
    """With a pointer for every ``skip`` zeros of the high part."""
    zeros = F.floor((_c(last) + 1) / F.pow(F.lit(2.0), low_width(m, _c(last) + 1))).cast("long")
    width = hi(zeros + _c(m) + 1) + 1
    return elias_fano(m, last) + gamma(width) + (F.floor(zeros / skip) + 1).cast("long") * width


def bitvector(m, last) -> Column:
    return header(m, F.greatest(_c(last), F.lit(1))) + _c(last) + 2


def block_type(m, n) -> Column:
    """Kind of a block of m values with universe n: FULL, BV or EF."""
    ef = _c(m) * low_width(m, n) + 2 * _c(m)
    return F.when(_c(n) == _c(m) - 1, "FULL").when(_c(n) + 1 < ef, "BV").otherwise("EF")
