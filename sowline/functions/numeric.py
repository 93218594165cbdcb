"""Rounding and safe arithmetic.

Two rounding rules appear in the source work (rule M13):
* numpy / pandas ``round`` is half-to-even on the binary value: ``rint(x * 10^d) / 10^d``;
* SQL ``ROUND`` is half away from zero.
Both are written as plain IEEE arithmetic so that any engine doing the same
steps gets bit-identical results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, digits: int = 0) -> Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


def round_half_up(col, digits: int = 0) -> Column:
    """SQL ROUND on a double: half away from zero, sign(x) * floor(|x| * 10^d + 0.5) / 10^d."""
    c = _c(col)
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def safe_ratio(num, den) -> Column:
    """num / den as double, null when den is 0 or null (no error, no infinity)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def _split(x: Column) -> tuple[Column, Column]:
    """Veltkamp split of a double into two halves with 26-bit mantissas."""
    c = F.lit(134217729.0) * x
    hi = c - (c - x)
    return hi, x - hi


def fused_multiply_add(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with a single rounding (IEEE fma), from plain double operations.

    Dekker's exact product (p + e == a * b) and Knuth's two-sum of p and c,
    recombined once.  Used so interpolated quantiles are bit-identical to
    engines whose compiled code fuses the multiply-add.
    """
    p = a * b
    ah, al = _split(a)
    bh, bl = _split(b)
    e = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    bb = s - p
    t = (p - (s - bb)) + (c - bb)
    return s + (t + e)


def lerp(lo: Column, hi: Column, frac: Column) -> Column:
    """lo * (1 - frac) + hi * frac, fused; exactly lo when frac is 0.

    Infinities and numbers whose split would overflow are interpolated plainly.
    """
    plain = lo * (F.lit(1.0) - frac) + hi * frac
    large = (F.abs(lo) >= 1e290) | (F.abs(hi) >= 1e290)
    return F.when(frac == 0, lo).when(large, plain).otherwise(fused_multiply_add(lo, F.lit(1.0) - frac, hi * frac))
