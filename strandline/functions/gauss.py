"""Inverse of the normal distribution function as column arithmetic (a rational approximation, error under 4e-9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of the published rational approximation
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """NULL outside (0, 1)."""
    q = p - 0.5
    r = q * q
    middle = _poly(r, A) * q / _poly(r, (*B, 1.0))
    tail = lambda x: _poly(F.sqrt(F.log(x) * -2.0), C) / _poly(F.sqrt(F.log(x) * -2.0), (*D, 1.0))
    return F.when((p > 0) & (p < LOW), tail(p)).when((p >= LOW) & (p <= 1 - LOW), middle).when((p > 1 - LOW) & (p < 1), -tail(1.0 - p))
