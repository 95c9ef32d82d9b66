"""Element-wise operators. Missing is NULL; an infinite or undefined result is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least magnitude of a denominator, a spread or a scale.
EPS = 1e-12


def finite(x: Column) -> Column:
    """x where it is a finite number."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(x: Column, y: Column, least: float = EPS) -> Column:
    """x / y where |y| > least."""
    return finite(F.try_divide(x, F.when(F.abs(y) > least, y)))


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def cube(x: Column) -> Column:
    return finite(x * x * x)


UNARY = {
    "abs": F.abs,
    "neg": lambda x: -x,
    "sign": F.signum,
    "log": lambda x: finite(F.log(F.abs(x) + EPS)),
    "inv": lambda x: divide(F.lit(1.0), x),
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "tanh": F.tanh,
    "relu": lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))),
    "softsign": lambda x: x / (F.abs(x) + 1.0),
    "signed_power2": lambda x: finite(F.signum(x) * x * x),
    "signed_power3": cube,
    "signed_log1p": lambda x: F.signum(x) * F.log1p(F.abs(x)),
}


def log_ratio(x: Column, y: Column) -> Column:
    ratio = F.try_divide(x + EPS, F.when(y + EPS != 0, y + EPS))
    return finite(F.log(F.when(ratio > 0, ratio)))


BINARY = {
    "add": lambda x, y: finite(x + y),
    "sub": lambda x, y: finite(x - y),
    "mul": lambda x, y: finite(x * y),
    "div": divide,
    "max2": lambda x, y: F.when(both(x, y), F.greatest(x, y)),
    "min2": lambda x, y: F.when(both(x, y), F.least(x, y)),
    "greater": lambda x, y: (x > y).cast("double"),
    "less": lambda x, y: (x < y).cast("double"),
    "signed_ratio": lambda x, y: finite((x - y) / (F.abs(x) + F.abs(y) + EPS)),
    "log_ratio": log_ratio,
}
COMMUTATIVE = frozenset({"add", "mul", "max2", "min2"})
