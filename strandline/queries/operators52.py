"""A query for each of the 52 operators over the weekly brand panel, and some nested expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cross_section, elementwise, gauss, time_series
from ..plans.compiler import evaluate
from ..sources.panel import PANEL_SQL, weekly_brands

#: Window of the rolling queries; the others differ only in their number.
N = 10


def _round(x):
    """Six digits; a value that rounds to zero has no sign."""
    return F.round(x, 6) + 0.0


def _query(formula):
    def query(spark, sf_dir):
        out = evaluate(weekly_brands(spark, sf_dir), {"value": formula})
        return out.select("t", "stock", _round(F.col("value")).alias("value"))

    return query


def _sql(value, before=""):
    return f"WITH {PANEL_SQL}{before} SELECT t, stock, round({value}, 6) + 0.0 AS value FROM {'s' if before else 'panel'}"


UNARY_SQL = {
    "abs": "abs({x})", "neg": "-{x}", "sign": "sign({x})::DOUBLE", "log": "ln(abs({x}) + 1e-12::DOUBLE)", "inv": "CASE WHEN abs({x}) > 1e-12::DOUBLE THEN 1.0::DOUBLE / {x} END",
    "sqrt": "sqrt(abs({x}))", "tanh": "tanh({x})", "relu": "CASE WHEN {x} > 0 THEN {x} WHEN {x} <= 0 THEN 0.0::DOUBLE END", "softsign": "{x} / (1 + abs({x}))",
    "signed_power2": "sign({x}) * {x} * {x}", "signed_power3": "{x} * {x} * {x}", "signed_log1p": "sign({x}) * ln(1 + abs({x}))",
}
BINARY_SQL = {
    "add": "{x} + {y}", "sub": "{x} - {y}", "mul": "{x} * {y}", "div": "CASE WHEN abs({y}) > 1e-12::DOUBLE THEN {x} / {y} END",
    "max2": "CASE WHEN {x} >= {y} THEN {x} WHEN {x} < {y} THEN {y} END", "min2": "CASE WHEN {x} <= {y} THEN {x} WHEN {x} > {y} THEN {y} END",
    "greater": "({x} > {y})::INT::DOUBLE", "less": "({x} < {y})::INT::DOUBLE", "signed_ratio": "({x} - {y}) / (abs({x}) + abs({y}) + 1e-12::DOUBLE)",
    "log_ratio": "CASE WHEN {y} + 1e-12::DOUBLE <> 0 AND ({x} + 1e-12::DOUBLE) / ({y} + 1e-12::DOUBLE) > 0 THEN ln(({x} + 1e-12::DOUBLE) / ({y} + 1e-12::DOUBLE)) END",
}


def _poly(x, coefficients):
    out = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def _gauss(p):
    tail = lambda s, q: f"{s}{_poly(f'sqrt(-2 * ln({q}))', gauss.C)} / {_poly(f'sqrt(-2 * ln({q}))', (*gauss.D, 1.0))}"
    r = f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return f"CASE WHEN {p} < {gauss.LOW} THEN {tail('', p)} WHEN {p} > 1 - {gauss.LOW} THEN {tail('-', f'(1 - {p})')} ELSE {_poly(r, gauss.A)} * ({p} - 0.5::DOUBLE) / {_poly(r, (*gauss.B, 1.0))} END"


SECTION = ", s AS (SELECT *, count({x}) OVER d AS n, (rank() OVER (PARTITION BY t, {x} IS NULL ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY t, {x}) - 1) / 2.0::DOUBLE) AS r, avg({x}) OVER d AS m, stddev_pop({x}) OVER d AS sd, sum(abs({x})) OVER d AS sa, min({x}) OVER d AS lo, max({x}) OVER d AS hi, quantile_cont({x}, 0.05) OVER d AS q1, quantile_cont({x}, 0.95) OVER d AS q2 FROM panel WINDOW d AS (PARTITION BY t))"
SECTION_SQL = {
    "cs_rank": "(r + 0.5::DOUBLE) / n", "cs_zscore": "CASE WHEN sd > 1e-12::DOUBLE THEN ({x} - m) / sd END", "cs_demean": "{x} - m", "cs_scale": "CASE WHEN sa > 1e-12::DOUBLE THEN {x} / sa END",
    "cs_normalize": "({x} - lo) / (hi - lo + 1e-12::DOUBLE)", "cs_winsorize": "least(greatest({x}, q1), q2)", "cs_truncate": "CASE WHEN {x} BETWEEN q1 AND q2 THEN {x} END",
    "cs_quantile": "r / (n - 1)", "cs_rank_gauss": _gauss("((r + 0.5::DOUBLE) / n)"),
}
SERIES_SQL = {
    "ts_mean": "avg({x}) OVER w", "ts_std": "stddev_pop({x}) OVER w", "ts_max": "max({x}) OVER w", "ts_min": "min({x}) OVER w", "ts_sum": "sum({x}) OVER w",
    "ts_rank": "(len(list_filter(list({x}) OVER w, lambda v: v < {x})) + 0.5::DOUBLE * len(list_filter(list({x}) OVER w, lambda v: v = {x}))) / {n}",
    "ts_argmax": "({n} - list_position(list_reverse(list({x}) OVER w), max({x}) OVER w))::DOUBLE", "ts_argmin": "({n} - list_position(list_reverse(list({x}) OVER w), min({x}) OVER w))::DOUBLE",
    "ts_wma": "(sum({x} * t) OVER w - (t - {n}) * sum({x}) OVER w) / ({n} * ({n} + 1) / 2.0::DOUBLE)", "ts_slope": "regr_slope({x}, t) OVER w",
    "ts_residual": "{x} - avg({x}) OVER w - regr_slope({x}, t) OVER w * (({n} - 1) / 2.0::DOUBLE)", "ts_zscore": "CASE WHEN stddev_pop({x}) OVER w > 1e-12::DOUBLE THEN ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w END",
    "ts_position": "({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w + 1e-12::DOUBLE)", "ts_range": "max({x}) OVER w - min({x}) OVER w",
}
PAIR_SQL = {
    "ts_cov": "covar_pop(xj, yj) OVER w", "ts_corr": "CASE WHEN stddev_pop(xj) OVER w > 1e-12::DOUBLE AND stddev_pop(yj) OVER w > 1e-12::DOUBLE THEN covar_pop(xj, yj) OVER w / (stddev_pop(xj) OVER w * stddev_pop(yj) OVER w) END",
    "ts_beta": "CASE WHEN var_pop(yj) OVER w > 1e-12::DOUBLE THEN covar_pop(xj, yj) OVER w / var_pop(yj) OVER w END",
    "ts_orth": "CASE WHEN var_pop(yj) OVER w > 1e-12::DOUBLE THEN xj - avg(xj) OVER w - covar_pop(xj, yj) OVER w / var_pop(yj) OVER w * (yj - avg(yj) OVER w) END",
}


def _rolling(value, x, n, source="panel", extra=""):
    return f", s AS (SELECT t, stock, CASE WHEN count({x}) OVER w = {n} THEN {value} END AS v FROM (SELECT *{extra} FROM {source}) WINDOW w AS (PARTITION BY stock ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"


QUERIES, ORACLE_SQL = {}, {}


def _add(name, formula, sql):
    QUERIES[name] = _query(formula)
    ORACLE_SQL[name] = sql


# arguments of either sign and a size at which six digits are well within a double
X, X_SQL = "sub(log(close), log(open))", "(ln(abs(close) + 1e-12::DOUBLE) - ln(abs(open) + 1e-12::DOUBLE))"
Y, Y_SQL = "log(volume)", "ln(abs(volume) + 1e-12::DOUBLE)"
for op in elementwise.UNARY:
    _add(f"unary_{op}", f"{op}({X})" if op != "log" else "log(close)", _sql(UNARY_SQL[op].format(x=X_SQL if op != "log" else "close")))
for op in elementwise.BINARY:
    _add(f"binary_{op}", f"{op}({X}, {Y})" if op != "log_ratio" else "log_ratio(close, open)", _sql(BINARY_SQL[op].format(x=X_SQL if op != "log_ratio" else "close", y=Y_SQL if op != "log_ratio" else "open")))
for op in cross_section.NAMES:
    _add(op, f"{op}(volume)", _sql(f"CASE WHEN volume IS NOT NULL AND n >= 2 THEN {SECTION_SQL[op].format(x='volume')} END", SECTION.format(x="volume")))
for op in time_series.UNARY:
    if op == "ts_delay":
        sql = _sql("v", f", s AS (SELECT t, stock, lag(close, {N}) OVER (PARTITION BY stock ORDER BY t) AS v FROM panel)")
    elif op == "ts_delta":
        sql = _sql("v", f", s AS (SELECT t, stock, {Y_SQL} - lag({Y_SQL}, {N}) OVER (PARTITION BY stock ORDER BY t) AS v FROM panel)")
    elif op == "ts_ema":
        a = f"(2.0::DOUBLE / {N + 1})"
        sql = _sql("v", f""", runs AS (SELECT *, sum((close IS NULL)::INT) OVER (PARTITION BY stock ORDER BY t) AS run FROM panel),
            lists AS (SELECT t, stock, close, list(close) FILTER (close IS NOT NULL) OVER (PARTITION BY stock, run ORDER BY t) AS l FROM runs),
            s AS (SELECT t, stock, CASE WHEN close IS NOT NULL AND len(l) >= {N} THEN list_reduce(l, lambda e, v: {a} * v + (1 - {a}) * e) END AS v FROM lists)""")
    else:
        sql = _sql("v", _rolling(SERIES_SQL[op].format(x="close", n=N), "close", N))
    _add(op, f"{op}(close, {N})" if op != "ts_delta" else f"{op}({Y}, {N})", sql)
for op in time_series.BINARY:
    _add(op, f"{op}(close, volume, {N})", _sql("v", _rolling(PAIR_SQL[op], "xj", N, extra=", CASE WHEN volume IS NOT NULL THEN close END AS xj, CASE WHEN close IS NOT NULL THEN volume END AS yj")))

_mean = ", m AS (SELECT *, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS f FROM panel WINDOW w AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"
_add("expr_section_of_series", "cs_zscore(ts_mean(close, 5))", _sql("CASE WHEN f IS NOT NULL AND n >= 2 AND sd > 1e-12::DOUBLE THEN (f - m) / sd END", f"{_mean}, s AS (SELECT t, stock, f, count(f) OVER d AS n, avg(f) OVER d AS m, stddev_pop(f) OVER d AS sd FROM m WINDOW d AS (PARTITION BY t))"))
_add("expr_series_of_sections", "ts_corr(cs_demean(close), cs_demean(volume), 20)", _sql("v", ", p AS (SELECT t, stock, CASE WHEN close IS NOT NULL AND count(close) OVER d >= 2 THEN close - avg(close) OVER d END AS close, CASE WHEN volume IS NOT NULL AND count(volume) OVER d >= 2 THEN volume - avg(volume) OVER d END AS volume FROM panel WINDOW d AS (PARTITION BY t))" + _rolling(PAIR_SQL["ts_corr"], "xj", 20, "p", ", CASE WHEN volume IS NOT NULL THEN close END AS xj, CASE WHEN close IS NOT NULL THEN volume END AS yj")))
_add("expr_series_of_series", "ts_max(ts_delta(log(volume), 5), 10)", _sql("v", ", p AS (SELECT t, stock, ln(abs(volume) + 1e-12::DOUBLE) - lag(ln(abs(volume) + 1e-12::DOUBLE), 5) OVER (PARTITION BY stock ORDER BY t) AS x FROM panel)" + _rolling("max(x) OVER w", "x", 10, "p")))
