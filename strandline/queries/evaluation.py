"""Queries over the evaluation operators, on the weekly brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..plans.compiler import evaluate
from ..sources.panel import PANEL_SQL, weekly_brands
from .operators52 import _round

QUERIES, ORACLE_SQL = {}, {}
FACTORS = {"f1": "ts_mean(close, 5)", "f2": "ts_delta(close, 5)", "f3": "neg(volume)", "f4": "ts_std(close, 10)"}
#: Rows of the style windows on the weekly panel: long, least, skipped, liquidity.
STYLE = {"long": 52, "least": 26, "skip": 4, "days": 10}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def factor_panel(spark, sf_dir, factors=FACTORS):
    """Factors, forward return (label), universe, industry (unknown for some brands), capital and returns."""
    keep = ("t", "stock", "date", "industry", "shares", "open", "close", "volume")
    p = evaluate(weekly_brands(spark, sf_dir), factors, keep)
    p = p.withColumn("label", ev.forward_return()).withColumn("universe", (F.col("t") + F.col("industry")) % 11 != 0)
    p = p.withColumn("industry", F.when(F.regexp_extract("stock", r"(\d+)$", 1).cast("int") % 6 != 0, F.col("industry")))
    return p.withColumn("cap", F.col("close") * F.col("shares"))


FACTOR_SQL = f"""WITH {PANEL_SQL},
fp AS (SELECT t, date, stock, CASE WHEN regexp_extract(stock, '(\\d+)$', 1)::INT % 6 <> 0 THEN industry END AS industry, shares, open, close, volume,
  CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END AS f1, close - lag(close, 5) OVER w AS f2, -volume AS f3, CASE WHEN count(close) OVER w10 = 10 THEN stddev_pop(close) OVER w10 END AS f4,
  lead(open, 6) OVER w / lead(open, 1) OVER w - 1 AS label, (t + industry) % 11 <> 0 AS universe, close * shares AS cap FROM panel
  WINDOW w AS (PARTITION BY stock ORDER BY t), w5 AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
"""


def ic_sql(source, x, y, name, by="t", least=20):
    """CTEs: `name`(by, n, ic)."""
    avg = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
    return f"""{name}_r AS (SELECT {by}, {avg(x)} AS a, {avg(y)} AS b FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name} AS (SELECT {by}, count(*) AS n, CASE WHEN count(*) >= {least} AND stddev_pop(a) > 1e-12::DOUBLE AND stddev_pop(b) > 1e-12::DOUBLE THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM {name}_r GROUP BY {by})"""


def rank_ic_sql(source, raw, clean, label, name, by="t", least=20):
    """CTEs: `name`(by, n, ic); n counts raw values, the coefficient is that of cleaned ones."""
    avg = lambda c: f"CASE WHEN ok THEN rank() OVER (PARTITION BY {by}, ok ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, ok, {c}) - 1) / 2.0::DOUBLE END"
    return f"""{name}_o AS (SELECT *, {clean} IS NOT NULL AND {label} IS NOT NULL AS ok, universe AND {raw} IS NOT NULL AND {label} IS NOT NULL AS counted FROM {source}),
{name}_r AS (SELECT {by}, counted, {avg(clean)} AS a, {avg(label)} AS b FROM {name}_o),
{name} AS (SELECT {by}, count(*) FILTER (counted) AS n, CASE WHEN count(a) >= {least} AND stddev_pop(a) > 1e-12::DOUBLE AND stddev_pop(b) > 1e-12::DOUBLE THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic FROM {name}_r GROUP BY {by})"""


def plain_sql(source, x, name, out="z", by="t"):
    q = lambda p: f"quantile_cont(CASE WHEN universe THEN {x} END, {p}) OVER d"
    return f"""{name}_w AS (SELECT *, CASE WHEN universe AND {x} IS NOT NULL THEN least(greatest({x}, {q(0.01)}), {q(0.99)}) END AS cw FROM {source} WINDOW d AS (PARTITION BY {by})),
{name} AS (SELECT *, CASE WHEN count(cw) OVER d >= 2 AND stddev_pop(cw) OVER d > 1e-12::DOUBLE THEN (cw - avg(cw) OVER d) / stddev_pop(cw) OVER d END AS {out} FROM {name}_w WINDOW d AS (PARTITION BY {by}))"""


def candidate_sql(source, x, name, out="z", by="t"):
    q = lambda p: f"quantile_cont(CASE WHEN universe THEN {x} END, {p}) OVER d"
    known = "CASE WHEN w IS NOT NULL THEN industry END"
    return f"""{name}_w AS (SELECT *, CASE WHEN universe AND {x} IS NOT NULL THEN least(greatest({x}, {q(0.01)}), {q(0.99)}) END AS w FROM {source} WINDOW d AS (PARTITION BY {by})),
{name}_k AS (SELECT *, count(w) OVER d AS nn, count({known}) OVER d AS kk, len(list_distinct(list({known}) OVER d)) AS gg, w - avg(w) OVER (PARTITION BY {by}, {known}) AS rr FROM {name}_w WINDOW d AS (PARTITION BY {by})),
{name}_s AS (SELECT *, CASE WHEN nn < 2 THEN 'too few values' WHEN kk = 0 THEN 'no known industry' WHEN kk < gg + 1 THEN 'too few names for the industries' END AS reason FROM {name}_k),
{name}_r AS (SELECT *, CASE WHEN reason IS NULL AND w IS NOT NULL AND industry IS NOT NULL THEN CASE WHEN abs(rr) <= 1e-12::DOUBLE THEN 0 ELSE rr END END AS r FROM {name}_s),
{name} AS (SELECT * EXCLUDE (w, nn, kk, gg, rr, reason, r), CASE WHEN count(r) OVER d >= 2 AND stddev_pop(r) OVER d > 1e-12::DOUBLE THEN (r - avg(r) OVER d) / stddev_pop(r) OVER d END AS {out} FROM {name}_r WINDOW d AS (PARTITION BY {by}))"""


def legs_sql(source, s, r, name, by="t", directed=None):
    """CTEs: `name`(by, n, long, benchmark, excess, long_short). directed: the score times its direction, which ranks the long leg."""
    last = lambda c: f"row_number() OVER (PARTITION BY {by} ORDER BY {c} DESC, stock DESC)"
    low = f"row_number() OVER (PARTITION BY {by} ORDER BY {s}, stock)"
    pair = "least(k, floor(n / 2.0::DOUBLE))"
    return f"""{name}_o AS (SELECT {by}, {r} AS r, {s} AS s, count(*) OVER (PARTITION BY {by}) AS n, {last(directed or s)} AS top, {last(s)} AS high, {low} AS low FROM {source} WHERE {s} IS NOT NULL AND {r} IS NOT NULL),
{name}_k AS (SELECT *, greatest(1, ceil(n * 0.1::DOUBLE)) AS k FROM {name}_o),
{name} AS (SELECT {by}, count(*) AS n, avg(r) FILTER (top <= k) AS long, avg(r) AS benchmark, avg(r) FILTER (top <= k) - avg(r) AS excess,
  avg(r) FILTER (high <= {pair}) - avg(r) FILTER (low <= {pair}) AS long_short FROM {name}_k GROUP BY {by} HAVING count(*) >= 20 AND max(s) - min(s) > 2.3e-16::DOUBLE)"""


def _cols(*names):
    return [_round(F.col(n)).alias(n) for n in names]


def _out(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query(FACTOR_SQL + f"SELECT t, stock, {_out('label')} FROM fp")
def forward_returns(spark, sf_dir):
    return weekly_brands(spark, sf_dir).select("t", "stock", _round(ev.forward_return()).alias("label"))


@query(FACTOR_SQL + "SELECT t, stock, round(CASE WHEN t + 6 <= 200 THEN label END, 6) + 0.0 AS label FROM fp")
def label_containment(spark, sf_dir):
    p = weekly_brands(spark, sf_dir).withColumn("label", ev.forward_return())
    return p.select("t", "stock", _round(ev.contained(F.col("label"), F.lit(200))).alias("label"))


@query(FACTOR_SQL + f", {plain_sql('fp', 'f2', 'c')} SELECT t, stock, {_out('z')} FROM c")
def clean_plain(spark, sf_dir):
    return ev.clean_plain(factor_panel(spark, sf_dir), "f2", F.col("universe"), "z").select("t", "stock", *_cols("z"))


@query(FACTOR_SQL + f", {candidate_sql('fp', 'f2', 'c')} SELECT t, stock, {_out('z')} FROM c")
def clean_candidate(spark, sf_dir):
    return ev.clean_candidate(factor_panel(spark, sf_dir), "f2", F.col("universe"), out="z").select("t", "stock", *_cols("z"))


@query(FACTOR_SQL + f", {candidate_sql('fp', 'f2', 'c')} SELECT t, max(nn) AS valid, max(kk) AS known, max(gg)::BIGINT AS industries, max(reason) AS reason FROM c_s GROUP BY t")
def neutralisation_diagnostics(spark, sf_dir):
    return ev.skipped_dates(factor_panel(spark, sf_dir), "f2", F.col("universe"))


_RANK = ", q AS (SELECT t, stock, label, (rank() OVER (PARTITION BY t, f1 IS NULL ORDER BY f1) - 1 + (count(*) OVER (PARTITION BY t, f1) - 1) / 2.0::DOUBLE + 0.5::DOUBLE) / count(f1) OVER (PARTITION BY t) AS s, f1 FROM fp), p AS (SELECT t, stock, label, CASE WHEN f1 IS NOT NULL THEN s END AS s FROM q)"


@query(FACTOR_SQL + _RANK + f", {ic_sql('p', 's', 'label', 'c')} SELECT t, n, {_out('ic')} FROM c WHERE n >= 20")
def rank_ic_by_date(spark, sf_dir):
    p = factor_panel(spark, sf_dir, {"s": "cs_rank(ts_mean(close, 5))"})
    return ev.rank_correlation(p, "s", "label").filter("n >= 20").select("t", "n", *_cols("ic"))


_IC = FACTOR_SQL + f", {candidate_sql('fp', 'f2', 'c')}, {rank_ic_sql('c', 'f2', 'z', 'label', 'i')}"


def _ic(spark, sf_dir):
    p = ev.clean_candidate(factor_panel(spark, sf_dir), "f2", F.col("universe"), out="z")
    return ev.rank_ic(p, "f2", "z", "label", F.col("universe"))


@query(_IC + f"SELECT t, n, {_out('ic')} FROM i")
def rank_ic_series(spark, sf_dir):
    return _ic(spark, sf_dir).select("t", "n", *_cols("ic"))


@query(_IC + ", b AS (SELECT min(t) AS f FROM i WHERE n >= 20) SELECT t, n FROM i, b WHERE t >= f AND (t - f) % 5 = 0")
def rebalance_calendar(spark, sf_dir):
    return ev.rebalance(_ic(spark, sf_dir).select("t", "n"))


_SUMMARY = "avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir, count(ic) AS valid, count(*) AS total, avg(CASE WHEN ic IS NOT NULL THEN (ic > 1e-12::DOUBLE)::INT::DOUBLE END) AS positive"


@query(_IC + f"SELECT {_out('mean', 'std', 'icir', 'positive')}, valid, total, sign(mean)::DOUBLE AS direction FROM (SELECT {_SUMMARY} FROM i)")
def ic_summary(spark, sf_dir):
    return ev.ic_summary(_ic(spark, sf_dir)).select(*_cols("mean", "std", "icir", "positive"), "valid", "total", "direction")


_LEGS = FACTOR_SQL + f", {candidate_sql('fp', 'f2', 'c')}, {legs_sql('c', 'z', 'label', 'l')}"


def _legs(spark, sf_dir):
    return ev.portfolios(ev.clean_candidate(factor_panel(spark, sf_dir), "f2", F.col("universe"), out="z"), "z", "label")


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')} SELECT t, n, {_out('long', 'benchmark', 'excess', 'long_short')} FROM l")
def long_short_portfolio(spark, sf_dir):
    return ev.portfolios(factor_panel(spark, sf_dir), "f1", "label").select("t", "n", *_cols("long", "benchmark", "excess", "long_short"))


@query(FACTOR_SQL + f", n AS (SELECT t, stock, label, -f1 AS s FROM fp), {legs_sql('n', 's', 'label', 'l')} SELECT t, n, {_out('long', 'excess')} FROM l")
def long_portfolio_reversed(spark, sf_dir):
    return ev.portfolios(factor_panel(spark, sf_dir), "f1", "label", -1.0).select("t", "n", *_cols("long", "excess"))


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')} SELECT count(excess) AS n, round(avg(excess), 6) AS mean, round(avg(excess) * 50.4::DOUBLE, 5) AS annual, round(avg(excess) / stddev_samp(excess) * sqrt(50.4::DOUBLE), 5) AS ratio FROM l")
def excess_summary(spark, sf_dir):
    out = ev.return_summary(ev.portfolios(factor_panel(spark, sf_dir), "f1", "label"), "excess")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("annual", 5).alias("annual"), F.round("ratio", 5).alias("ratio"))


@query(FACTOR_SQL + f", {ic_sql('fp', 'f1', 'f4', 'c')} SELECT t, n, {_out('ic')} FROM c")
def factor_rank_correlation(spark, sf_dir):
    return ev.rank_correlation(factor_panel(spark, sf_dir), "f1", "f4").select("t", "n", *_cols("ic"))


def _returns(spark, sf_dir):
    return factor_panel(spark, sf_dir).withColumn("ret", ev.daily_return())


MARKET_SQL = FACTOR_SQL + """, g AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lag(cap) OVER w AS lc, lag(universe) OVER w AS lu FROM fp WINDOW w AS (PARTITION BY stock ORDER BY t)),
mk AS (SELECT t, sum(lc * ret) / sum(lc) AS market FROM g WHERE universe AND lu AND lc > 0 AND ret IS NOT NULL GROUP BY t)"""


@query(MARKET_SQL + f" SELECT t, {_out('market')} FROM mk")
def market_return(spark, sf_dir):
    return ev.market_return(_returns(spark, sf_dir)).select("t", *_cols("market"))


def _styled(spark, sf_dir):
    return ev.style_exposures(ev.with_market(_returns(spark, sf_dir)), **STYLE)


STYLE_SQL = MARKET_SQL + """, sj AS (SELECT g.*, market, CASE WHEN market IS NOT NULL THEN ret END AS rj, CASE WHEN ret IS NOT NULL THEN market END AS mj, volume / shares AS turn FROM g LEFT JOIN mk USING (t)),
st AS (SELECT *, CASE WHEN universe THEN ln(cap) END AS size, CASE WHEN universe AND count(rj) OVER l >= 26 AND var_pop(mj) OVER l > 2.3e-16::DOUBLE THEN covar_pop(rj, mj) OVER l / var_pop(mj) OVER l END AS beta,
  CASE WHEN universe THEN lag(close, 4) OVER w / lag(close, 52) OVER w - 1 END AS momentum, CASE WHEN universe AND count(ret) OVER l >= 26 THEN stddev_pop(ret) OVER l END AS volatility,
  CASE WHEN universe AND count(turn) OVER q = 10 THEN avg(turn) OVER q END AS liquidity FROM sj
  WINDOW w AS (PARTITION BY stock ORDER BY t), l AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 51 PRECEDING AND CURRENT ROW), q AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query(STYLE_SQL + f" SELECT t, stock, {_out(*ev.STYLES)} FROM st")
def style_exposures(spark, sf_dir):
    return _styled(spark, sf_dir).select("t", "stock", *_cols(*ev.STYLES))


_STYLE_LS = STYLE_SQL + ", " + ", ".join(f"{plain_sql('st', k, 'p' + k)}, {legs_sql('p' + k, 'z', 'label', 'l' + k)}" for k in ev.STYLES) + ", ls AS (" + " UNION ALL ".join(f"SELECT '{k}' AS style, t, long_short FROM l{k}" for k in ev.STYLES) + ")"


@query(_STYLE_LS + f" SELECT style, t, {_out('long_short')} FROM ls")
def style_returns(spark, sf_dir):
    return ev.style_returns(_styled(spark, sf_dir), "label").select("style", "t", *_cols("long_short"))


_PENALTY = _STYLE_LS + f", {legs_sql('fp', 'f1', 'label', 'l')}, sc AS (SELECT style, count(*) AS n, CASE WHEN count(*) >= 60 THEN corr(l.long_short, ls.long_short) END AS c FROM ls JOIN l USING (t) GROUP BY style), pn AS (SELECT max(abs(c)) AS penalty, count(c) AS styles FROM sc)"


def _penalty(spark, sf_dir):
    s = _styled(spark, sf_dir)
    return ev.style_correlation(ev.portfolios(s.withColumn("_f", F.col("f1")), "_f", "label").select("t", F.col("long_short").alias("x")), ev.style_returns(s, "label"))


@query(_PENALTY + f" SELECT {_out('penalty')}, styles FROM pn")
def style_correlation(spark, sf_dir):
    return _penalty(spark, sf_dir).select(*_cols("penalty"), "styles")


_BY = "hash, split, t"
_UNPIVOT = ", ".join(
    [
        "sp AS (SELECT *, CASE WHEN t < 180 THEN 'train' ELSE 'validation' END AS split FROM st)",
        "lg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS hash, split, t, stock, universe, label, industry, {k} AS x FROM sp" for k in FACTORS) + ")",
        "sl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS style, split, t, stock, universe, label, {k} AS x FROM sp" for k in ev.STYLES) + ")",
    ]
)
EVALUATED_SQL = STYLE_SQL + f""", {_UNPIVOT}, {candidate_sql('lg', 'x', 'cz', by=_BY)}, {rank_ic_sql('cz', 'x', 'z', 'label', 'ri', _BY)},
su AS (SELECT hash, split, avg(ic) AS ic, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS icir, count(ic) AS ic_periods, sign(avg(ic))::DOUBLE AS direction FROM ri GROUP BY ALL),
cg AS (SELECT hash, split, count(*) FILTER (universe AND x IS NOT NULL) / count(*) FILTER (universe)::DOUBLE AS coverage FROM lg GROUP BY ALL),
dz AS (SELECT cz.*, z * direction AS d FROM cz JOIN su USING (hash, split) WHERE direction <> 0), {legs_sql('dz', 'z', 'label', 'le', _BY, 'd')},
lo AS (SELECT hash, split, count(excess) AS ir_periods, avg(excess) * 50.4::DOUBLE AS annual_excess, avg(excess) / stddev_samp(excess) * sqrt(50.4::DOUBLE) AS ir FROM le GROUP BY ALL),
{plain_sql('sl', 'x', 'pz', by='style, split, t')}, {legs_sql('pz', 'z', 'label', 'ls', 'style, split, t')},
co AS (SELECT hash, split, style, CASE WHEN count(*) >= 30 THEN corr(le.long_short, ls.long_short) END AS c FROM le JOIN ls USING (split, t) GROUP BY ALL),
pn AS (SELECT hash, split, max(abs(c)) AS penalty, count(c) AS styles FROM co GROUP BY ALL),
ev AS (SELECT *, CASE WHEN ic IS NULL THEN 'ic' WHEN ir IS NULL THEN 'ir' WHEN penalty IS NULL THEN 'style' END AS reason,
  abs(ic) * (1 + 0.3::DOUBLE * least(greatest(ir, 0), 2)) * (1 - 0.2::DOUBLE * least(greatest(penalty, 0), 1)) AS raw FROM su LEFT JOIN cg USING (hash, split) LEFT JOIN lo USING (hash, split) LEFT JOIN pn USING (hash, split)),
er AS (SELECT *, CASE WHEN reason IS NULL THEN greatest(raw, 1e-8::DOUBLE) END AS reward, CASE WHEN reason IS NULL THEN ln(greatest(raw, 1e-8::DOUBLE)) END AS log_reward, CASE WHEN reason IS NULL THEN raw < 1e-8::DOUBLE END AS floored FROM ev)"""
_METRICS = ("ic", "ic_std", "icir", "annual_excess", "ir", "penalty", "coverage", "reward", "log_reward")


def evaluated(spark, sf_dir):
    """The four factors on a Train and a Validation split, from exposures to reward."""
    s = _styled(spark, sf_dir).withColumn("split", F.when(F.col("t") < 180, "train").otherwise("validation"))
    return ev.evaluate_candidates(s, list(FACTORS), ev.style_returns(s, "label", keys=("split",)), ("split",), common=30)


@query(EVALUATED_SQL + f" SELECT hash, split, {_out(*_METRICS)}, ic_periods, direction, ir_periods, styles, reason, floored FROM er")
def evaluate_candidates(spark, sf_dir):
    return evaluated(spark, sf_dir).select("hash", "split", *_cols(*_METRICS), "ic_periods", "direction", "ir_periods", "styles", "reason", "floored")


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')}, x AS (SELECT t, CASE WHEN t % 9 <> 0 THEN long_short / 10000 END AS r FROM l) SELECT t, round(CASE WHEN r IS NOT NULL THEN exp(sum(ln(1 + r)) OVER (ORDER BY t)) - 1 END, 6) + 0.0 AS total FROM x")
def cumulative_return(spark, sf_dir):
    legs = ev.portfolios(factor_panel(spark, sf_dir), "f1", "label").select("t", F.when(F.col("t") % 9 != 0, F.col("long_short") / 10000).alias("r"))
    return ev.cumulative(legs, "r", "total").select("t", *_cols("total"))


@query("""WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 200 - 100) / 1000.0::DOUBLE END AS ic, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 50 - 10) / 10.0::DOUBLE END AS ratio, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 30) / 20.0::DOUBLE END AS penalty FROM orders)
SELECT k, CASE WHEN ic IS NULL THEN 'ic' WHEN ratio IS NULL THEN 'ir' WHEN penalty IS NULL THEN 'style' END AS reason,
 CASE WHEN ic IS NOT NULL AND ratio IS NOT NULL AND penalty IS NOT NULL THEN round(greatest(1e-8::DOUBLE, abs(ic) * (1 + 0.3::DOUBLE * least(greatest(ratio, 0), 2)) * (1 - 0.2::DOUBLE * least(greatest(penalty, 0), 1))), 8) END AS reward FROM c""")
def reward(spark, sf_dir):
    k = F.col("o_orderkey")
    value, reason = ev.reward(F.col("ic"), F.col("ratio"), F.col("penalty"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.when(k % 7 != 0, (k % 200 - 100) / 1000.0).alias("ic"), F.when(k % 11 != 0, (k % 50 - 10) / 10.0).alias("ratio"), F.when(k % 13 != 0, (k % 30) / 20.0).alias("penalty"))
    return rows.select("k", reason.alias("reason"), F.round(value, 8).alias("reward"))


@query(FACTOR_SQL + " SELECT t, sum((universe AND f1 IS NOT NULL)::INT)::BIGINT AS present, sum(universe::INT)::BIGINT AS universe, round(sum((universe AND f1 IS NOT NULL)::INT) / sum(universe::INT)::DOUBLE, 6) AS coverage FROM fp GROUP BY t")
def finite_coverage(spark, sf_dir):
    return ev.coverage(factor_panel(spark, sf_dir), "f1", F.col("universe"), ("t",)).select("t", "present", "universe", F.round("coverage", 6).alias("coverage"))
