"""Queries over selection, strategies, back-tests, generation and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import evaluate as ev
from ..operators import report as rp
from ..operators import select as sl
from ..plans.expression import actions, parse
from ..plans.grammar import Grammar, synthetic_log_reward
from ..sources.panel import table
from .evaluation import FACTOR_SQL, FACTORS, _cols, _out, candidate_sql, factor_panel, ic_sql, legs_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _candidates(spark, sf_dir):
    """A synthetic record for each order: metrics from its key."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.md5(k.cast("string").cast("binary")).alias("hash"), k.alias("k"), ((k * 37 % 101 - 50) / 1000.0).alias("train_ic"), F.when(k % 9 != 0, (k * 53 % 97 - 48) / 1000.0).alias("validation_ic"),
        ((k * 29 % 89) / 60.0).alias("train_ratio"), F.when(k % 9 != 0, (k * 31 % 83) / 70.0).alias("validation_ratio"), ((k * 17 % 79) / 90.0).alias("train_style"), "o_orderstatus", "o_totalprice",
    )


CANDIDATE_SQL = """WITH c AS (SELECT md5(o_orderkey::VARCHAR) AS hash, o_orderkey AS k, (o_orderkey * 37 % 101 - 50) / 1000.0::DOUBLE AS train_ic, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 53 % 97 - 48) / 1000.0::DOUBLE END AS validation_ic,
 (o_orderkey * 29 % 89) / 60.0::DOUBLE AS train_ratio, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 31 % 83) / 70.0::DOUBLE END AS validation_ratio, (o_orderkey * 17 % 79) / 90.0::DOUBLE AS train_style, o_orderstatus, o_totalprice FROM orders),
t AS (SELECT *, abs(train_ic) > 0.01 AS a, abs(validation_ic) > 0.01 AS b, train_ic * validation_ic > 0 AS c, train_ratio > 0.25 AS d, validation_ratio > 0.25 AS e, train_style < 0.7 AS f FROM c),
s AS (SELECT *, concat_ws(',', CASE WHEN NOT coalesce(a, false) THEN 'train_ic' END, CASE WHEN NOT coalesce(b, false) THEN 'validation_ic' END, CASE WHEN NOT coalesce(c, false) THEN 'ic_sign' END, CASE WHEN NOT coalesce(d, false) THEN 'train_ratio' END, CASE WHEN NOT coalesce(e, false) THEN 'validation_ratio' END, CASE WHEN NOT coalesce(f, false) THEN 'train_style' END) AS failed FROM t)
"""


@query(CANDIDATE_SQL + "SELECT hash, failed, failed = '' AS passed FROM s")
def hard_filter(spark, sf_dir):
    return sl.hard_filter(_candidates(spark, sf_dir)).select("hash", "failed", "passed")


@query(CANDIDATE_SQL + "SELECT hash FROM t WHERE a AND d AND f")
def train_prefilter(spark, sf_dir):
    return sl.train_prefilter(_candidates(spark, sf_dir)).filter("passed").select("hash")


@query(CANDIDATE_SQL + "SELECT code, count(ok) AS observed, count_if(ok)::BIGINT AS passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS code, {x} AS ok FROM t" for n, x in zip(sl.CODES, "abcdef", strict=True)) + ") GROUP BY code")
def condition_pass_counts(spark, sf_dir):
    return sl.pass_counts(_candidates(spark, sf_dir))


@query(CANDIDATE_SQL + ", g AS (SELECT failed, count(*) AS n FROM s WHERE failed <> '' GROUP BY failed), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, failed) AS k FROM g) SELECT CASE WHEN k <= 15 THEN failed ELSE 'OTHER' END AS combination, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def failure_combinations(spark, sf_dir):
    return sl.failure_combinations(sl.hard_filter(_candidates(spark, sf_dir)))


@query(CANDIDATE_SQL + "SELECT hash, row_number() OVER (ORDER BY abs(train_ic) DESC, hash)::INT AS rank FROM s WHERE failed = '' ORDER BY rank LIMIT 100")
def top_strategy_input(spark, sf_dir):
    return sl.top_k(sl.hard_filter(_candidates(spark, sf_dir)).filter("passed")).select("hash", "rank")


def _series(spark, sf_dir):
    """Long-short series of the factors and some of their combinations, ranked."""
    more = FACTORS | {"f5": "add(ts_mean(close, 5), ts_std(close, 10))", "f6": "ts_mean(open, 5)"}
    long = ev.long_form(factor_panel(spark, sf_dir, more), more, ("t", "stock", "label"), "hash")
    out = ev.portfolios(long, "x", "label", by=("hash", "t")).select("hash", "t", F.col("long_short").alias("x"))
    return out, spark.createDataFrame([(k, n) for n, k in enumerate(more, 1)], "hash string, rank int")


SERIES_SQL = FACTOR_SQL + ", fq AS (SELECT *, f1 + f4 AS f5, CASE WHEN count(open) OVER w = 5 THEN avg(open) OVER w END AS f6 FROM fp WINDOW w AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), " + ", ".join(legs_sql("fq", f"f{k}", "label", f"l{k}") for k in range(1, 7)) + ", sr AS (" + " UNION ALL ".join(f"SELECT {k} AS rank, t, long_short AS x FROM l{k}" for k in range(1, 7)) + "), pc AS (SELECT p.rank AS a, q.rank AS b, count(*) AS n, CASE WHEN count(*) >= 60 THEN corr(p.x, q.x) END AS c FROM sr p JOIN sr q ON p.t = q.t AND p.rank < q.rank GROUP BY ALL)"


_PAIR = "CASE WHEN n < 60 THEN 'insufficient_common_periods' WHEN c IS NULL THEN 'correlation_unavailable' ELSE 'valid' END AS status"


@query(SERIES_SQL + f" SELECT a, b, n, {_out('c')}, {_PAIR} FROM pc")
def pair_correlations(spark, sf_dir):
    return sl.pair_correlations(*_series(spark, sf_dir)).select("a", "b", "n", *_cols("c"), "status")


def greedy_sql(pairs, n, name="gr"):
    """CTEs: `name`(rank, kept, decided_by, verdict) of n candidates, by recursion over their ranks."""
    c = lambda k: f"ml[({k} - 1) * {n} + {name}.rank + 1]"
    return f"""{name}_g AS (SELECT a, b, c FROM (SELECT x.a, y.b FROM range(1, {n + 1}) x(a), range(1, {n + 1}) y(b)) LEFT JOIN {pairs} USING (a, b)),
{name}_m AS (SELECT list(c ORDER BY a, b) AS ml FROM {name}_g),
{name} AS (SELECT 0 AS rank, []::INT[] AS kept, NULL::INT AS decided_by, 'retained' AS verdict UNION ALL
  SELECT rank + 1, CASE WHEN f IS NULL THEN list_append(kept, rank + 1) ELSE kept END, f, CASE WHEN f IS NULL THEN 'retained' WHEN ml[(f - 1) * {n} + rank + 1] IS NULL THEN 'invalid' ELSE 'rejected' END
  FROM (SELECT {name}.rank, kept, ml, list_filter(kept, lambda k: coalesce(abs({c('k')}), 1) >= 0.7)[1] AS f FROM {name}, {name}_m WHERE {name}.rank < {n}))"""


GREEDY_SQL = SERIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + greedy_sql("pc", 6)


@query(GREEDY_SQL + " SELECT rank, verdict, decided_by FROM gr WHERE rank > 0")
def greedy_decorrelation(spark, sf_dir):
    return spark.createDataFrame(sl.greedy_select(*_series(spark, sf_dir), batch=4), "rank int, verdict string, decided_by int")


@query(GREEDY_SQL + " SELECT rank, verdict, decided_by, round(max(abs(c)), 6) AS max_correlation FROM gr LEFT JOIN pc ON pc.b = rank AND pc.a IN (SELECT rank FROM gr WHERE rank > 0 AND verdict = 'retained') WHERE rank > 0 GROUP BY ALL")
def greedy_audit(spark, sf_dir):
    series, ranks = _series(spark, sf_dir)
    pairs = sl.pair_correlations(series, ranks).cache()  # 15 rows
    out = rp.greedy_audit(pairs, spark.createDataFrame(sl.greedy_decorrelate(ranks, pairs), "rank int, verdict string, decided_by int"))
    return out.select("rank", "verdict", "decided_by", F.round("max_correlation", 6).alias("max_correlation"))


#: Screened metrics of the six candidates: f6 fails, and the others rank f5, f1, f2, f3, f4.
_SCREENED = [("f1", 0.05, 0.04), ("f2", -0.04, -0.03), ("f3", 0.03, 0.02), ("f4", 0.02, 0.05), ("f5", 0.06, 0.02), ("f6", 0.07, -0.02)]


@query(GREEDY_SQL.replace(greedy_sql("pc", 6), f"""rk(k, rank) AS (VALUES (5, 1), (1, 2), (2, 3), (3, 4), (4, 5)), s2 AS (SELECT rk.rank, t, x FROM sr JOIN rk ON rk.k = sr.rank),
p2 AS (SELECT p.rank AS a, q.rank AS b, count(*) AS n, CASE WHEN count(*) >= 60 THEN corr(p.x, q.x) END AS c FROM s2 p JOIN s2 q ON p.t = q.t AND p.rank < q.rank GROUP BY ALL), {greedy_sql("p2", 5)}""")
    + " SELECT gr.rank, 'f' || rk.k AS hash, verdict, 'f' || d.k AS decided_by, CASE WHEN verdict = 'retained' THEN sum((verdict = 'retained')::INT) OVER (ORDER BY gr.rank) END::INT AS place FROM gr JOIN rk USING (rank) LEFT JOIN rk d ON d.rank = gr.decided_by")
def selection_run(spark, sf_dir):
    series, _ = _series(spark, sf_dir)
    rows = [(h, a, b, 0.5, 0.5, 0.1) for h, a, b in _SCREENED]
    records = spark.createDataFrame(rows, "hash string, train_ic double, validation_ic double, train_ratio double, validation_ratio double, train_style double")
    run = sl.Selection(records, series)
    return run.verdicts.join(run.retained.select("rank", "place"), "rank", "left")


@query("SELECT md5((o_orderkey % 500)::VARCHAR) AS hash, list_sort(list(DISTINCT o_orderpriority)) AS origins, count(*) AS visits, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY o_orderkey % 500".replace("list_sort(list(DISTINCT o_orderpriority)) AS origins", "array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS origins"))
def structural_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.md5((F.col("o_orderkey") % 500).cast("string").cast("binary")).alias("hash"), F.col("o_orderstatus").alias("digest"), F.col("o_orderpriority").alias("origin"))
    return sl.group_candidates(o).withColumn("origins", F.array_join("origins", "|"))


@query("WITH u AS (SELECT md5((o_orderkey % 700)::VARCHAR) AS hash, o_orderdate AS d FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT md5((o_orderkey % 700)::VARCHAR), o_orderdate FROM orders WHERE o_orderkey % 2 <> 0) SELECT hash, min(d) AS first_seen, max(d) AS last_seen, count(*) AS visits FROM u GROUP BY hash")
def artifact_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("hash", F.md5((F.col("o_orderkey") % 700).cast("string").cast("binary")))
    side = lambda p: o.filter(p).groupBy("hash").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.count(F.lit(1)).alias("visits"))
    return sl.upsert(side("o_orderkey % 2 = 0"), side("o_orderkey % 2 <> 0"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'formula' WHEN o_orderkey % 3 = 0 THEN 'hash' WHEN o_orderkey % 2 = 0 THEN 'node_count' END AS reason FROM orders")
def record_rejects(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.when(k % 5 != 0, "x").otherwise(" ").alias("formula"), F.when(k % 3 != 0, F.sha2(k.cast("string").cast("binary"), 256)).alias("hash"), (k % 2).alias("node_count"))
    return rows.select("o_orderkey", sl.reject_reasons(rows).alias("reason"))


_Z = ", ".join(candidate_sql("fp" if k == 1 else f"z{k - 1}", f"f{k}", f"z{k}", f"c{k}") for k in range(1, 5))
MATRIX_SQL = FACTOR_SQL + f", {_Z}, mx AS (SELECT t, date, stock, label, universe, coalesce(c1, 0) AS f1, coalesce(c2, 0) * -1 AS f2, coalesce(c3, 0) AS f3, coalesce(c4, 0) AS f4 FROM z4 WHERE universe AND industry IS NOT NULL), ew AS (SELECT *, (f1 + f2 + f3 + f4) / 4 AS score FROM mx)"
DIRECTIONS = {"f1": 1.0, "f2": -1.0, "f3": 1.0, "f4": 1.0}
#: Names with a known industry are fewer than 20 on the brand panel.
LEAST = 10


def _matrix(spark, sf_dir):
    return bt.factor_matrix(factor_panel(spark, sf_dir), DIRECTIONS, F.col("universe"))


@query(MATRIX_SQL + f" SELECT t, stock, {_out(*DIRECTIONS)} FROM mx")
def factor_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("t", "stock", *_cols(*DIRECTIONS))


@query(MATRIX_SQL + f" SELECT t, stock, {_out('score')} FROM ew")
def equal_weight_scores(spark, sf_dir):
    return bt.equal_weight(_matrix(spark, sf_dir), DIRECTIONS).select("t", "stock", *_cols("score"))


@query(MATRIX_SQL + ", lg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS factor, t, label, {k} AS x FROM mx" for k in DIRECTIONS) + f"), {ic_sql('lg', 'x', 'label', 'i', 'factor, t', LEAST)} SELECT factor, t, n, {_out('ic')} FROM i")
def periodic_ic(spark, sf_dir):
    return bt.periodic_ic(_matrix(spark, sf_dir), DIRECTIONS, "label", LEAST).select("factor", "t", "n", *_cols("ic"))


_LONG_IC = MATRIX_SQL + ", lg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS factor, t, stock, label, {k} AS x FROM mx" for k in DIRECTIONS) + f"), {ic_sql('lg', 'x', 'label', 'i', 'factor, t', LEAST)}"


def icir_sql(ic, periods, history, least, cap, n=4, update=4):
    """CTEs up to wt(u, factor, weight). ic: a CTE (factor, p, ic); periods: a CTE (p)."""
    return f"""ua AS (SELECT DISTINCT p AS u, greatest(p - 2, -1) AS upto FROM {periods} WHERE p >= 0 AND p % {update} = 0),
ug AS (SELECT u, upto, factor FROM ua, (SELECT DISTINCT factor FROM {ic})),
us AS (SELECT ug.u, ug.factor, CASE WHEN count(ic) >= {least} AND stddev_samp(ic) > 1e-12::DOUBLE THEN greatest(0, avg(ic) / stddev_samp(ic)) ELSE 0 END AS ratio
  FROM ug LEFT JOIN {ic} h ON h.factor = ug.factor AND h.p <= upto AND h.p > upto - {history} GROUP BY ug.u, ug.factor),
uq AS (SELECT *, sum(ratio) OVER (PARTITION BY u) AS total, quantile_cont(CASE WHEN ratio > 0 THEN ratio END, 0.95) OVER (PARTITION BY u) AS most FROM us),
uc AS (SELECT *, CASE WHEN total > 1e-12::DOUBLE THEN least(ratio, most) END AS clipped FROM uq),
uw AS (SELECT *, 0.5::DOUBLE / {n} + 0.5::DOUBLE * clipped / sum(clipped) OVER (PARTITION BY u) AS w FROM uc),
ur AS (SELECT *, least(w, {cap}::DOUBLE) + coalesce(greatest({cap}::DOUBLE - w, 0) * sum(greatest(w - {cap}::DOUBLE, 0)) OVER (PARTITION BY u) / nullif(sum(greatest({cap}::DOUBLE - w, 0)) OVER (PARTITION BY u), 0), 0) AS v FROM uw),
wt AS (SELECT u, factor, coalesce(last_value(CASE WHEN w IS NOT NULL THEN v END IGNORE NULLS) OVER (PARTITION BY factor ORDER BY u), 1.0::DOUBLE / {n}) AS weight FROM ur)"""


def _weighted(spark, sf_dir):
    m = _matrix(spark, sf_dir).withColumn("p", F.col("t")).persist()  # for coefficients, periods and scores
    ic = bt.periodic_ic(m, DIRECTIONS, "label", LEAST).select("factor", F.col("t").alias("p"), "ic")
    return m, bt.icir_weights(ic, list(DIRECTIONS), m.select("p").distinct(), history=60, least=30, cap=0.4)


_WEIGHTED = _LONG_IC + ", hi AS (SELECT factor, t AS p, ic FROM i), pe AS (SELECT DISTINCT t AS p FROM mx), " + icir_sql("hi", "pe", 60, 30, 0.4)


@query(_WEIGHTED + f" SELECT u, factor, {_out('weight')} FROM wt")
def rolling_icir_weights(spark, sf_dir):
    return _weighted(spark, sf_dir)[1].select("u", "factor", *_cols("weight"))


@query(_WEIGHTED + " SELECT t, stock, round(sum(weight * x), 6) + 0.0 AS score FROM lg JOIN wt ON wt.factor = lg.factor AND wt.u = lg.t - lg.t % 4 GROUP BY t, stock")
def rolling_icir_scores(spark, sf_dir):
    return bt.rolling_scores(*_weighted(spark, sf_dir), list(DIRECTIONS)).select("t", "stock", *_cols("score"))


#: First period out of sample; the coefficients of those before seed the weights. f4 has few of them, and all of the first year are negated.
TEST = 150


def _seeded(spark, sf_dir):
    m = _matrix(spark, sf_dir).persist()  # for coefficients, periods and scores
    ic = bt.periodic_ic(m, DIRECTIONS, "label", LEAST).withColumn("p", F.col("t") - TEST)
    ic = ic.select("factor", "p", F.when((F.col("factor") != "f4") | (F.col("p") >= -40), F.when(F.col("p") < -100, -F.abs("ic")).otherwise(F.col("ic"))).alias("ic"))
    test = m.filter(F.col("t") >= TEST).withColumn("p", (F.col("t") - TEST).cast("int"))
    return m, test, bt.icir_weights(ic, list(DIRECTIONS), test.select("p").distinct(), history=100, least=60, cap=0.3)


_SEEDED = _LONG_IC + f", hi AS (SELECT factor, t - {TEST} AS p, CASE WHEN factor <> 'f4' OR t - {TEST} >= -40 THEN CASE WHEN t - {TEST} < -100 THEN -abs(ic) ELSE ic END END AS ic FROM i), pe AS (SELECT DISTINCT t - {TEST} AS p FROM mx WHERE t >= {TEST}), " + icir_sql("hi", "pe", 100, 60, 0.3)


@query(_SEEDED + f" SELECT u, factor, {_out('weight')} FROM wt")
def rolling_icir_seeded(spark, sf_dir):
    return _seeded(spark, sf_dir)[2].select("u", "factor", *_cols("weight"))


# out of sample: three strategies on test dates, on a five-hundredth of the returns, which swing too far to compound

OOS_SQL = _SEEDED + f""", rs AS (SELECT t, stock, sum(weight * x) AS score FROM lg JOIN wt ON wt.factor = lg.factor AND wt.u = (lg.t - {TEST}) - (lg.t - {TEST}) % 4 WHERE t >= {TEST} GROUP BY t, stock),
sc AS (SELECT 'equal' AS strategy, t, stock, score FROM ew WHERE t >= {TEST} UNION ALL SELECT 'rolling', t, stock, score FROM rs UNION ALL SELECT 'second', t, stock, f2 FROM mx WHERE t >= {TEST}),
rw AS (SELECT sc.*, date, label / 500 AS label FROM sc JOIN (SELECT t, stock, date, label FROM fp) l USING (t, stock)),
cs AS (SELECT strategy, t, count(*) AS eligible, count(label) AS labelled, max(score) FILTER (label IS NOT NULL) - min(score) FILTER (label IS NOT NULL) AS width FROM rw GROUP BY ALL),
cd AS (SELECT t, max(eligible) AS eligible, max(labelled) AS labelled, list_sort(list(strategy || ' has constant scores') FILTER (width <= 1e-9::DOUBLE)) AS flat FROM cs GROUP BY t),
cv AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::INT AS p, eligible, labelled, concat_ws('|', CASE WHEN labelled < {LEAST} THEN 'too few labels' END, array_to_string(flat, '|')) AS reasons FROM cd),
gd AS (SELECT rw.*, p FROM rw JOIN cv USING (t) WHERE reasons = '' AND label IS NOT NULL),
{ic_sql('gd', 'score', 'label', 'oi', 'strategy, t', LEAST)},
ag AS (SELECT *, ntile(10) OVER (PARTITION BY strategy, t ORDER BY score, stock) AS g FROM gd QUALIFY count(*) OVER (PARTITION BY strategy, t) >= {LEAST}),
gr AS (SELECT strategy, t, date, p, {', '.join(f'avg(label) FILTER (g = {k}) AS g{k}' for k in range(1, 11))}, avg(label) AS benchmark, avg(label) FILTER (g = 10) - avg(label) FILTER (g = 1) AS spread, avg(label) FILTER (g = 10) - avg(label) AS excess FROM ag GROUP BY ALL),
ho AS (SELECT strategy, p, stock, label AS ret, 1.0::DOUBLE / count(*) OVER (PARTITION BY strategy, p) AS w FROM ag WHERE g = 10),
dd AS (SELECT strategy, p + 1 AS p, stock, w * (1 + ret) / sum(w * (1 + ret)) OVER (PARTITION BY strategy, p) AS drift FROM ho),
bo AS (SELECT coalesce(ho.strategy, dd.strategy) AS strategy, coalesce(ho.p, dd.p) AS p, sum(abs(coalesce(w, 0) - coalesce(drift, 0))) / 2 AS moved, 1 - count(CASE WHEN w IS NOT NULL AND drift IS NOT NULL THEN 1 END) / count(w)::DOUBLE AS gone, count(w) AS names, count(drift) AS old
  FROM ho FULL JOIN dd ON ho.strategy = dd.strategy AND ho.p = dd.p AND ho.stock = dd.stock GROUP BY 1, 2),
tu AS (SELECT strategy, bo.p, CASE WHEN old > 0 THEN moved END AS turnover, CASE WHEN old > 0 THEN gone END AS replaced FROM bo WHERE names > 0),
pf AS (SELECT gr.*, g10 AS long, turnover, turnover * 0.002::DOUBLE AS cost, g10 - turnover * 0.002::DOUBLE AS net FROM gr LEFT JOIN tu USING (strategy, p)),
sx AS ({' UNION ALL '.join(f"SELECT strategy, '{k}' AS series, t, date, {k} AS x FROM pf" for k in ('long', 'benchmark', 'excess', 'spread'))}),
nv AS (SELECT *, product(1 + x) OVER (PARTITION BY strategy, series ORDER BY t) AS nav FROM sx),
dn AS (SELECT *, nav / greatest(1, max(nav) OVER (PARTITION BY strategy, series ORDER BY t)) - 1 AS drawdown FROM nv)"""


def _oos(spark, sf_dir):
    m, test, weights = _seeded(spark, sf_dir)
    parts = [bt.equal_weight(test, DIRECTIONS).select(F.lit("equal").alias("strategy"), "t", "stock", "score"), bt.rolling_scores(test, weights, list(DIRECTIONS)).select(F.lit("rolling").alias("strategy"), "t", "stock", "score")]
    scores = parts[0].unionAll(parts[1]).unionAll(test.select(F.lit("second"), "t", "stock", F.col("f2")))
    labels = test.select("t", "stock", (F.col("label") / 500).alias("label"))
    return bt.OutOfSample(scores, labels, test.select("t", "date").distinct(), 0.002, LEAST)


@query(OOS_SQL + " SELECT t, p, eligible, labelled, reasons = '' AS valid, reasons FROM cv")
def oos_coverage(spark, sf_dir):
    return _oos(spark, sf_dir).coverage.select("t", "p", "eligible", "labelled", "valid", "reasons")


@query(OOS_SQL + f" SELECT strategy, t, {_out('long', 'benchmark', 'excess', 'spread', 'turnover', 'cost', 'net')} FROM pf")
def oos_portfolio(spark, sf_dir):
    return _oos(spark, sf_dir).portfolio.select("strategy", "t", *_cols("long", "benchmark", "excess", "spread", "turnover", "cost", "net"))


@query(OOS_SQL + " SELECT strategy, series, date, round(nav, 8) AS nav, round(drawdown, 8) + 0.0 AS drawdown, false AS initial FROM dn UNION ALL SELECT strategy, series, min(date) - 1, 1.0::DOUBLE, 0.0::DOUBLE, true FROM sx GROUP BY strategy, series")
def oos_nav(spark, sf_dir):
    return _oos(spark, sf_dir).navs().select("strategy", "series", "date", F.round("nav", 8).alias("nav"), (F.round("drawdown", 8) + 0.0).alias("drawdown"), "initial")


@query(OOS_SQL + " SELECT strategy, series, count(x) AS n, round(pow(product(1 + x), 50.4::DOUBLE / count(x)) - 1, 8) + 0.0 AS annual, round(stddev_samp(x), 8) AS std, round(avg(x) / stddev_samp(x) * sqrt(50.4::DOUBLE), 8) + 0.0 AS ratio, round(least(0, min(drawdown)), 8) + 0.0 AS max_drawdown, round(avg((x > 1e-12::DOUBLE)::INT::DOUBLE), 8) AS wins FROM dn GROUP BY ALL")
def oos_performance(spark, sf_dir):
    out = _oos(spark, sf_dir).performance()
    return out.select("strategy", "series", "n", *[(F.round(c, 8) + 0.0).alias(c) for c in ("annual", "std", "ratio", "max_drawdown", "wins")])


_MEANS = [*(f"g{k}" for k in range(1, 11)), "spread"]


@query(OOS_SQL + f""", a AS (SELECT strategy, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir, avg(CASE WHEN ic IS NOT NULL THEN (ic > 1e-12::DOUBLE)::INT::DOUBLE END) AS positive, count(ic) AS valid FROM oi GROUP BY strategy),
b AS (SELECT strategy, {', '.join(f'avg({k}) AS {k}' for k in _MEANS)} FROM gr GROUP BY strategy),
c AS (SELECT strategy, avg(turnover) AS turnover_mean, quantile_cont(turnover, 0.5) AS turnover_median, quantile_cont(turnover, 0.75) AS turnover_p75, max(turnover) AS turnover_most, count(turnover) AS turnovers, avg(replaced) AS replaced_mean FROM tu GROUP BY strategy)
SELECT strategy, {_out('mean', 'std', 'icir', 'positive', *_MEANS, 'turnover_mean', 'turnover_median', 'turnover_p75', 'turnover_most', 'replaced_mean')}, valid, turnovers FROM a JOIN b USING (strategy) JOIN c USING (strategy)""")
def oos_summary(spark, sf_dir):
    out = _oos(spark, sf_dir).summary()
    return out.select("strategy", *_cols("mean", "std", "icir", "positive", *_MEANS, "turnover_mean", "turnover_median", "turnover_p75", "turnover_most", "replaced_mean"), "valid", "turnovers")


_WIDE = [(k, c, x) for k in ("long", "benchmark", "excess", "spread") for c, x in (("annual", "pow(product(1 + x), 50.4::DOUBLE / count(x)) - 1"), ("max_drawdown", "least(0, min(drawdown))"), ("wins", "avg((x > 1e-12::DOUBLE)::INT::DOUBLE)"))]


@query(OOS_SQL + ", pv AS (SELECT strategy, series, " + ", ".join(f"{x} AS {c}" for k, c, x in _WIDE if k == "long") + " FROM dn GROUP BY ALL), ic AS (SELECT strategy, avg(ic) AS mean FROM oi GROUP BY strategy) SELECT strategy, round(max(mean), 6) + 0.0 AS mean, "
    + ", ".join(f"round(max({c}) FILTER (series = '{k}'), 8) + 0.0 AS {k}_{c}" for k, c, _ in _WIDE) + " FROM pv JOIN ic USING (strategy) GROUP BY strategy")
def oos_report(spark, sf_dir):
    return _oos(spark, sf_dir).report().select("strategy", *_cols("mean"), *[(F.round(f"{k}_{c}", 8) + 0.0).alias(f"{k}_{c}") for k, c, _ in _WIDE])


@query(MATRIX_SQL + f" SELECT t, stock, round(score, 6) + 0.0 AS equal, {_out('f2', 'label')} FROM ew")
def score_pivot(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    scores = bt.equal_weight(m, DIRECTIONS).select(F.lit("equal").alias("strategy"), "t", "stock", "score").unionAll(m.select(F.lit("f2"), "t", "stock", "f2"))
    return bt.score_pivot(scores, m, ["equal", "f2"]).select("t", "stock", *_cols("equal", "f2", "label"))


@query()
def boosted_scores(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return bt.boosted_scores(m.filter("t < 200"), m.filter("t >= 206"), list(DIRECTIONS), "label").select("t", "stock", *_cols("score"))


@query(MATRIX_SQL + ", n AS (SELECT t, count(*) AS n FROM mx GROUP BY t), a AS (SELECT sum(n) AS total, count(*) AS d FROM n) SELECT t, stock, round(total / (d * n)::DOUBLE, 6) AS weight FROM mx JOIN n USING (t), a")
def date_weights(spark, sf_dir):
    return bt.date_weights(_matrix(spark, sf_dir)).select("t", "stock", F.round("weight", 6).alias("weight"))


DECILE_SQL = FACTOR_SQL + ", dc AS (SELECT t, stock, label, ntile(10) OVER (PARTITION BY t ORDER BY f1, stock) AS g FROM fp WHERE f1 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY t) >= 20), dr AS (SELECT t, " + ", ".join(f"avg(label) FILTER (g = {k}) AS g{k}" for k in range(1, 11)) + ", avg(label) AS benchmark, avg(label) FILTER (g = 10) - avg(label) FILTER (g = 1) AS spread, avg(label) FILTER (g = 10) - avg(label) AS excess FROM dc GROUP BY t)"


def _deciles(spark, sf_dir):
    return bt.deciles(factor_panel(spark, sf_dir), "f1")


@query(DECILE_SQL + " SELECT t, stock, g::INT AS g FROM dc")
def deciles(spark, sf_dir):
    return _deciles(spark, sf_dir).select("t", "stock", "g")


@query(DECILE_SQL + f" SELECT t, {_out(*[f'g{k}' for k in range(1, 11)], 'benchmark', 'spread', 'excess')} FROM dr")
def decile_returns(spark, sf_dir):
    return bt.decile_returns(_deciles(spark, sf_dir), "label").select("t", *_cols(*[f"g{k}" for k in range(1, 11)], "benchmark", "spread", "excess"))


@query(DECILE_SQL + ", u AS (" + " UNION ALL ".join(f"SELECT 'g{k}' AS g, (g{k} - benchmark) / 10000 AS x FROM dr" for k in range(1, 11)) + ") SELECT g, count(x) AS n, round(exp(sum(ln(1 + x)) * 50.4::DOUBLE / count(x)) - 1, 5) + 0.0 AS annual FROM u GROUP BY g")
def decile_excess_annualised(spark, sf_dir):
    out = bt.decile_returns(_deciles(spark, sf_dir), "label")
    names = [f"g{k}" for k in range(1, 11)]
    long = ev.long_form(out.select("t", *[((F.col(g) - F.col("benchmark")) / 10000).alias(g) for g in names]), names, ("t",), "g").filter("x is not null")
    return long.groupBy("g").agg(F.count("x").alias("n"), (F.round(F.pow(F.product(F.col("x") + 1), F.lit(ev.PERIODS) / F.count("x")) - 1, 5) + 0.0).alias("annual"))


@query(FACTOR_SQL + f", {ic_sql('fp', 'f1', 'label', 'i')} SELECT t, {_out('ic')}, round(sum(ic) OVER (ORDER BY t), 5) + 0.0 AS total FROM i")
def cumulative_ic(spark, sf_dir):
    ic = ev.rank_correlation(factor_panel(spark, sf_dir), "f1", "label")
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return ic.select("t", *_cols("ic"), (F.round(F.sum("ic").over(w), 5) + 0.0).alias("total"))


TURNOVER_SQL = DECILE_SQL + """, h AS (SELECT t AS p, stock, label AS ret, 1.0::DOUBLE / count(*) OVER (PARTITION BY t) AS w FROM dc WHERE g = 10),
pv AS (SELECT t AS p, t % 10 <> 3 AS valid FROM (SELECT DISTINCT t FROM fp)), dd AS (SELECT p + 1 AS p, stock, w * (1 + ret) / sum(w * (1 + ret)) OVER (PARTITION BY p) AS drift, bool_or(ret IS NULL) OVER (PARTITION BY p) AS bad FROM h),
bo AS (SELECT coalesce(h.p, dd.p) AS p, sum(abs(coalesce(w, 0) - coalesce(drift, 0))) / 2 AS turnover, 1 - count(CASE WHEN w IS NOT NULL AND bad IS NOT NULL THEN 1 END) / count(w)::DOUBLE AS replaced, bool_or(coalesce(bad, false)) AS bad, count(w) AS names, count(bad) AS old FROM h FULL JOIN dd ON h.p = dd.p AND h.stock = dd.stock GROUP BY 1),
ok AS (SELECT p, valid AND coalesce(lag(valid) OVER (ORDER BY p), false) AS ok FROM pv),
tu AS (SELECT ok.p, CASE WHEN ok AND NOT bad AND names > 0 AND old > 0 THEN turnover END AS turnover, CASE WHEN ok AND NOT bad AND names > 0 AND old > 0 THEN replaced END AS replaced FROM ok LEFT JOIN bo ON bo.p = ok.p)"""


def _turnover(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    holdings = bt.deciles(p, "f1").filter("g = 10").select(F.col("t").alias("p"), "stock", F.col("label").alias("ret"))
    return bt.turnover(holdings, p.select(F.col("t").alias("p")).distinct().withColumn("valid", F.col("p") % 10 != 3))


@query(TURNOVER_SQL + f" SELECT p, {_out('turnover', 'replaced')} FROM tu")
def drift_turnover(spark, sf_dir):
    return _turnover(spark, sf_dir).select("p", *_cols("turnover", "replaced"))


@query(TURNOVER_SQL + f" SELECT {_out('mean', 'median', 'p75', 'most')}, n FROM (SELECT avg(turnover) AS mean, quantile_cont(turnover, 0.5) AS median, quantile_cont(turnover, 0.75) AS p75, max(turnover) AS most, count(turnover) AS n FROM tu)")
def turnover_summary(spark, sf_dir):
    out = _turnover(spark, sf_dir).agg(F.avg("turnover").alias("mean"), F.percentile("turnover", F.lit(0.5)).alias("median"), F.percentile("turnover", F.lit(0.75)).alias("p75"), F.max("turnover").alias("most"), F.count("turnover").alias("n"))
    return out.select(*_cols("mean", "median", "p75", "most"), "n")


@query(TURNOVER_SQL + " SELECT dr.t, round(coalesce(turnover, 0) * 0.002::DOUBLE, 6) + 0.0 AS cost, round(g10 - coalesce(turnover, 0) * 0.002::DOUBLE, 6) + 0.0 AS net FROM dr LEFT JOIN tu ON tu.p = dr.t")
def net_returns(spark, sf_dir):
    r = bt.decile_returns(_deciles(spark, sf_dir), "label").select("t", "g10")
    out = r.join(_turnover(spark, sf_dir).withColumnRenamed("p", "t"), "t", "left")
    return bt.net_of_costs(out, "g10", 0.002).select("t", *_cols("cost", "net"))


NAV_SQL = FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')}, nv AS (SELECT t, long_short / 10000 AS r, exp(sum(ln(1 + long_short / 10000)) OVER (ORDER BY t)) AS nav FROM l), dn AS (SELECT *, nav / greatest(1, max(nav) OVER (ORDER BY t)) - 1 AS drawdown FROM nv)"


def _ls(spark, sf_dir):
    """A small part of the long-short return: unit prices of the star schema swing too far to compound."""
    return ev.portfolios(factor_panel(spark, sf_dir), "f1", "label").select("t", (F.col("long_short") / 10000).alias("r"))


@query(NAV_SQL + " SELECT t, round(nav, 5) AS nav, round(drawdown, 5) + 0.0 AS drawdown FROM dn")
def nav_drawdown(spark, sf_dir):
    return bt.nav(_ls(spark, sf_dir), "r").select("t", F.round("nav", 5).alias("nav"), (F.round("drawdown", 5) + 0.0).alias("drawdown"))


@query(NAV_SQL + " SELECT count(r) AS n, round(exp(sum(ln(1 + r)) * 50.4::DOUBLE / count(r)) - 1, 5) AS annual, round(stddev_samp(r), 6) AS std, round(avg(r) / stddev_samp(r) * sqrt(50.4::DOUBLE), 5) AS ratio, round(least(0, min(drawdown)), 5) AS max_drawdown FROM dn")
def performance(spark, sf_dir):
    out = bt.performance(_ls(spark, sf_dir), "r")
    return out.select("n", F.round("annual", 5).alias("annual"), F.round("std", 6).alias("std"), F.round("ratio", 5).alias("ratio"), F.round("max_drawdown", 5).alias("max_drawdown"))


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')}, da AS (SELECT DISTINCT t, date FROM fp) SELECT year(date)::INT AS year, round(exp(sum(ln(1 + excess / 10000))) - 1, 6) + 0.0 AS annual, count(*) AS n FROM l JOIN da USING (t) GROUP BY 1")
def annual_returns(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    legs = ev.portfolios(p, "f1", "label").withColumn("excess", F.col("excess") / 10000).join(p.select("t", "date").distinct(), "t")
    return bt.annual_returns(legs, "excess").select("year", *_cols("annual"), "n")


@query(FACTOR_SQL + ", " + ", ".join(ic_sql("fp", f"f{a}", f"f{b}", f"i{a}{b}") for a in range(1, 5) for b in range(a + 1, 5)) + " " + " UNION ALL ".join(f"SELECT 'f{a}' AS a, 'f{b}' AS b, round(avg(ic), 6) + 0.0 AS correlation, count(ic) AS dates FROM i{a}{b}" for a in range(1, 5) for b in range(a + 1, 5)))
def score_correlation(spark, sf_dir):
    scores = ev.long_form(factor_panel(spark, sf_dir), FACTORS, name="strategy", value="score").filter("score is not null")
    return bt.score_correlation(scores).select("a", "b", *_cols("correlation"), "dates")


_SPLIT = "CASE WHEN t < 150 THEN 'train' WHEN t < 250 THEN 'validation' ELSE 'test' END"


@query(DECILE_SQL + f""", kn AS (SELECT t, stock, label, f1, {_SPLIT} AS split FROM fp WHERE f1 IS NOT NULL AND label IS NOT NULL QUALIFY max(f1) OVER (PARTITION BY t) > min(f1) OVER (PARTITION BY t)), {ic_sql('kn', 'f1', 'label', 'i')},
s AS (SELECT {_SPLIT} AS split, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / stddev_samp(ic) AS icir, count(ic) AS valid, count(*) AS total, avg((ic > 1e-12::DOUBLE)::INT::DOUBLE) AS positive FROM i WHERE n >= 20 GROUP BY ALL),
g AS (SELECT split, t, label, ntile(10) OVER (PARTITION BY t ORDER BY f1, stock) AS g FROM kn QUALIFY count(*) OVER (PARTITION BY t) >= 20),
m AS (SELECT split, avg(spread) AS spread FROM (SELECT split, t, avg(label) FILTER (g = 10) - avg(label) FILTER (g = 1) AS spread FROM g GROUP BY ALL) GROUP BY split)
SELECT split, {_out('mean', 'std', 'icir', 'positive', 'spread')}, valid, total FROM s LEFT JOIN m USING (split)""")
def split_effectiveness(spark, sf_dir):
    p = factor_panel(spark, sf_dir).withColumn("split", F.when(F.col("t") < 150, "train").when(F.col("t") < 250, "validation").otherwise("test"))
    return bt.split_effectiveness(p, "f1", "label").select("split", *_cols("mean", "std", "icir", "positive", "spread"), "valid", "total")


# generation


# fixed values: names of the leaves and of the operators of one operand, spelt out here so that the SQL doesn't depend on the library
ENUMERATION_SQL = """WITH leaf AS (SELECT unnest(['open', 'high', 'low', 'close', 'vwap', 'volume']) AS x),
op AS (SELECT unnest(['abs', 'neg', 'sign', 'log', 'inv', 'sqrt', 'tanh', 'relu', 'softsign', 'signed_power2', 'signed_power3', 'signed_log1p',
  'cs_rank', 'cs_zscore', 'cs_demean', 'cs_scale', 'cs_normalize', 'cs_winsorize', 'cs_truncate', 'cs_quantile', 'cs_rank_gauss']) AS name, NULL::INT AS n
 UNION ALL SELECT name, n FROM (SELECT unnest(['ts_mean', 'ts_std', 'ts_max', 'ts_min', 'ts_rank', 'ts_delay', 'ts_delta', 'ts_sum', 'ts_argmax', 'ts_argmin',
  'ts_wma', 'ts_ema', 'ts_slope', 'ts_residual', 'ts_zscore', 'ts_position', 'ts_range']) AS name), (SELECT unnest([5, 10, 20, 40, 60]) AS n)),
e AS (SELECT x AS formula, x AS prefix, '["' || x || '"]' AS json, 1 AS nodes, 0 AS depth, 0 AS lookback, x = 'close' AS field, false AS mean FROM leaf
 UNION ALL SELECT name || '(' || x || coalesce(', ' || n, '') || ')', name || coalesce('@' || n, '') || ' ' || x, '["' || name || coalesce('@' || n, '') || '",["' || x || '"]]',
  2, 1, CASE WHEN n IS NULL THEN 0 WHEN name IN ('ts_delay', 'ts_delta') THEN n ELSE n - 1 END, x = 'close', name = 'ts_mean' FROM leaf, op),
x AS (SELECT sha256('strandline.expression.v1' || chr(0) || json) AS hash, formula, prefix, nodes, depth, lookback, field::INT::DOUBLE + mean::INT::DOUBLE - 0.1::DOUBLE * nodes AS log_reward FROM e)
"""


@query(ENUMERATION_SQL + "SELECT * FROM x")
def enumerate_two_nodes(spark, sf_dir):
    rows = [(n.hash(), n.formula(), " ".join(n.prefix()), n.stats()["nodes"], n.depth(), n.lookback(), float(synthetic_log_reward(n))) for k in (1, 2) for n in Grammar().enumerate(k)]
    return spark.createDataFrame(rows, "hash string, formula string, prefix string, nodes int, depth int, lookback int, log_reward double")


_FORMS = [
    ("add(close, open)", "add close open", "close open add", 3, 1, 2, 0, 2),
    ("ts_mean(add(open, close), 20)", "ts_mean@20 add close open", "close open add ts_mean@20", 4, 2, 2, 19, 2),
    ("ts_corr(cs_rank(volume), sub(high, low), 10)", "ts_corr@10 cs_rank volume sub high low", "volume cs_rank high low sub ts_corr@10", 6, 2, 3, 9, 3),
    ("mul(neg(close), neg(close))", "mul neg close neg close", "close neg close neg mul", 5, 2, 2, 0, 1),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {n}, {d}, {v}, {k}, {p})" for a, b, c, n, d, v, k, p in _FORMS) + ") AS v(formula, prefix, postfix, nodes, depth, leaves, lookback, parents)")
def expression_forms(spark, sf_dir):
    g, rows = Grammar(), []
    for f, *_ in _FORMS:
        e = parse(f).canonical()
        rows.append((f, " ".join(e.prefix()), " ".join(e.postfix()), e.stats()["nodes"], e.depth(), e.stats()["leaves"], e.lookback(), g.parents(e)))
    return spark.createDataFrame(rows, "formula string, prefix string, postfix string, nodes int, depth int, leaves int, lookback int, parents int")


@query("SELECT * FROM (VALUES (1, 6::BIGINT), (2, 636::BIGINT), (3, 68436::BIGINT)) AS v(nodes, expressions)")
def expression_counts(spark, sf_dir):
    return spark.createDataFrame([(n, Grammar().count(n)) for n in (1, 2, 3)], "nodes int, expressions long")


@query("SELECT * FROM (VALUES ('leaf', 6::BIGINT), ('unary', 12::BIGINT), ('binary', 10::BIGINT), ('section', 9::BIGINT), ('series', 105::BIGINT)) AS v(kind, n)")
def vocabulary(spark, sf_dir):
    return spark.createDataFrame([(a.token, a.kind) for a in actions()], "token string, kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def sampled_expressions(spark, sf_dir):
    g = Grammar()
    rows = [(n, s, e.formula(), e.canonical().hash(), parse(e.formula()) == e) for n in range(1, 8) for s in range(5) for e in [g.sample(n, 1000 * n + s)]]
    return spark.createDataFrame(rows, "nodes int, seed int, formula string, hash string, round_trip boolean")


@query("WITH c AS (SELECT o_orderstatus AS stratum, o_totalprice / 100000 - 3 AS x FROM orders), m AS (SELECT stratum, max(x) AS m FROM c GROUP BY stratum) SELECT stratum, round(max(m) + ln(sum(exp(x - m))), 6) AS log_mass, count(*) AS n FROM c JOIN m USING (stratum) GROUP BY stratum")
def partition_mass(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stratum"), (F.col("o_totalprice") / 100000 - 3).alias("x"))
    return rp.log_sum_exp(c, "x", ("stratum",)).select("stratum", F.round("log_mass", 6).alias("log_mass"), "n")


@query("SELECT o_orderstatus AS condition, round(avg(pow(1.5::DOUBLE + o_orderkey % 3 - o_totalprice / 100000 - ln(1 + o_custkey), 2)), 6) AS trajectory_balance, round(var_pop(o_totalprice / 100000 + ln(1 + o_custkey) - o_orderkey % 3), 6) AS log_partition_variance, count(*) AS n FROM orders GROUP BY 1")
def flow_losses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("condition"), F.lit(1.5).alias("z"), (F.col("o_orderkey") % 3).cast("double").alias("f"), (F.col("o_totalprice") / 100000).alias("r"), F.log1p("o_custkey").alias("b"))
    out = rp.flow_losses(o, ("condition",), "z", "f", "r", "b")
    return out.select("condition", F.round("trajectory_balance", 6).alias("trajectory_balance"), F.round("log_partition_variance", 6).alias("log_partition_variance"), "n")


@query("WITH c AS (SELECT o_orderstatus AS stratum, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 100000 - 3 END AS x FROM orders), m AS (SELECT stratum, max(x) AS m FROM c GROUP BY stratum) SELECT stratum, round(max(m) + ln(sum(exp(x - m))), 6) AS log_mass, round(exp(max(m)) * sum(exp(x - m)), 4) AS mass, count(x) AS valid, (count(*) - count(x))::BIGINT AS invalid FROM c JOIN m USING (stratum) GROUP BY stratum")
def exact_masses(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stratum"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100000 - 3).alias("x"))
    return rp.masses(c, "x", ("stratum",)).select("stratum", F.round("log_mass", 6).alias("log_mass"), F.round("mass", 4).alias("mass"), "valid", "invalid")


@query("WITH e AS (SELECT n, (n * n * 10)::BIGINT AS expected FROM range(1, 9) r(n)), s AS (SELECT p_size % 7 + 1 AS n, count(*) AS evaluated, count(*) FILTER (p_retailprice > 1200) AS valid FROM part GROUP BY 1) SELECT n::INT AS n, expected, coalesce(evaluated, 0) AS evaluated, coalesce(valid, 0) AS valid, round(coalesce(evaluated, 0) / expected::DOUBLE, 6) AS share, round(valid / evaluated::DOUBLE, 6) AS valid_share, coalesce(evaluated, 0) >= expected AS complete FROM e LEFT JOIN s USING (n)")
def stratum_coverage(spark, sf_dir):
    seen = table(spark, sf_dir, "part").select((F.col("p_size") % 7 + 1).cast("int").alias("n"), (F.col("p_retailprice") > 1200).alias("valid"))
    out = rp.stratum_coverage(seen, spark.createDataFrame([(n, n * n * 10) for n in range(1, 9)], "n int, expected long"), "n")
    return out.select("n", "expected", "evaluated", "valid", F.round("share", 6).alias("share"), F.round("valid_share", 6).alias("valid_share"), "complete")


@query(CANDIDATE_SQL + ", x AS (SELECT *, row_number() OVER (ORDER BY abs(train_ic) DESC, hash) AS i, row_number() OVER (ORDER BY train_ratio DESC, hash) AS r FROM c) SELECT hash, CASE WHEN i <= 5 THEN 'ic' ELSE 'ratio' END AS by, (CASE WHEN i <= 5 THEN i ELSE r END)::INT AS place FROM x WHERE i <= 5 OR r <= 5")
def quality_examples(spark, sf_dir):
    return rp.examples(_candidates(spark, sf_dir), [("ic", [F.desc(F.abs("train_ic")), "hash"]), ("ratio", [F.desc("train_ratio"), "hash"])]).select("hash", "by", "place")


@query(CANDIDATE_SQL + " SELECT o_orderstatus, count(validation_ic) AS n, round(avg(validation_ic), 8) + 0.0 AS mean, round(quantile_cont(validation_ic, 0.5), 6) + 0.0 AS median, round(stddev_pop(validation_ic), 6) AS std, round(min(validation_ic), 6) AS least, round(max(validation_ic), 6) AS most FROM c GROUP BY 1")
def ic_distribution(spark, sf_dir):
    out = rp.distribution(_candidates(spark, sf_dir), "validation_ic", ("o_orderstatus",))
    return out.select("o_orderstatus", "n", (F.round("mean", 8) + 0.0).alias("mean"), *_cols("median"), *[F.round(c, 6).alias(c) for c in ("std", "least", "most")])


@query(SERIES_SQL + f" SELECT count(c) AS n, {_out('avg(c)')[:-len(' AS avg(c)')]} AS mean, round(quantile_cont(c, 0.5), 6) + 0.0 AS median, round(min(c), 6) AS least, round(max(c), 6) AS most, round(avg(abs(c)), 6) AS absolute_mean, round(quantile_cont(abs(c), 0.5), 6) AS absolute_median, round(min(abs(c)), 6) AS absolute_least, round(max(abs(c)), 6) AS absolute_most FROM pc")
def correlation_summary(spark, sf_dir):
    out = rp.matrix_summary(sl.pair_correlations(*_series(spark, sf_dir)))
    return out.select("n", *_cols(*[k + c for k in ("", "absolute_") for c in ("mean", "median", "least", "most")]))


# reports


@query("SELECT event_type, count(*) AS n, round(arg_min(value, event_id), 6) AS first, round(quantile_cont(value, 0.5), 6) AS median, round(arg_max(value, event_id), 6) AS last, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def numeric_summary(spark, sf_dir):
    out = rp.numeric_summary(table(spark, sf_dir, "events"), "value", "event_id", ("event_type",))
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("first", "median", "last", "least", "most", "mean", "p95")])


@query("""WITH tok AS (SELECT p_partkey AS hash, unnest(string_split(p_type, ' ')) AS token FROM part), a AS (SELECT count(DISTINCT p_partkey) AS n FROM part)
SELECT token AS name, 'word' AS kind, count(*) AS occurrences, count(DISTINCT hash) AS candidates, round(count(DISTINCT hash) / max(n)::DOUBLE, 6) AS share FROM tok, a GROUP BY token""")
def token_usage(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), F.split("p_type", " ").alias("tokens"))
    words = c.select(F.explode("tokens").alias("token")).distinct().select("token", F.col("token").alias("name"), F.lit("word").alias("kind"))
    return rp.token_usage(c, words).select("name", "kind", "occurrences", "candidates", F.round("share", 6).alias("share"))


@query("""WITH tok AS (SELECT p_partkey AS hash, unnest(string_split(p_type, ' ')) AS token FROM part), a AS (SELECT count(DISTINCT p_partkey) AS n FROM part)
SELECT length(token)::INT AS size, count(*) AS occurrences, count(DISTINCT hash) AS candidates, round(count(DISTINCT hash) / max(n)::DOUBLE, 6) AS share
FROM tok, a GROUP BY length(token)""")
def family_usage(spark, sf_dir):
    """Usage by family: words of one length stand for the windows of one operator."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), F.split("p_type", " ").alias("tokens"))
    words = c.select(F.explode("tokens").alias("token")).distinct().withColumn("size", F.length("token"))
    return rp.token_usage(c, words, ("size",)).withColumn("share", F.round("share", 6))


@query("""SELECT l_partkey AS hash, p_brand AS brand, p_size AS size, min(l_linenumber) > 3 AS cached, count(*) AS visits
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL""")
def diagnostic_records(spark, sf_dir):
    """Each part that was returned, once: its brand and size are its identity, and a row that was not cached is preferred."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("source"), (F.col("l_linenumber") > 3).alias("cached"))
    rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("hash"), "source", "brand", "size", "cached")
    return rp.unique_records(rows, "source", "R", ["brand", "size"], ["cached"])


@query("""WITH r AS (SELECT o_orderstatus AS branch, sha256(to_json({'branch': o_orderstatus, 'customer': o_custkey, 'hash': o_orderkey, 'note': CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END})::VARCHAR) AS h
 FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT branch, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM r GROUP BY branch""")
def candidate_snapshot(spark, sf_dir):
    """Fingerprints of two branches of records, one for each order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("branch"), F.col("o_custkey").alias("customer"), k.alias("hash"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("note"))
    return rp.set_fingerprints(rp.source_snapshot(rows, "branch", ["F", "O"]), "branch")


_QT = ("train_ic", "validation_ic", "train_ratio", "train_style")


@query(CANDIDATE_SQL + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(min({m}), 6) AS least, round(quantile_cont({m}, 0.25), 6) AS q25, round(quantile_cont({m}, 0.5), 6) + 0.0 AS median, round(quantile_cont({m}, 0.75), 6) AS q75, round(max({m}), 6) AS most, round(avg({m}), 6) + 0.0 AS mean, count_if({m} > 0.02)::BIGINT AS above FROM c" for m in _QT))
def quality_table(spark, sf_dir):
    out = rp.quality_table(_candidates(spark, sf_dir), list(_QT), dict.fromkeys(_QT, 0.02))
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("least", "q25")], *_cols("median"), *[F.round(c, 6).alias(c) for c in ("q75", "most")], *_cols("mean"), "above")


@query("""WITH a AS (SELECT (o_orderkey % 97) AS cycle, count(*) AS accepted FROM orders GROUP BY 1), b AS (SELECT (l_orderkey % 101) AS cycle, count(*) AS found FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.cycle, b.cycle) AS cycle, coalesce(accepted, 0) AS accepted, coalesce(found, 0) AS found FROM a FULL JOIN b ON a.cycle = b.cycle)
SELECT cycle, accepted, found, (sum(accepted) OVER (ORDER BY cycle))::BIGINT AS accepted_total, (sum(found) OVER (ORDER BY cycle))::BIGINT AS found_total, floor(cycle / 10)::BIGINT AS block, round(CASE WHEN accepted > 0 THEN found / accepted::DOUBLE END, 6) AS new_share FROM j""")
def exploration(spark, sf_dir):
    accepted = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("cycle"))
    out = rp.exploration(accepted, table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 101).alias("cycle")))
    return out.withColumn("new_share", F.round("new_share", 6))


@query(CANDIDATE_SQL + ", f AS (SELECT 0 AS k, 'all' AS stage, count(*) AS n FROM c UNION ALL SELECT 1, 'train', count(*) FROM t WHERE a AND d AND f UNION ALL SELECT 2, 'hard', count(*) FROM s WHERE failed = '') SELECT k, stage, n, coalesce(lag(n) OVER (ORDER BY k), n) AS input, coalesce(lag(n) OVER (ORDER BY k), n) - n AS rejected, round(n / coalesce(lag(n) OVER (ORDER BY k), n)::DOUBLE, 6) AS share FROM f")
def funnel(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    parts = [c, sl.train_prefilter(c).filter("passed"), sl.hard_filter(c).filter("passed")]
    rows = None
    for k, (name, p) in enumerate(zip(("all", "train", "hard"), parts, strict=True)):
        one = p.agg(F.lit(k).alias("k"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        rows = one if rows is None else rows.unionAll(one)
    return rp.funnel(rows).withColumn("share", F.round("share", 6))


def _depths(spark, sf_dir):
    """A record for each order, whose hash is its customer: as many visits of an expression as the customer has orders."""
    h = F.col("o_custkey")
    nodes = h % 7 + 3
    return table(spark, sf_dir, "orders").select(
        h.alias("hash"), nodes.cast("int").alias("nodes"), (h % 35 % 6 % nodes).cast("int").alias("depth"), (h % 3 != 0).alias("valid"),
        (h / 5000.0).alias("reward"), ((h - 2500) / 50000.0).alias("ic"), (h % 60 / 10.0).alias("seconds"),
    )


@query("""WITH d AS (SELECT DISTINCT o_custkey AS h FROM orders), r AS (SELECT h, (h % 7 + 3)::INT AS nodes, (h % 35 % 6 % (h % 7 + 3))::INT AS depth, h % 3 <> 0 AS valid, h / 5000.0::DOUBLE AS reward, (h - 2500) / 50000.0::DOUBLE AS ic, h % 60 / 10.0::DOUBLE AS seconds FROM d),
s AS (SELECT nodes, depth, count(*) AS n, count_if(valid) AS v, quantile_cont(reward, 0.9) AS r90, quantile_cont(reward, 0.99) AS r99, quantile_cont(abs(ic), 0.9) AS ic90, avg(seconds) AS ms, quantile_cont(seconds, 0.5) AS qs FROM r GROUP BY ALL),
g AS (SELECT nodes, allr, unnest(range(0, d + 1))::INT AS depth FROM (SELECT nodes, max(depth) AS d, count(*) AS allr FROM r GROUP BY nodes))
SELECT g.nodes, g.depth, coalesce(n, 0) AS n, round(coalesce(n, 0) / allr::DOUBLE, 6) AS share, round(v / n::DOUBLE, 6) AS valid_rate, round(r90, 6) AS reward90, round(r99, 6) AS reward99, round(ic90, 6) AS ic90, round(ms, 6) AS mean_seconds, round(qs, 6) AS median_seconds FROM g LEFT JOIN s ON g.nodes = s.nodes AND g.depth = s.depth""")
def depth_boundary(spark, sf_dir):
    out = rp.depth_table(_depths(spark, sf_dir))
    return out.select("nodes", "depth", "n", *[F.round(c, 6).alias(c) for c in ("share", "valid_rate", "reward90", "reward99", "ic90", "mean_seconds", "median_seconds")])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(sqrt(avg(value * value)), 6) AS rms, round(avg((value > 20)::INT::DOUBLE), 6) AS positive FROM events GROUP BY event_type")
def training_health(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = rp.health(e, "value", ("event_type",)), rp.health(e.withColumn("value", F.col("value") - 20), "value", ("event_type",))
    out = a.drop("positive").join(b.select("event_type", "positive"), "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "rms", "positive")])


@query("SELECT round(s_acctbal, 6) AS x, round(row_number() OVER (ORDER BY s_acctbal) / count(*) OVER ()::DOUBLE, 6) AS share FROM supplier")
def ecdf(spark, sf_dir):
    return rp.ecdf(table(spark, sf_dir, "supplier"), "s_acctbal").select(F.round("x", 6).alias("x"), F.round("share", 6).alias("share"))


@query("SELECT event_id, round(CASE WHEN count(value) OVER w >= 3 THEN quantile_cont(value, 0.5) OVER w END, 6) AS rolling_median FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_median(spark, sf_dir):
    return rp.rolling_median(table(spark, sf_dir, "events"), "value", "event_id", ("user_id",)).select("event_id", F.round("rolling_median", 6).alias("rolling_median"))


@query(CANDIDATE_SQL + "SELECT count(*) AS n, round(avg(train_ic), 6) + 0.0 AS mean_a, round(avg(validation_ic), 6) + 0.0 AS mean_b, round(avg((sign(train_ic) = sign(validation_ic))::INT::DOUBLE), 6) AS same_sign, round(avg(validation_ic - train_ic), 6) + 0.0 AS change, round(quantile_cont(validation_ic - train_ic, 0.5), 6) + 0.0 AS median_change FROM c WHERE validation_ic IS NOT NULL")
def stability(spark, sf_dir):
    return rp.stability(_candidates(spark, sf_dir), "train_ic", "validation_ic").select("n", *_cols("mean_a", "mean_b", "same_sign", "change", "median_change"))


@query("""WITH r AS (SELECT value, floor((row_number() OVER (ORDER BY event_id DESC) - 1) / 16) AS k FROM events), s AS (SELECT quantile_cont(value, 0.5) FILTER (k = 0) AS m, quantile_cont(value, 0.5) FILTER (k = 1) AS mb, quantile_cont(value, 0.75) FILTER (k = 0) - quantile_cont(value, 0.25) FILTER (k = 0) AS i, quantile_cont(value, 0.75) FILTER (k = 1) - quantile_cont(value, 0.25) FILTER (k = 1) AS ib FROM r WHERE k < 2)
SELECT 32::BIGINT AS n, round(m, 6) AS median, round(mb, 6) AS median_before, round(i, 6) AS iqr, round(ib, 6) AS iqr_before, abs(m - mb) <= 5 AND abs(i - ib) <= 5 AS stable FROM s""")
def window_stability(spark, sf_dir):
    out = rp.window_stability(table(spark, sf_dir, "events"), "value", "event_id", tolerance=5.0)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("median", "median_before", "iqr", "iqr_before")], "stable")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN -c_acctbal END AS x, CASE WHEN c_custkey % 2 = 0 THEN 'base' WHEN c_custkey % 3 = 0 THEN 'extra' ELSE 'missing' END AS origin FROM customer")
def effective_series(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    base = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("x"))
    return rp.effective(base, c.filter("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("x")), ["c_custkey"], "x")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def run_snapshot(spark, sf_dir):
    return rp.snapshot(table(spark, sf_dir, "events"), "event_type")


@query("""WITH m AS (SELECT event_type, avg(value) AS s FROM events GROUP BY 1), p AS (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 4 = 0) - 3 AS reused FROM events GROUP BY 1)
SELECT event_type, n, reused, round(s, 6) AS mean_seconds, round(n * s, 4) AS projected, round(greatest(0, reused * s), 4) AS saved FROM p JOIN m USING (event_type)""")
def cost_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    planned = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("event_id") % 4 == 0) - 3).alias("reused"))
    out = rp.projected_cost(e, planned, "event_type", "value")
    return out.select("event_type", "n", "reused", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("projected", 4).alias("projected"), F.round("saved", 4).alias("saved"))


@query(CANDIDATE_SQL + ", q1 AS (SELECT hash FROM c WHERE k % 2 = 0 ORDER BY hash LIMIT 20), q2 AS (SELECT hash FROM c WHERE train_ratio > 1 ORDER BY hash LIMIT 30) SELECT hash, CASE WHEN hash IN (SELECT hash FROM q1) THEN 'even' ELSE 'strong' END AS stratum FROM (SELECT hash FROM q1 UNION SELECT hash FROM q2)")
def quota_sample(spark, sf_dir):
    return sl.quota_sample(_candidates(spark, sf_dir), [("even", F.col("k") % 2 == 0, 20), ("strong", F.col("train_ratio") > 1, 30)], ["hash"])


_QUOTAS = {"small": 6, "middle": 5, "series": 4, "section": 4, "both": 3, "complex": 5, "origins": 7, "fill": 0}
_STRUCTURE = {"small": "nodes <= 3", "middle": "nodes > 3 AND nodes <= 6", "series": "s AND NOT c", "section": "c AND NOT s", "both": "s AND c", "complex": "nodes > 6", "origins": "origins > 1", "fill": "true"}


@query("WITH c AS (SELECT md5(p_partkey::VARCHAR) AS hash, p_size % 9 + 1 AS nodes, p_partkey % 2 = 0 AS s, p_partkey % 3 = 0 AS c, p_partkey % 4 + 1 AS origins FROM part), "
    + ", ".join(f"q{k} AS (SELECT hash, {k} AS k, '{n}' AS stratum FROM c WHERE {_STRUCTURE[n]} ORDER BY hash LIMIT {q or 40})" for k, (n, q) in enumerate(_QUOTAS.items()))
    + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(8)) + "), f AS (SELECT hash, min(k) AS k, arg_min(stratum, k) AS stratum FROM u GROUP BY hash) SELECT hash, stratum FROM f ORDER BY k, hash LIMIT 40")
def structure_sample(spark, sf_dir):
    k = F.col("p_partkey")
    origins = F.sequence(F.lit(0).cast("long"), k % 4)
    c = table(spark, sf_dir, "part").select(F.md5(k.cast("string").cast("binary")).alias("hash"), (F.col("p_size") % 9 + 1).alias("nodes"), (k % 2 == 0).alias("series"), (k % 3 == 0).alias("section"), origins.alias("origins"))
    return sl.quota_sample(c, sl.structure_strata(_QUOTAS | {"fill": 40}), ["hash"], total=40)


@query("WITH o AS (SELECT md5(p_partkey::VARCHAR) AS hash, p_brand AS stratum, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR)) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT hash, stratum, i::INT AS place FROM o, range(7) AS g(i) WHERE r = floor(i * (n - 1) / 6.0::DOUBLE)")
def spread_strata(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("hash"), F.col("p_brand").alias("stratum"))
    return sl.spread_sample(c, 7, ["hash"], ("stratum",)).select("hash", "stratum", "place")


@query(CANDIDATE_SQL + ", o AS (SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS r, count(*) OVER () AS n FROM c) SELECT hash, i::INT AS place FROM o, range(25) AS g(i) WHERE r = floor(i * (n - 1) / 24.0::DOUBLE)")
def spread_sample(spark, sf_dir):
    return sl.spread_sample(_candidates(spark, sf_dir).select("hash"), 25, ["hash"]).select("hash", "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice / l_quantity * l_quantity - l_extendedprice) <= 1e-6::DOUBLE AS same FROM lineitem")
def tolerant_equality(spark, sf_dir):
    a = F.col("l_extendedprice") / F.col("l_quantity") * F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", sl.close_enough(a, F.col("l_extendedprice")).alias("same"))


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')}, {legs_sql('fp', 'f4', 'label', 'm')} SELECT count(*) AS n, round(corr(l.excess, m.excess), 6) AS correlation FROM l JOIN m USING (t)")
def excess_correlation(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    a, b = (ev.portfolios(p, k, "label").select("t", F.col("excess").alias(k)) for k in ("f1", "f4"))
    return a.join(b, "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("f1", "f4"), 6).alias("correlation"))
