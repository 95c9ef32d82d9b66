"""Queries over audits, calendars, further reports, and the wide and sparse panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from ..operators import evaluate as ev
from ..operators import report as rp
from ..operators import select as sl
from ..plans.compiler import evaluate
from ..plans.grammar import Grammar
from ..sources.panel import densify, table
from .evaluation import FACTOR_SQL, factor_panel, legs_sql
from .selection import ENUMERATION_SQL, SERIES_SQL, _series

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(ENUMERATION_SQL + """SELECT hash, 'accept' AS verdict, NULL::VARCHAR AS reason, formula FROM x
UNION ALL SELECT repeat('0', 64), 'review', 'its hash differs', 'open'
UNION ALL SELECT repeat('1', 64), 'reject', 'an operand is missing', NULL
UNION ALL SELECT repeat('2', 64), 'reject', '1 tokens are left over', NULL
UNION ALL SELECT repeat('3', 64), 'reject', 'unknown token ' || chr(39) || 'nope' || chr(39), NULL
UNION ALL SELECT repeat('4', 64), 'reject', 'an operand is missing', NULL
UNION ALL SELECT repeat('5', 64), 'reject', 'beyond the limits of size', repeat('neg(', 20) || 'open' || repeat(')', 20)""")
def compatibility_audit(spark, sf_dir):
    good = [(n.hash(), n.prefix()) for nodes in (1, 2) for n in Grammar().enumerate(nodes)]
    rows = [*good, ("0" * 64, ["open"]), ("1" * 64, ["add", "open"]), ("2" * 64, ["close", "open"]), ("3" * 64, ["nope"]), ("4" * 64, None), ("5" * 64, ["neg"] * 20 + ["open"])]
    return audit.compatibility(spark.createDataFrame(rows, "hash string, tokens array<string>"))


@query(FACTOR_SQL + ", n AS (SELECT t, count(*) FILTER (f1 IS NOT NULL AND f4 IS NOT NULL AND label IS NOT NULL AND universe) AS n FROM fp GROUP BY t), b AS (SELECT min(t) AS f FROM n WHERE n >= 20) SELECT t, n, n >= 20 AS included FROM n, b WHERE t >= f AND (t - f) % 5 = 0")
def global_calendar(spark, sf_dir):
    p = factor_panel(spark, sf_dir).withColumn("u", F.when(F.col("universe"), 1))
    return audit.global_calendar(p, ["f1", "f4", "label", "u"])


@query(FACTOR_SQL + "SELECT t, stock, CASE WHEN industry IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY t, industry IS NULL ORDER BY industry) - 1 END::INT AS code FROM fp")
def industry_encoding(spark, sf_dir):
    return audit.industry_codes(factor_panel(spark, sf_dir)).select("t", "stock", "code")


@query(FACTOR_SQL + "SELECT t, count(f1) AS scored, count(*) FILTER (f1 IS NOT NULL AND label IS NOT NULL AND stock <> 'Brand#11') AS labelled, round(count(*) FILTER (f1 IS NOT NULL AND label IS NOT NULL AND stock <> 'Brand#11') / nullif(count(f1), 0)::DOUBLE, 6) AS share, CASE WHEN count(f1) < 20 THEN 'too few scores' WHEN count(*) FILTER (f1 IS NOT NULL AND label IS NOT NULL AND stock <> 'Brand#11') < count(f1) THEN 'labels are missing' END AS reason FROM fp GROUP BY t")
def coverage_by_date(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    labels = p.filter("stock <> 'Brand#11'").select("t", "stock", "label")
    return audit.coverage_by_date(p.select("t", "stock", F.col("f1").alias("score")), labels).withColumn("share", F.round("share", 6))


@query("SELECT o_orderpriority AS condition, " + ", ".join(f"round(quantile_cont(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", count(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END) AS valid, count(*) AS attempts FROM orders GROUP BY 1")
def calibration_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("condition"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("x"))
    return rp.calibration(o, "x", "condition").select("condition", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90)], "valid", "attempts")


@query(FACTOR_SQL + f", {legs_sql('fp', 'f1', 'label', 'l')}, {legs_sql('fp', 'f4', 'label', 'm')}, u AS (SELECT 'f1' AS style, long_short / 10000 AS x FROM l UNION ALL SELECT 'f4', long_short / 10000 FROM m) SELECT style, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std, round(avg(x) / stddev_samp(x) * sqrt(50.4::DOUBLE), 5) AS ratio, round(exp(sum(ln(1 + x))) - 1, 5) AS total, count(x) >= 60 AND stddev_samp(x) > 0 AS usable FROM u GROUP BY style")
def style_diagnostics(spark, sf_dir):
    p, out = factor_panel(spark, sf_dir), None
    for k in ("f1", "f4"):
        one = ev.portfolios(p, k, "label").select(F.lit(k).alias("style"), (F.col("long_short") / 10000).alias("x"))
        out = one if out is None else out.unionAll(one)
    out = rp.series_diagnostics(out, "x", ("style",), ev.PERIODS)
    return out.select("style", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), F.round("ratio", 5).alias("ratio"), F.round("total", 5).alias("total"), "usable")


@query(SERIES_SQL + ", bo AS (SELECT a, b, c FROM pc UNION ALL SELECT b, a, c FROM pc UNION ALL SELECT x, x, 1 FROM range(1, 7) AS r(x)) SELECT a::INT AS a, " + ", ".join(f"round(max(c) FILTER (b = {k}), 6) AS \"{k}\"" for k in range(1, 7)) + " FROM bo GROUP BY a")
def excess_correlation_matrix(spark, sf_dir):
    out = rp.correlation_matrix(sl.pair_correlations(*_series(spark, sf_dir)), list(range(1, 7)))
    return out.select("a", *[F.round(F.col(f"`{k}`"), 6).alias(str(k)) for k in range(1, 7)])


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def identity_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    out = rp.identified(lines, table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    return out.select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")


def _supplier_months(spark, sf_dir):
    """Monthly sums by supplier: a wide cross-section, as many names as suppliers."""
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.date_trunc("month", "l_shipdate").cast("date"))
    facts = lines.groupBy("date", F.col("l_suppkey").alias("stock")).agg(F.round(F.sum("l_extendedprice"), 2).alias("close"), F.sum("l_quantity").alias("volume"))
    return densify(facts, lines.select("date").distinct(), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stock")))


WIDE_SQL = """WITH f AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey AS stock, round(sum(l_extendedprice), 2) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM f)),
p AS (SELECT d.t, s_suppkey AS stock, close, volume FROM supplier CROSS JOIN d LEFT JOIN f ON f.date = d.date AND f.stock = s_suppkey)"""


@query(WIDE_SQL + ", r AS (SELECT t, stock, volume, (rank() OVER (PARTITION BY t, volume IS NULL ORDER BY volume) - 1 + (count(*) OVER (PARTITION BY t, volume) - 1) / 2.0::DOUBLE + 0.5::DOUBLE) / count(volume) OVER (PARTITION BY t) AS c, CASE WHEN count(close) OVER w = 5 THEN avg(close) OVER w END AS m FROM p WINDOW w AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT t, stock, round(CASE WHEN volume IS NOT NULL THEN c END, 6) AS rank, round(m, 4) AS mean FROM r")
def wide_panel(spark, sf_dir):
    out = evaluate(_supplier_months(spark, sf_dir), {"rank": "cs_rank(volume)", "mean": "ts_mean(close, 5)"})
    return out.select("t", "stock", F.round("rank", 6).alias("rank"), F.round("mean", 4).alias("mean"))


def _user_days(spark, sf_dir):
    """Daily sums of events by user: a sparse panel."""
    e = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    facts = e.groupBy("date", F.col("user_id").alias("stock")).agg(F.round(F.sum("value"), 4).alias("close"))
    return densify(facts, e.select("date").distinct(), e.select(F.col("user_id").alias("stock")).distinct())


@query("""WITH f AS (SELECT ts::DATE AS date, user_id AS stock, round(sum(value), 4) AS close FROM events GROUP BY ALL), d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM f)),
p AS (SELECT d.t, u.stock, close FROM (SELECT DISTINCT user_id AS stock FROM events) u CROSS JOIN d LEFT JOIN f ON f.date = d.date AND f.stock = u.stock)
SELECT t, stock, CASE WHEN count(close) OVER w = 5 THEN ((5 - list_position(list_reverse(list(close) OVER w), max(close) OVER w)))::DOUBLE END AS top, close - lag(close, 5) OVER (PARTITION BY stock ORDER BY t) IS NOT NULL AS has_delta FROM p WINDOW w AS (PARTITION BY stock ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def sparse_panel(spark, sf_dir):
    out = evaluate(_user_days(spark, sf_dir), {"top": "ts_argmax(close, 5)", "delta": "ts_delta(close, 5)"})
    return out.select("t", "stock", "top", F.col("delta").isNotNull().alias("has_delta"))


@query("SELECT o_orderstatus AS condition, metric, count(*) AS n, round(avg(x), 4) AS mean, round(max(x), 4) AS most FROM (SELECT o_orderstatus, 'price' AS metric, o_totalprice AS x FROM orders UNION ALL SELECT o_orderstatus, 'age', date_diff('day', o_orderdate, TIMESTAMP '2005-01-01')::DOUBLE FROM orders) GROUP BY ALL")
def training_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("condition"), F.col("o_totalprice").alias("price"), F.datediff(F.lit("2005-01-01").cast("date"), "o_orderdate").alias("age"))
    long = ev.long_form(o, ["price", "age"], ("condition",), "metric")
    return long.groupBy("condition", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.max("x"), 4).alias("most"))
