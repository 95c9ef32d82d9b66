"""Queries over the ingestion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etl
from ..sources.panel import PANEL_SQL, table, weekly_brands
from ..streaming.monitor import bars
from .operators52 import _round

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bars(spark, sf_dir):
    """Observed weekly bars, some broken on purpose."""
    p = weekly_brands(spark, sf_dir).filter("close is not null")
    p = p.withColumn("high", F.when(F.col("t") % 13 == 0, F.col("high") * 0.5).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("t") % 17 == 0, 0.0).otherwise(F.col("volume")))
    factor = etl.adjustment_factor(F.col("close"), F.col("close_raw"))
    return p.withColumn("factor", factor).withColumn("vwap", etl.vwap(F.col("amount"), F.lit(1.0), F.col("volume")))


BARS_SQL = f"""WITH {PANEL_SQL},
b AS (SELECT date, t, stock, industry, open, CASE WHEN t % 13 = 0 THEN high * 0.5::DOUBLE ELSE high END AS high, low, close, CASE WHEN t % 17 = 0 THEN 0.0::DOUBLE ELSE volume END AS volume, amount, close_raw FROM panel WHERE close IS NOT NULL),
c AS (SELECT *, CASE WHEN volume > 0 THEN amount / volume END AS vwap, CASE WHEN close > 0 AND close_raw > 0 THEN close / close_raw END AS factor FROM b),
d AS (SELECT *, CASE WHEN vwap IS NOT NULL THEN greatest(open, high, low, close, vwap) * 1e-6::DOUBLE + 1e-12::DOUBLE END AS tol FROM c),
v AS (SELECT *, vwap IS NOT NULL AS all_finite, coalesce(least(open, high, low, close, vwap, volume) > 0 AND vwap IS NOT NULL, false) AS all_positive,
             coalesce(high + tol >= greatest(open, close, low), false) AS high_ok, coalesce(low - tol <= least(open, close, high), false) AS low_ok,
             coalesce(vwap BETWEEN low - tol AND high + tol, false) AS vwap_ok FROM d),
f AS (SELECT *, all_finite AND all_positive AND high_ok AND low_ok AND vwap_ok AS valid FROM v)
"""


@query(BARS_SQL + "SELECT date, stock, all_finite, all_positive, high_ok, low_ok, vwap_ok, valid, round(CASE WHEN valid THEN close END, 6) AS close, round(CASE WHEN valid THEN vwap END, 6) AS vwap, round(factor, 6) AS factor FROM f")
def etl_daily_clean(spark, sf_dir):
    out = etl.validity(_bars(spark, sf_dir))
    return out.select("date", "stock", "all_finite", "all_positive", "high_ok", "low_ok", "vwap_ok", "valid", *[F.round(c, 6).alias(c) for c in ("close", "vwap", "factor")])


def _master(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.when(k % 11 == 0, None).when(k % 5 == 0, F.concat(F.lit("*ST"), F.lit(" "), "s_name")).when(k % 7 == 0, F.lit("STAR")).when(k % 13 == 0, F.concat(F.lit("s*st#"), "s_name")).otherwise(F.col("s_name"))
    listed = F.when(k % 17 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (k % 1000).cast("int")))
    return table(spark, sf_dir, "supplier").filter(k % 19 != 0).select(k.alias("stock"), name.alias("name"), listed.alias("list_date"))


MASTER_SQL = """WITH m AS (SELECT s_suppkey AS stock, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '*ST ' || s_name WHEN s_suppkey % 7 = 0 THEN 'STAR' WHEN s_suppkey % 13 = 0 THEN 's*st#' || s_name ELSE s_name END AS name,
                      CASE WHEN s_suppkey % 17 <> 0 THEN DATE '1995-01-01' + (s_suppkey % 1000)::INT END AS list_date FROM supplier WHERE s_suppkey % 19 <> 0),
k AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey AS stock FROM lineitem),
j AS (SELECT k.date, k.stock, m.stock IS NOT NULL AS recorded, coalesce(length(trim(name)) > 0, false) AS name_known, list_date IS NOT NULL AS date_known,
             coalesce(regexp_matches(trim(name), '(?i)^(\\*?ST|S\\*?ST)([^A-Z0-9]|$)'), false) AS special, coalesce(k.date - list_date >= 180, false) AS seasoned FROM k LEFT JOIN m ON m.stock = k.stock),
e AS (SELECT *, recorded AND name_known AND date_known AND NOT special AND seasoned AS eligible FROM j)
""".replace("\\\\", "\\")


def _supplier_months(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("stock")).distinct()


@query(MASTER_SQL + "SELECT date, stock, recorded, name_known, date_known, special, seasoned, eligible FROM e")
def etl_universe(spark, sf_dir):
    return etl.eligibility(_supplier_months(spark, sf_dir), _master(spark, sf_dir)).select("date", "stock", "recorded", "name_known", "date_known", "special", "seasoned", "eligible")


@query(MASTER_SQL + ", v AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, l_suppkey AS stock, max(l_quantity) > 30 AS valid FROM lineitem GROUP BY ALL) SELECT date, stock, valid AND eligible AS universe FROM e JOIN v USING (date, stock)")
def join_full_masks(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("stock")).agg((F.max("l_quantity") > 30).alias("valid"))
    return etl.combine_masks(a, etl.eligibility(_supplier_months(spark, sf_dir), _master(spark, sf_dir)))


@query("SELECT s_suppkey, lpad(regexp_replace(trim('  ' || s_suppkey::VARCHAR || '.0 '), '\\.0$', ''), 6, '0') AS code FROM supplier")
def etl_code_normalise(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", etl.normalise_code(F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit(".0 "))).alias("code"))


def _industry_rows(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.concat(F.lpad(k.cast("string"), 6, "0"), F.when(k % 3 == 0, ".SH").when(k % 3 == 1, ".SZ").otherwise(".XX"))
    sector = lambda n: F.concat(F.lpad((F.col("p_size") * n).cast("string"), 6, "0"), F.when(k % 10 == 0, ".SX").otherwise(".SI"))
    day = F.when(k % 23 == 0, F.lit("2020-02-30")).otherwise("2020-02-03")
    return table(spark, sf_dir, "part").select(day.alias("TradingDay"), code.alias("StockCode"), F.when(k % 4 == 0, "  ").otherwise(F.col("p_name")).alias("StockName"), *[c for n in (1, 2, 3) for c in (sector(n).alias(f"SWCode{n}"), F.col("p_type").alias(f"SWName{n}"))], F.when(k % 29 == 0, "swind_20200204.csv").otherwise("swind_20200203.csv").alias("file"))


@query("""WITH r AS (SELECT p_partkey AS k, p_name, p_type, p_size FROM part),
s AS (SELECT CASE WHEN k % 23 = 0 THEN NULL ELSE DATE '2020-02-03' END AS trade_date, CASE WHEN k % 3 < 2 THEN lpad(k::VARCHAR, 6, '0') END AS stock_code, CASE WHEN k % 4 = 0 THEN NULL ELSE nullif(trim(p_name), '') END AS stock_name,
 CASE WHEN k % 10 <> 0 THEN lpad(p_size::VARCHAR, 6, '0') END AS sw_code_1, CASE WHEN k % 10 <> 0 THEN lpad((p_size * 3)::VARCHAR, 6, '0') END AS sw_code_3, CASE WHEN k % 29 = 0 THEN DATE '2020-02-04' ELSE DATE '2020-02-03' END AS file_date FROM r)
SELECT trade_date, stock_code, stock_name, sw_code_1, sw_code_3, trade_date IS DISTINCT FROM file_date AS date_differs,
 trade_date IS NOT NULL AND stock_code IS NOT NULL AND sw_code_1 IS NOT NULL AND trade_date IS NOT DISTINCT FROM file_date AS ok FROM s""")
def etl_industry_parse(spark, sf_dir):
    return etl.parse_industry(_industry_rows(spark, sf_dir)).select("trade_date", "stock_code", "stock_name", "sw_code_1", "sw_code_3", "date_differs", "ok")


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN s_name ELSE NULL END AS label FROM supplier")
def etl_known_label(spark, sf_dir):
    k = F.col("s_suppkey") % 5
    raw = F.when(k == 0, " ").when(k == 1, "NaN").when(k == 2, "<NA>").when(k == 3, F.col("s_name")).otherwise("-1")
    return table(spark, sf_dir, "supplier").select("s_suppkey", etl.known_label(raw).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def date_range(spark, sf_dir):
    """The date range predicate, ends included; it reaches the scan."""
    first, last = (F.lit(d).cast("timestamp") for d in ("1996-01-01", "1996-06-30"))
    return table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate").between(first, last)).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_inner(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_totalprice")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def join_left_checked(spark, sf_dir):
    some = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return etl.left_checked(table(spark, sf_dir, "orders"), some, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_totalprice) AS price FROM orders GROUP BY ALL),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, o.o_custkey AS k, l_shipdate - INTERVAL 60 DAY AS at FROM lineitem JOIN orders o ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, s.price FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.at >= s.at""")
def asof_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    steps = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))
    probe = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_custkey").alias("k"), F.expr("l_shipdate - interval 60 days").alias("at"))
    return etl.as_of(probe, steps, "k", "at", ["price"]).select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_totalprice) AS price FROM orders GROUP BY ALL),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, o.o_custkey AS k, l_shipdate - INTERVAL 60 DAY AS at FROM lineitem JOIN orders o ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, s.price FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.at >= s.at""")
def asof_join_in_parts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    steps = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))
    probe = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_custkey").alias("k"), F.expr("l_shipdate - interval 60 days").alias("at"))
    return etl.as_of(probe, steps, "k", "at", ["price"], F.date_trunc("year", "at")).select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("""WITH s AS (SELECT s_suppkey AS stock, DATE '1995-06-01' + (365 * i)::INT AS date, (s_suppkey * 100 + i * 7)::DOUBLE AS shares FROM supplier, range(4) r(i) WHERE s_suppkey % 5 <> i),
b AS (SELECT l_suppkey AS stock, date_trunc('month', l_shipdate)::DATE AS date, round(max(l_extendedprice), 2) AS close_raw FROM lineitem GROUP BY ALL)
SELECT b.stock, b.date, shares, round(close_raw * shares, 2) AS cap FROM b ASOF LEFT JOIN s ON b.stock = s.stock AND b.date >= s.date""")
def market_caps(spark, sf_dir):
    years = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stock"), years).filter("stock % 5 <> i")
    s = s.select("stock", F.expr("date_add(date'1995-06-01', 365 * i)").alias("date"), (F.col("stock") * 100 + F.col("i") * 7).cast("double").alias("shares"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stock"), F.date_trunc("month", "l_shipdate").cast("date").alias("date")).agg(F.round(F.max("l_extendedprice"), 2).alias("close_raw"))
    return etl.market_caps(b, s, F.year("date")).select("stock", "date", "shares", F.round("cap", 2).alias("cap"))


_PROVIDER_SQL = r"""WITH r AS (SELECT ' ' || (l_partkey % 500)::VARCHAR || '.0' AS code, CASE WHEN l_orderkey % 31 = 0 THEN '1996-13-01' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day, CASE WHEN l_linenumber = 5 THEN 'n/a' ELSE l_quantity::VARCHAR END AS volume, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS tie FROM lineitem),
u AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY seq) = 1),
t AS (SELECT lpad(regexp_replace(trim(code), '\.0$', ''), 6, '0') AS stock, try_strptime(day, '%Y-%m-%d')::DATE AS date, try_cast(volume AS DOUBLE) AS volume, seq FROM u),
k AS (SELECT * FROM t WHERE date IS NOT NULL)
"""


def _provider(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    once = lines.groupBy(seq.alias("seq")).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("l_partkey", "l_orderkey", "l_shipdate", "l_linenumber", "l_quantity")]).filter("n = 1")
    raw = once.select(F.concat(F.lit(" "), (F.col("l_partkey") % 500).cast("string"), F.lit(".0")).alias("code"), F.when(F.col("l_orderkey") % 31 == 0, "1996-13-01").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"), F.when(F.col("l_linenumber") == 5, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("volume"), "seq")
    return etl.provider_rows(raw, "code", "day", ["volume"])


@query(_PROVIDER_SQL + "SELECT stock, date, volume, seq FROM k QUALIFY row_number() OVER (PARTITION BY stock, date ORDER BY seq DESC) = 1")
def provider_rows(spark, sf_dir):
    return _provider(spark, sf_dir)[0].select("stock", "date", "volume", "seq")


@query(_PROVIDER_SQL + "SELECT stock, date, count(DISTINCT row(volume)) AS versions FROM k GROUP BY ALL HAVING count(DISTINCT row(volume)) > 1")
def provider_conflicts(spark, sf_dir):
    return _provider(spark, sf_dir)[1]


@query("WITH k AS (SELECT DISTINCT l_shipdate::DATE AS date, l_suppkey AS stock FROM lineitem), i AS (SELECT DISTINCT o_orderdate::DATE AS date, o_custkey AS stock FROM orders) SELECT k.date, k.stock, CASE WHEN i.stock IS NOT NULL THEN 'sector' || (k.stock % 7)::VARCHAR END AS sector FROM k LEFT JOIN i ON i.date = k.date AND i.stock = k.stock")
def keys_with_industry(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("stock")).distinct()
    known = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_custkey").alias("stock_code")).distinct()
    return etl.with_industry(keys, known.withColumn("sector", F.concat(F.lit("sector"), (F.col("stock_code") % 7).cast("string"))), ["sector"])


@query("SELECT p_partkey, p_type LIKE '%BRASS' AS brass, p_type LIKE '%steel' AS steel FROM part")
def suffix_test(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").endswith("BRASS").alias("brass"), F.col("p_type").endswith("steel").alias("steel"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_anti_below(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti_pending(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi_subset(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem EXCEPT SELECT ts::DATE FROM events EXCEPT SELECT o_orderdate::DATE FROM orders WHERE o_orderkey % 50 = 0")
def except_dates(spark, sf_dir):
    d = lambda name, c: table(spark, sf_dir, name).select(F.col(c).cast("date").alias("date"))
    some = table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderdate").cast("date").alias("date"))
    return d("lineitem", "l_shipdate").distinct().join(d("events", "ts").unionAll(some), "date", "left_anti")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_one(spark, sf_dir):
    return etl.keep_one(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT row(l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY ALL HAVING count(DISTINCT row(l_returnflag, l_linestatus)) > 1")
def conflict_detect(spark, sf_dir):
    return etl.conflicts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderstatus AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def union_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    parts = [o.filter(F.col("o_orderkey") % 3 == k) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("o_orderstatus").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH k AS (SELECT l_suppkey, l_shipdate::DATE AS date, l_quantity AS q, CASE WHEN l_quantity > 10 THEN l_tax END AS x FROM lineitem)
SELECT count(*)::BIGINT AS rows, count(DISTINCT l_suppkey) AS entities, min(date) AS first_date, max(date) AS last_date, (count(*) - count(DISTINCT row(l_suppkey, date)))::BIGINT AS surplus_rows, sum((q IS NULL)::INT)::BIGINT AS missing_q, sum((x IS NULL)::INT)::BIGINT AS missing_x FROM k""")
def source_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("q"), F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("x"))
    return etl.summary(rows, ["l_suppkey", "date"], "date", ["q", "x"])


_r = lambda num, den, ok="true": f"CASE WHEN {ok} AND {den} > 0 THEN {num} / {den} END"
_geo = "open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND high >= low"
FEATURE_SQL = {
    "ret_gap": f"{_r('open', 'c1')} - 1", "ret_cc1": f"{_r('close', 'c1')} - 1", "ret_co": f"{_r('close', 'open')} - 1", "ret_hl": f"{_r('high', 'low')} - 1",
    "ret_range": _r("(high - low)", "c1", _geo), "ret_body": _r("abs(close - open)", "c1", _geo), "ret_upper_shadow": _r("(high - greatest(open, close))", "c1", _geo), "ret_lower_shadow": _r("(least(open, close) - low)", "c1", _geo),
    "ret_close_vwap": f"{_r('close', 'vwap')} - 1", "ret_open_vwap": f"{_r('open', 'vwap')} - 1", "ret_vol_chg1": f"{_r('volume', 'v1')} - 1", "ret_vol_chg5": f"{_r('volume', 'v5')} - 1",
    "turnover": _r("volume", "shares"), "illiq": f"1e8::DOUBLE * abs({_r('close', 'c1')} - 1) / amount", "ret_amt_chg5": f"{_r('amount', 'a5')} - 1", "clv": _r("(2 * close - high - low)", "(high - low)", _geo),
}
DERIVED_SQL = f"WITH {PANEL_SQL}, l AS (SELECT *, lag(close) OVER w AS c1, lag(volume) OVER w AS v1, lag(volume, 5) OVER w AS v5, lag(amount, 5) OVER w AS a5 FROM panel WINDOW w AS (PARTITION BY stock ORDER BY t)), d AS (SELECT t, stock, " + ", ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items()) + " FROM l) "


@query(DERIVED_SQL + "SELECT t, stock, " + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in FEATURE_SQL) + " FROM d")
def derived_features(spark, sf_dir):
    out = etl.derived_features(weekly_brands(spark, sf_dir))
    return out.select("t", "stock", *[_round(F.col(k)).alias(k) for k in FEATURE_SQL])


@query(DERIVED_SQL + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {k} AS x FROM d" for k in FEATURE_SQL) + ") SELECT feature, count(x) AS n, round(count(x) / count(*)::DOUBLE, 6) AS share, round(min(x), 6) + 0.0 AS least, round(quantile_cont(x, 0.5), 6) + 0.0 AS median, round(max(x), 6) + 0.0 AS most FROM u GROUP BY feature")
def derived_qa(spark, sf_dir):
    out = etl.feature_qa(etl.derived_features(weekly_brands(spark, sf_dir)), FEATURE_SQL)
    return out.select("feature", "n", F.round("share", 6).alias("share"), *[_round(F.col(c)).alias(c) for c in ("least", "median", "most")])


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL")
def bars_from_events(spark, sf_dir):
    return bars(table(spark, sf_dir, "events"))
