"""Ingestion operators: normalisation, validity, masks, joins with checked cardinality, as-of join, dedup, derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import finite

ABS_TOL, REL_TOL = 1e-12, 1e-6
LEAST_AGE_DAYS = 180
# fixed values: patterns of special names, entity codes and sector codes, and texts that stand for an unknown label
SPECIAL_NAME = r"^(?i)(?:\*?ST|S\*?ST)(?=[^A-Z0-9]|$)"
ENTITY_CODE, SECTOR_CODE = r"^[0-9]{6}\.(SH|SZ|BJ)$", r"^[0-9]{6}\.SI$"
UNKNOWN_LABELS = ("", "nan", "none", "<na>")


class IntegrityError(ValueError):
    """A join or a table breaks its key contract."""


def normalise_code(c: Column) -> Column:
    return F.lpad(F.regexp_replace(F.trim(c), r"\.0$", ""), 6, "0")


def adjustment_factor(close: Column, raw: Column) -> Column:
    ok = (finite(close) > 0) & (finite(raw) > 0)
    return F.when(ok, F.try_divide(close, raw))


def vwap(amount: Column, factor: Column, volume: Column) -> Column:
    return finite(F.when(volume > 0, F.try_divide(amount * factor, volume)))


def tolerance(*prices: Column) -> Column:
    """Price slack; missing if any price is."""
    known = prices[0].isNotNull()
    for p in prices[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.greatest(*[F.abs(p) for p in prices]) * REL_TOL + ABS_TOL)


FEATURES = ("open", "high", "low", "close", "vwap", "volume")


def validity(bars: DataFrame) -> DataFrame:
    """Adds a flag for each rule and `valid`, and nulls the six features of rows that break one; keys stay."""
    o, h, lo, c, w, v = (finite(F.col(x)) for x in FEATURES)
    tol = tolerance(o, h, lo, c, w)
    known = lambda x: F.coalesce(x, F.lit(False))
    present = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & w.isNotNull() & v.isNotNull()
    flags = {
        "all_finite": present,
        "all_positive": known((o > 0) & (h > 0) & (lo > 0) & (c > 0) & (w > 0) & (v > 0)),
        "high_ok": known(h + tol >= F.greatest(o, c, lo)),
        "low_ok": known(lo - tol <= F.least(o, c, h)),
        "vwap_ok": known((w >= lo - tol) & (w <= h + tol)),
    }
    out = bars.withColumns(flags).withColumn("valid", F.col("all_finite") & F.col("all_positive") & F.col("high_ok") & F.col("low_ok") & F.col("vwap_ok"))
    return out.withColumns({x: F.when(F.col("valid"), F.col(x)) for x in FEATURES})


def is_special_name(name: Column) -> Column:
    return F.trim(name).rlike(SPECIAL_NAME)


def eligibility(keys: DataFrame, master: DataFrame) -> DataFrame:
    """keys: date, stock; master: stock, name, list_date, a row for each stock. Adds the reasons and `eligible`."""
    if master.groupBy("stock").count().filter("count > 1").head(1):
        raise IntegrityError("a stock has several master rows")
    joined = keys.join(master.withColumn("recorded", F.lit(True)), "stock", "left")
    age = F.datediff("date", "list_date")
    out = joined.withColumns(
        {
            "recorded": F.coalesce("recorded", F.lit(False)),
            "name_known": F.coalesce(F.length(F.trim("name")) > 0, F.lit(False)),
            "date_known": F.col("list_date").isNotNull(),
            "special": F.coalesce(is_special_name(F.col("name")), F.lit(False)),
            "seasoned": F.coalesce(age >= LEAST_AGE_DAYS, F.lit(False)),
        }
    )
    return out.withColumn("eligible", F.col("recorded") & F.col("name_known") & F.col("date_known") & ~F.col("special") & F.col("seasoned"))


def combine_masks(a: DataFrame, b: DataFrame, keys=("date", "stock"), left: str = "valid", right: str = "eligible") -> DataFrame:
    """The keys of both must be the same; `universe` is both masks."""
    x = a.select(*keys, F.col(left).alias("_l"), F.lit(1).alias("_a"))
    y = b.select(*keys, F.col(right).alias("_r"), F.lit(1).alias("_b"))
    both = x.join(y, list(keys), "full")
    if both.filter("_a is null or _b is null").head(1):
        raise IntegrityError("the masks have different keys")
    return both.select(*keys, (F.col("_l") & F.col("_r")).alias("universe"))


def parse_industry(rows: DataFrame) -> DataFrame:
    """rows: TradingDay, StockCode, StockName and SWCode/SWName 1 to 3 as text, file (its name). Typed columns, and `ok`."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    day, from_file = F.try_to_date("TradingDay", "yyyy-MM-dd"), F.try_to_date(F.regexp_extract("file", r"(\d{8})\.csv$", 1), "yyyyMMdd")
    names = [c for n in (1, 2, 3) for c in ((f"SWCode{n}", f"sw_code_{n}"), (f"SWName{n}", f"sw_name_{n}"))]
    out = rows.select(
        day.alias("trade_date"),
        F.when(F.col("StockCode").rlike(ENTITY_CODE), F.left("StockCode", F.lit(6))).alias("stock_code"),
        blank(F.col("StockName")).alias("stock_name"),
        *[(F.when(F.col(a).rlike(SECTOR_CODE), F.left(a, F.lit(6))) if "Code" in a else blank(F.col(a))).alias(b) for a, b in names],
        (~day.eqNullSafe(from_file)).alias("date_differs"),
    )
    return out.withColumn("ok", F.col("trade_date").isNotNull() & F.col("stock_code").isNotNull() & F.col("sw_code_1").isNotNull() & ~F.col("date_differs"))


def known_label(c: Column) -> Column:
    """c as text where it names a group."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*UNKNOWN_LABELS) & ~text.startswith("-"), text)


def summary(df: DataFrame, keys: list[str], date: str, values: list[str]) -> DataFrame:
    """One row: rows, distinct entities, first and last date, surplus rows of keys, missing values of each column."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(v).isNull().cast("long")).alias(v) for v in values])
    entity = [k for k in keys if k != date][0]
    return per_key.agg(
        F.sum("_n").alias("rows"), F.count_distinct(entity).alias("entities"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.sum(F.col("_n") - 1).alias("surplus_rows"), *[F.sum(v).alias(f"missing_{v}") for v in values],
    )


def keep_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows disagree on a value."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("versions")).filter("versions > 1")


def left_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that may not multiply rows."""
    if right.groupBy(*keys).count().filter("count > 1").head(1):
        raise IntegrityError("the right side has several rows for a key")
    return left.join(right, keys, "left")


def as_of(probe: DataFrame, steps: DataFrame, key: str, time: str, values: list[str], part: Column | None = None) -> DataFrame:
    """The values of the latest step of the key at or before each probe; of steps of one time the last in value order.

    One union, one window over the key: no range join. part: an expression of the time that ascends with it, such as its month; then a
    window holds the rows of a key and part only, and what a part begins with comes from a window over the key's parts, so that a key
    with very many rows is split.
    """
    p = probe.select("*", F.lit(1).alias("_side"), *[F.lit(None).cast(steps.schema[v].dataType).alias(f"_{v}") for v in values])
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in probe.schema if f.name not in (key, time)]
    s = steps.select(key, time, *extra, F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    rows = p.unionByName(s)
    if part is None:
        w = Window.partitionBy(key).orderBy(time, "_side", *[f"_{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
        last = {v: F.last(f"_{v}", True).over(w) for v in values}
        return rows.withColumns(last).filter("_side = 1").drop("_side", *[f"_{v}" for v in values])
    step = F.struct(time, *[f"_{v}" for v in values])
    rows = rows.withColumn("_part", part)
    ends = rows.groupBy(key, "_part").agg(F.max(F.when(F.col("_side") == 0, step)).alias("_end"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the key
    ends = ends.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.last("_end", True).over(before).alias("_begin"))
    w = Window.partitionBy(key, "_part").orderBy(time, "_side", *[f"_{v}" for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_now", F.last(F.when(F.col("_side") == 0, step), True).over(w)).filter("_side = 1")
    out = inside.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")), "left")
    found = F.coalesce("_now", "_begin")
    return out.withColumns({v: found[f"_{v}"] for v in values}).drop("_side", "_part", "_key", "_of", "_begin", "_now", *[f"_{v}" for v in values])


def provider_rows(raw: DataFrame, code: str, date: str, numbers: list[str]) -> tuple[DataFrame, DataFrame]:
    """raw: text columns and seq, the order of arrival. Rows with a typed code, date and numbers, without those of a broken key, one for
    each key: the last to arrive. And the keys whose rows disagree."""
    typed = raw.select(normalise_code(F.col(code)).alias("stock"), F.try_to_date(F.trim(date), "yyyy-MM-dd").alias("date"), *[finite(F.expr(f"try_cast(trim({n}) as double)")).alias(n) for n in numbers], "seq")
    typed = typed.filter(F.col("stock").rlike("^[0-9]{6}$") & F.col("date").isNotNull())
    return keep_one(typed, ["stock", "date"], [F.desc("seq")]), conflicts(typed, ["stock", "date"], numbers)


def with_industry(keys: DataFrame, industry: DataFrame, values: list[str]) -> DataFrame:
    """keys: date, stock; industry: trade_date, stock_code, a row for each. All keys once, with the industry of the day, if it is known."""
    right = industry.select(F.col("trade_date").alias("date"), F.col("stock_code").alias("stock"), *values)
    return left_checked(keys, right, ["date", "stock"])


def market_caps(bars: DataFrame, shares: DataFrame, part: Column | None = None) -> DataFrame:
    """bars: stock, date, close_raw; shares: stock, date, shares, from that date on. Adds shares and cap, the raw close times the shares."""
    out = as_of(bars, shares, "stock", "date", ["shares"], part)
    return out.withColumn("cap", finite(F.when((F.col("close_raw") > 0) & (F.col("shares") > 0), F.col("close_raw") * F.col("shares"))))


def derived_features(panel: DataFrame, shares: str = "shares") -> DataFrame:
    """The 16 daily-derived features; lags are rows of the dense grid."""
    w = Window.partitionBy("stock").orderBy("t")
    o, h, lo, c, v, a, p = (finite(F.col(x)) for x in ("open", "high", "low", "close", "volume", "amount", "vwap"))
    lag = lambda x, n: F.lag(x, n).over(w)
    c1 = lag(c, 1)
    ratio = lambda x, y: finite(F.try_divide(x, F.when(y > 0, y)))
    geometry = (o > 0) & (h > 0) & (lo > 0) & (c > 0) & (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (h >= lo)
    shaped = lambda x: F.when(F.coalesce(geometry, F.lit(False)), x)
    raw_clv = shaped(ratio(c * 2 - h - lo, h - lo))
    cc = ratio(F.when(c > 0, c), c1) - 1
    out = {
        "ret_gap": ratio(F.when(o > 0, o), c1) - 1,
        "ret_cc1": cc,
        "ret_co": ratio(F.when(c > 0, c), o) - 1,
        "ret_hl": ratio(F.when(h > 0, h), lo) - 1,
        "ret_range": shaped(ratio(h - lo, c1)),
        "ret_body": shaped(ratio(F.abs(c - o), c1)),
        "ret_upper_shadow": shaped(ratio(h - F.greatest(o, c), c1)),
        "ret_lower_shadow": shaped(ratio(F.least(o, c) - lo, c1)),
        "ret_close_vwap": ratio(F.when(c > 0, c), p) - 1,
        "ret_open_vwap": ratio(F.when(o > 0, o), p) - 1,
        "ret_vol_chg1": ratio(v, lag(v, 1)) - 1,
        "ret_vol_chg5": ratio(v, lag(v, 5)) - 1,
        "turnover": ratio(v, finite(F.col(shares))),
        "illiq": ratio(F.abs(cc) * 1e8, a),
        "ret_amt_chg5": ratio(a, lag(a, 5)) - 1,
        "clv": F.when(F.abs(raw_clv) <= 1, raw_clv).when(F.abs(raw_clv) <= 1 + 1e-12, F.signum(raw_clv)),
    }
    return panel.withColumns(out)


def feature_qa(df: DataFrame, names) -> DataFrame:
    """A row for each feature: count, share, min, exact median, max of its present values."""
    long = df.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("feature", "x"))
    return long.groupBy("feature").agg(F.count("x").alias("n"), (F.count("x") / F.count(F.lit(1))).alias("share"), F.min("x").alias("least"), F.percentile("x", F.lit(0.5)).alias("median"), F.max("x").alias("most"))
