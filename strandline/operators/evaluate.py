"""Evaluation of a factor against forward returns: labels, cleaning, information coefficients, portfolios, styles, reward.

A panel has a row for each t and stock of a dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import Section
from ..functions.elementwise import EPS, finite
from ..functions.time_series import Series

LEAST_SAMPLE, TOP_SHARE, PERIODS = 20, 0.1, 50.4
#: Spread below which a sample counts as constant.
FLAT = 2.220446049250313e-16
STYLES = ("size", "beta", "momentum", "volatility", "liquidity")


def _series() -> Window:
    return Window.partitionBy("stock").orderBy("t")


def forward_return(price: str = "open", wait: int = 1, hold: int = 5) -> Column:
    """Return from the price `wait` rows on to that `hold` rows later."""
    a, b = (finite(F.lead(price, k).over(_series())) for k in (wait, wait + hold))
    return finite(F.try_divide(F.when(b > 0, b), F.when(a > 0, a)) - 1)


def daily_return(price: str = "close") -> Column:
    """Return from the row before, where both prices are above 0."""
    now, before = finite(F.col(price)), finite(F.lag(price).over(_series()))
    return finite(F.try_divide(F.when(now > 0, now), F.when(before > 0, before)) - 1)


def contained(label: Column, end: Column, reach: int = 6) -> Column:
    """The label where all it needs lies in the split that ends with row `end`."""
    return F.when(F.col("t") + reach <= end, label)


def clean_plain(df: DataFrame, x: str, universe: Column, out: str = "clean", low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Clipped at quantiles, then standardised, within the universe. by: the columns that name a cross-section."""
    s = Section(by)
    df = df.withColumn("_x", F.when(universe, finite(F.col(x))))
    df = df.withColumn("_w", s.clip(F.col("_x"), low, high))
    std, n = F.stddev_pop("_w").over(s.every), F.count("_w").over(s.every)
    z = F.try_divide(F.col("_w") - F.avg("_w").over(s.every), F.when(std > EPS, std))
    return df.withColumn(out, F.when(n >= 2, z)).drop("_x", "_w")


def neutral_parts(df: DataFrame, x: str, universe: Column, industry: str, low: float = 0.01, high: float = 0.99, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds _w (clipped over all valid values), and for each date the counts and why it is skipped (`skipped`, null if not)."""
    s = Section(by)
    df = df.withColumn("_x", F.when(universe, finite(F.col(x))))
    df = df.withColumn("_w", s.clip(F.col("_x"), low, high)).withColumn("_i", F.when(F.col("_w").isNotNull(), F.col(industry)))
    df = df.withColumns({"_n": F.count("_w").over(s.every), "_known": F.count("_i").over(s.every), "_groups": F.size(F.collect_set("_i").over(s.every))})
    return df.withColumn("skipped", F.when(F.col("_n") < 2, "too few values").when(F.col("_known") == 0, "no known industry").when(F.col("_known") < F.col("_groups") + 1, "too few names for the industries"))


def clean_candidate(df: DataFrame, x: str, universe: Column, industry: str = "industry", out: str = "clean", by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Clipped, less the industry mean, standardised over the names of known industry. by: the columns that name a cross-section."""
    s = Section(by)
    df = neutral_parts(df, x, universe, industry, by=by)
    r = F.col("_w") - F.avg("_w").over(Window.partitionBy(*by, "_i"))
    df = df.withColumn("_r", F.when(F.col("skipped").isNull() & F.col("_i").isNotNull(), F.when(F.abs(r) <= EPS, 0.0).otherwise(r)))
    std, n = F.stddev_pop("_r").over(s.every), F.count("_r").over(s.every)
    z = F.try_divide(F.col("_r") - F.avg("_r").over(s.every), F.when(std > EPS, std))
    return df.withColumn(out, F.when(n >= 2, z)).drop("_x", "_w", "_i", "_n", "_known", "_groups", "_r", "skipped")


def skipped_dates(df: DataFrame, x: str, universe: Column, industry: str = "industry") -> DataFrame:
    """A row for each date: valid and known names, industries, reason."""
    parts = neutral_parts(df, x, universe, industry)
    return parts.groupBy("t").agg(F.max("_n").alias("valid"), F.max("_known").alias("known"), F.max("_groups").cast("long").alias("industries"), F.max("skipped").alias("reason"))


def _ranked(rows: DataFrame, x: str, y: str, by: tuple[str, ...], least: int, n: Column, out: str) -> DataFrame:
    """by, n, out; rows may hold missing values, which have no rank."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = rows.select("*", ok.alias("_ok"), F.when(ok, F.col(x)).alias("_x"), F.when(ok, F.col(y)).alias("_y"))
    rank = lambda c: F.when(F.col("_ok"), F.rank().over(Window.partitionBy(*by, "_ok").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "_ok", c)) - 1) / 2)
    ranked = rows.withColumns({"_a": rank("_x"), "_b": rank("_y")})
    sa, sb = F.stddev_pop("_a"), F.stddev_pop("_b")
    c = F.when((F.count("_a") >= least) & (sa > EPS) & (sb > EPS), F.try_divide(F.covar_pop("_a", "_b"), sa * sb))
    return ranked.groupBy(*by).agg(n.alias("n"), c.alias(out))


def rank_correlation(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ("t",), least: int = LEAST_SAMPLE, out: str = "ic") -> DataFrame:
    """Spearman correlation with average ranks over rows where both are present: by, n, out."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_p"), F.col(y).alias("_q"))
    return _ranked(rows, "_p", "_q", by, least, F.count(F.lit(1)), out)


def rank_ic(df: DataFrame, raw: str, clean: str, label: str, universe: Column, by: tuple[str, ...] = ("t",), least: int = LEAST_SAMPLE) -> DataFrame:
    """by, n, ic: the rank correlation of the cleaned factor and the label, with at least `least` names that have both.

    n, the sample on which the calendar of rebalancing rests, counts names of the universe with a raw factor and a label, cleaned or not.
    """
    counted = universe & finite(F.col(raw)).isNotNull() & finite(F.col(label)).isNotNull()
    rows = df.select(*by, F.col(clean).alias("_p"), F.col(label).alias("_q"), counted.alias("_c"))
    return _ranked(rows, "_p", "_q", by, least, F.count_if("_c"), "ic")


def rebalance(dates: DataFrame, every: int = 5, least: int = LEAST_SAMPLE, offset: int = 0) -> DataFrame:
    """dates: t, n (sample). The rows from the first with a full sample on, each `every` rows."""
    first = F.min(F.when(F.col("n") >= least, F.col("t"))).over(Window.partitionBy())  # one row for each date
    return dates.withColumn("_f", first + offset).filter((F.col("t") >= F.col("_f")) & ((F.col("t") - F.col("_f")) % every == 0)).drop("_f")


def ic_summary(ic: DataFrame, x: str = "ic", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sample deviation, their ratio, valid and all periods, sign of the mean, and the share of valid periods above 0."""
    std = F.stddev_samp(x)
    g = ic.groupBy(*by) if by else ic.groupBy()
    positive = F.avg(F.when(F.col(x).isNotNull(), (F.col(x) > EPS).cast("double")))  # a zero may be off by rounding
    return g.agg(F.avg(x).alias("mean"), std.alias("std"), F.when(std > 0, F.try_divide(F.avg(x), std)).alias("icir"), F.count(x).alias("valid"), F.count(F.lit(1)).alias("total"), F.signum(F.avg(x)).alias("direction"), positive.alias("positive"))


def portfolios(df: DataFrame, score: str, ret: str, direction: float | Column = 1.0, least: int = LEAST_SAMPLE, share: float = TOP_SHARE, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """For each date (by): long leg in the direction, benchmark, excess, and long-short of the score itself.

    Ties: the last stock wins on top, the first at the bottom.
    """
    plain = not isinstance(direction, Column) and direction == 1.0
    rows = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(*by, "stock", F.col(score).alias("_s"), (F.col(score) * direction).alias("_d"), F.col(ret).alias("_r"))
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    last = lambda c: F.row_number().over(w.orderBy(F.desc(c), F.desc("stock")))
    rows = rows.withColumns({"_n": n, "_k": F.greatest(F.lit(1), F.ceil(n * share)), "_high": last("_s"), "_low": F.row_number().over(w.orderBy("_s", "stock"))})
    rows = rows.withColumn("_top", F.col("_high") if plain else last("_d"))
    pair = F.least(F.col("_k"), F.floor(F.col("_n") / 2))
    legs = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_top") <= F.col("_k"), F.col("_r"))).alias("long"), F.avg("_r").alias("benchmark"),
        (F.avg(F.when(F.col("_high") <= pair, F.col("_r"))) - F.avg(F.when(F.col("_low") <= pair, F.col("_r")))).alias("long_short"), (F.max("_s") - F.min("_s")).alias("_range"),
    )
    return legs.filter((F.col("n") >= least) & (F.col("_range") > FLAT)).select(*by, "n", "long", "benchmark", (F.col("long") - F.col("benchmark")).alias("excess"), "long_short")


def return_summary(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, annualised mean and ratio to the sample deviation of a return series."""
    std = F.stddev_samp(x)
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.avg(x) * PERIODS).alias("annual"), F.when(std > 0, F.try_divide(F.avg(x), std) * PERIODS**0.5).alias("ratio"))


def market_return(df: DataFrame, ret: str = "ret", cap: str = "cap", universe: str = "universe") -> DataFrame:
    """Mean return by date, weighted by the capital of the row before; names that are in the universe on both rows."""
    w = _series()
    rows = df.withColumns({"_w": F.lag(cap).over(w), "_u": F.lag(universe).over(w)}).filter(F.col(universe) & F.col("_u") & (F.col("_w") > 0) & F.col(ret).isNotNull())
    return rows.groupBy("t").agg(F.try_divide(F.sum(F.col("_w") * F.col(ret)), F.sum("_w")).alias("market"))


def with_market(df: DataFrame, ret: str = "ret", cap: str = "cap", universe: str = "universe") -> DataFrame:
    """Adds market, market_return() of the row's date, without a join."""
    w, day = _series(), Window.partitionBy("t")
    df = df.withColumns({"_w": F.lag(cap).over(w), "_u": F.lag(universe).over(w)})
    ok = F.col(universe) & F.col("_u") & (F.col("_w") > 0) & F.col(ret).isNotNull()
    total = F.sum(F.when(ok, F.col("_w"))).over(day)
    return df.withColumn("market", F.try_divide(F.sum(F.when(ok, F.col("_w") * F.col(ret))).over(day), total)).drop("_w", "_u")


def style_exposures(df: DataFrame, long: int = 252, least: int = 120, skip: int = 21, days: int = 60) -> DataFrame:
    """df: t, stock, close, volume, shares, cap, universe, ret, market. Adds STYLES, missing outside the universe.

    The market series has a row for each date and is joined before.
    """
    s = Series()
    w = s.last(long)
    r, m = F.col("ret"), F.col("market")
    ok = r.isNotNull() & m.isNotNull()
    rj, mj = F.when(ok, r), F.when(ok, m)
    var = F.var_pop(mj).over(w)
    beta = F.when((F.count(rj).over(w) >= least) & (var > FLAT), F.try_divide(F.covar_pop(rj, mj).over(w), F.when(var > FLAT, var)))
    old, late = (F.when(F.lag("close", k).over(s.order) > 0, F.lag("close", k).over(s.order)) for k in (long, skip))
    turn = finite(F.try_divide(F.col("volume"), F.when(F.col("shares") > 0, F.col("shares"))))
    df = df.withColumn("_turn", turn)
    out = {
        "size": F.log(F.when(F.col("cap") > 0, F.col("cap"))),
        "beta": beta,
        "momentum": F.try_divide(late, old) - 1,
        "volatility": F.when(F.count(r).over(w) >= least, F.stddev_pop(r).over(w)),
        "liquidity": F.when(F.count("_turn").over(s.last(days)) == days, F.avg("_turn").over(s.last(days))),
    }
    df = df.withColumns(out)
    return df.withColumns({k: F.when(F.col("universe"), finite(F.col(k))) for k in out}).drop("_turn")


def long_form(df: DataFrame, names, keep=("t", "stock"), name: str = "factor", value: str = "x") -> DataFrame:
    """A row for each name of a wide frame."""
    return df.select(*keep, F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias(name, value))


def style_returns(df: DataFrame, ret: str, styles=STYLES, least: int = LEAST_SAMPLE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long-short series of each style on plainly cleaned exposures: style, keys, t, long_short. One pass for all styles."""
    by = ("style", *keys, "t")
    rows = long_form(df, styles, (*keys, "t", "stock", "universe", ret), "style")
    return portfolios(clean_plain(rows, "x", F.col("universe"), "_z", by=by), "_z", ret, least=least, by=by).select(*by, "long_short")


def style_correlation(series: DataFrame, styles: DataFrame, least: int = 60, by: tuple[str, ...] = (), on: tuple[str, ...] = ("t",)) -> DataFrame:
    """series: by, on, x; styles: style, on, long_short. For each of by (one row without): the largest absolute correlation among styles
    with enough common rows, and how many styles have one."""
    pairs = styles.join(series, list(on)).filter("x is not null and long_short is not null")
    sx, sy = F.stddev_pop("x"), F.stddev_pop("long_short")
    c = F.when((F.count(F.lit(1)) >= least) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop("x", "long_short"), F.when(sx * sy > 0, sx * sy)))
    each = pairs.groupBy(*by, "style").agg(c.alias("c"))
    return (each.groupBy(*by) if by else each.groupBy()).agg(F.max(F.abs("c")).alias("penalty"), F.count("c").alias("styles"))


def cumulative(df: DataFrame, x: str, out: str, by: tuple[str, ...] = (), order: str = "t") -> DataFrame:
    """Compounded return so far; a missing period leaves a gap and does not end the product."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.product(F.col(x) + 1).over(w) - 1))


def reward(ic: Column, ratio: Column, penalty: Column, ir_weight: float = 0.3, style_weight: float = 0.2, floor: float = 1e-8) -> tuple[Column, Column]:
    """Reward and, where it is missing, the first reason."""
    reason = F.when(ic.isNull(), "ic").when(ratio.isNull(), "ir").when(penalty.isNull(), "style")
    value = F.abs(ic) * (F.least(F.greatest(ratio, F.lit(0.0)), F.lit(2.0)) * ir_weight + 1) * (F.lit(1.0) - F.least(F.greatest(penalty, F.lit(0.0)), F.lit(1.0)) * style_weight)
    return F.when(reason.isNull(), F.greatest(value, F.lit(floor))), reason


def coverage(df: DataFrame, x: str, universe: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Names of the universe with a value, names of the universe, and their ratio."""
    g = df.groupBy(*by) if by else df.groupBy()
    present, inside = F.sum((universe & F.col(x).isNotNull()).cast("long")), F.sum(universe.cast("long"))
    return g.agg(present.alias("present"), inside.alias("universe"), F.try_divide(present.cast("double"), inside.cast("double")).alias("coverage"))


def with_reward(df: DataFrame, ic: str = "ic", ratio: str = "ir", penalty: str = "penalty", floor: float = 1e-8) -> DataFrame:
    """Adds reward, log_reward, floored (whether the floor applied) and, where the reward is missing, reason."""
    value, reason = reward(F.col(ic), F.col(ratio), F.col(penalty), floor=0.0)
    df = df.withColumns({"_raw": value, "reason": reason})
    return df.withColumns({"reward": F.greatest("_raw", F.when(F.col("_raw").isNotNull(), F.lit(floor))), "log_reward": F.log(F.greatest("_raw", F.when(F.col("_raw").isNotNull(), F.lit(floor)))), "floored": F.col("_raw") < floor}).drop("_raw")


def daily_evaluation(rows: DataFrame, by: tuple[str, ...], label: str = "label", least: int = LEAST_SAMPLE, share: float = TOP_SHARE) -> DataFrame:
    """rows: by, stock, universe, x, z (cleaned), label. For each cross-section, in one pass: sample n, ic, universe and present names, the
    excess of the long leg in either direction (up, down), and the long-short return. Portfolios as in portfolios()."""
    ok, w = F.col("z").isNotNull() & F.col(label).isNotNull(), Window.partitionBy(*by, "_ok")
    rows = rows.withColumn("_ok", ok)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, "_ok", c)) - 1) / 2
    place = lambda *order: F.row_number().over(w.orderBy(*order))
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_a": rank("z"), "_b": rank(label), "_up": place(F.desc("z"), F.desc("stock")), "_down": place("z", F.desc("stock")), "_low": place("z", "stock")})
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    pair = F.least(k, F.floor(F.col("_n") / 2))
    of = lambda x, c=F.lit(True): F.when(F.col("_ok") & c, x)
    a, b = of(F.col("_a")), of(F.col("_b"))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    many = F.count(a) >= least
    usable = many & (F.max(of(F.col("z"))) - F.min(of(F.col("z"))) > FLAT)
    mean = lambda c: F.avg(of(F.col(label), c))
    present = F.col("universe") & finite(F.col("x")).isNotNull()
    return rows.groupBy(*by).agg(
        F.count_if(present & F.col(label).isNotNull()).alias("n"), F.when(many & (sa > EPS) & (sb > EPS), F.try_divide(F.covar_pop(a, b), sa * sb)).alias("ic"),
        F.count_if("universe").alias("universe"), F.count_if(present).alias("present"),
        F.when(usable, mean(F.col("_up") <= k) - mean(F.lit(True))).alias("up"), F.when(usable, mean(F.col("_down") <= k) - mean(F.lit(True))).alias("down"),
        F.when(usable, mean(F.col("_up") <= pair) - mean(F.col("_low") <= pair)).alias("long_short"),
    )


def evaluate_candidates(panel: DataFrame, names, styles: DataFrame, keys: tuple[str, ...] = (), label: str = "label", industry: str = "industry", least: int = LEAST_SAMPLE, common: int = 60) -> DataFrame:
    """The evaluation of candidates on the dates of a panel, from raw factor to reward: hash, keys, and the metrics of each.

    panel: keys (such as a split), t, stock, universe, label, industry, and a column for each name; styles: style (of STYLES), keys, t,
    long_short. Factors are unpivoted once, and each cross-section is cleaned, correlated and sorted into portfolios once, for both
    directions: the sign of the mean coefficient chooses. A candidate whose mean coefficient is 0 or missing has no direction, no
    portfolio and no reward.
    """
    by, per = ("hash", *keys, "t"), ("hash", *keys)
    rows = long_form(panel, names, (*keys, "t", "stock", "universe", label, industry), "hash")
    daily = daily_evaluation(clean_candidate(rows, "x", F.col("universe"), industry, "z", by), by, label, least)
    wide = styles.groupBy(*keys, "t").agg(*[F.max(F.when(F.col("style") == k, F.col("long_short"))).alias(f"_{k}") for k in STYLES])
    daily = daily.join(wide, [*keys, "t"], "left")

    def correlation(k: str) -> Column:
        both = F.col("long_short").isNotNull() & F.col(f"_{k}").isNotNull()
        x, y = F.when(both, F.col("long_short")), F.when(both, F.col(f"_{k}"))
        sx, sy = F.stddev_pop(x), F.stddev_pop(y)
        return F.abs(F.when((F.count(x) >= common) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), F.when(sx * sy > 0, sx * sy))))

    ratio = lambda c, std: F.when(std > 0, F.try_divide(F.avg(c), std))
    out = daily.groupBy(*per).agg(
        F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("ic_std"), ratio("ic", F.stddev_samp("ic")).alias("icir"), F.count("ic").alias("ic_periods"), F.signum(F.avg("ic")).alias("direction"),
        F.try_divide(F.sum("present").cast("double"), F.sum("universe").cast("double")).alias("coverage"), *[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), ratio(c, F.stddev_samp(c)).alias("ratio")).alias(c) for c in ("up", "down")],
        *[correlation(k).alias(f"_{k}") for k in STYLES],
    )
    way = F.when(F.col("direction") > 0, F.col("up")).when(F.col("direction") < 0, F.col("down"))
    known = sum((F.col(f"_{k}").isNotNull().cast("int") for k in STYLES), F.lit(0))
    out = out.withColumns({"_way": way, "ir_periods": way["n"], "annual_excess": way["mean"] * PERIODS, "ir": way["ratio"] * PERIODS**0.5})
    out = out.withColumns({"penalty": F.when(way.isNotNull(), F.greatest(*[F.col(f"_{k}") for k in STYLES])), "styles": F.when(way.isNotNull(), known.cast("long"))})
    return with_reward(out.drop("_way", "up", "down", *[f"_{k}" for k in STYLES]))
