"""Factor matrices, strategies and out-of-sample evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import EPS
from .evaluate import LEAST_SAMPLE, PERIODS, clean_candidate, ic_summary, long_form, rank_correlation

#: Scores that differ by no more are constant but for rounding.
CONSTANT = 1e-9
# fixed values of the rolling weights
HISTORY, LEAST_HISTORY, MATURITY, UPDATE, SHRINK, CAP, WINSOR = 150, 100, 2, 4, 0.5, 0.03, 0.95


def factor_matrix(df: DataFrame, factors: dict[str, float], universe: Column, industry: str = "industry") -> DataFrame:
    """Cleaned factors times their direction; missing is 0 for names of the universe with a known industry; other names are left out.

    df has a row for each t and stock. Factors are unpivoted once and share each window, however many they are.
    """
    others = [c for c in df.columns if c not in factors]
    way = F.create_map(*[F.lit(v) for k, d in factors.items() for v in (k, float(d))])
    clean = clean_candidate(long_form(df, factors, others), "x", universe, industry, "_z", ("factor", "t")).filter(universe & F.col(industry).isNotNull())
    value = F.coalesce("_z", F.lit(0.0)) * way[F.col("factor")]
    wide = clean.groupBy("t", "stock").agg(*[F.first(c).alias(c) for c in others if c not in ("t", "stock")], *[F.max(F.when(F.col("factor") == k, value)).alias(k) for k in factors])
    return wide.select(*df.columns)


def equal_weight(matrix: DataFrame, factors) -> DataFrame:
    total = sum((F.col(k) for k in factors), F.lit(0.0))
    return matrix.withColumn("score", total / len(list(factors)))


def periodic_ic(matrix: DataFrame, factors, label: str, least: int = LEAST_SAMPLE) -> DataFrame:
    """factor, t, n, ic."""
    return rank_correlation(long_form(matrix, factors, ("t", "stock", label)), "x", label, ("factor", "t"), least)


def redistribute(w: list[float], cap: float) -> list[float]:
    """Weights that sum to 1, none above the cap (at least 1 / n): what is cut off goes to the others by their room under the cap."""
    excess, room = sum(max(x - cap, 0.0) for x in w), sum(max(cap - x, 0.0) for x in w)
    out = [min(x, cap) + (excess * max(cap - x, 0.0) / room if room > 0 else 0.0) for x in w]
    return [x / sum(out) for x in out]


def icir_weights(ic: DataFrame, factors: list[str], periods: DataFrame, history: int = HISTORY, least: int = LEAST_HISTORY, cap: float = CAP, update: int = UPDATE, maturity: int = MATURITY) -> DataFrame:
    """ic: factor, p (period number; periods before the first are those of development, numbered -1, -2 and so on back), ic; periods: p.

    (u, factor, weight): at each update period, from the last `history` periods whose labels are known, `maturity` periods back, and from
    development alone before any is. A factor with fewer than `least` values, or of no spread or a negative ratio, has the share of equal
    weights only; ratios are clipped at a quantile of the positive ones, halfway between equal and proportional, and capped. If no factor
    has a positive ratio, the weights of the update before hold, or equal ones. Each value goes to the updates it serves: an equi join.
    """
    names = sorted(factors)
    n, cap = len(names), max(cap, 1 / len(names))
    updates = periods.filter((F.col("p") >= 0) & (F.col("p") % update == 0)).select(F.col("p").cast("int").alias("u")).distinct()
    p, u = F.col("p").cast("int"), F.col("u")
    first, last = F.ceil(F.greatest(p + maturity, F.lit(0)) / update).cast("int"), F.floor((p + maturity + history - 1) / update).cast("int")
    first = F.when(p < 0, 0).otherwise(first)
    serves = ic.filter((last >= first) & F.col("ic").isNotNull()).select("factor", "p", "ic", F.explode(F.sequence(first, last)).alias("k")).select("factor", "ic", (F.col("k") * update).cast("int").alias("u"), p.alias("p"))
    end = F.greatest(u - maturity, F.lit(-1))
    serves = serves.filter((F.col("p") <= end) & (F.col("p") > end - history))
    std = F.stddev_samp("ic")
    stats = serves.groupBy("u", "factor").agg(F.when((F.count("ic") >= least) & (std > EPS), F.greatest(F.lit(0.0), F.avg("ic") / std)).alias("ratio"))
    grid = updates.select("u", F.explode(F.array(*[F.lit(k) for k in names])).alias("factor")).join(stats, ["u", "factor"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    of = Window.partitionBy("u")  # as many rows as factors
    total = F.sum("ratio").over(of)
    most = F.percentile(F.when(F.col("ratio") > 0, F.col("ratio")), F.lit(WINSOR)).over(of)
    grid = grid.withColumn("clipped", F.when(total > EPS, F.least("ratio", most)))
    grid = grid.withColumn("w", F.lit(SHRINK / n) + F.col("clipped") / F.sum("clipped").over(of) * (1 - SHRINK))
    over, room = F.greatest(F.col("w") - cap, F.lit(0.0)), F.greatest(F.lit(cap) - F.col("w"), F.lit(0.0))
    spread = F.coalesce(F.try_divide(F.sum(over).over(of) * room, F.when(F.sum(room).over(of) > 0, F.sum(room).over(of))), F.lit(0.0))
    grid = grid.withColumn("w", F.when(F.col("w").isNotNull(), F.least("w", F.lit(cap)) + spread))
    grid = grid.withColumn("w", F.col("w") / F.sum("w").over(of))
    held = F.last("w", True).over(Window.partitionBy("factor").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    return grid.select("u", "factor", F.coalesce(held, F.lit(1 / n)).alias("weight"))


def rolling_scores(matrix: DataFrame, weights: DataFrame, factors: list[str], update: int = UPDATE) -> DataFrame:
    """matrix: t, stock, p and the factors. Score of each row with the weights of the latest update period."""
    long = long_form(matrix, factors, ("t", "stock", "p")).withColumn("u", (F.col("p") - F.col("p") % update).cast("int"))
    return long.join(weights, ["u", "factor"]).groupBy("t", "stock").agg(F.sum(F.col("weight") * F.col("x")).alias("score"))


def date_weights(df: DataFrame) -> DataFrame:
    """Sample weights under which each date counts alike and the mean weight is 1."""
    per = df.groupBy("t").agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_d"))
    return df.join(per, "t").join(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_d") * F.col("_n"))).drop("_n", "_all", "_d")


def boosted_model(train: DataFrame, validation: DataFrame, factors: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7):
    """A gradient-boosted regressor with date weights. Trees are added until the error on validation dates grows; then as many are trained
    anew on both. (assembler, model)"""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    to = VectorAssembler(inputCols=factors, outputCol="features")
    rows = date_weights(train.filter(F.col(label).isNotNull())).withColumn("check", F.lit(False)).unionByName(date_weights(validation.filter(F.col(label).isNotNull())).withColumn("check", F.lit(True)))
    rows = to.transform(rows).select("t", "stock", "features", label, "weight", "check").orderBy("t", "stock").persist()
    try:
        model = GBTRegressor(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.05)
        best = model.copy({model.validationIndicatorCol: "check"}).fit(rows).getNumTrees
        return to, model.copy({model.maxIter: best}).fit(rows)
    finally:
        rows.unpersist()


def boosted_scores(train: DataFrame, test: DataFrame, factors: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Scores of boosted_model() on test rows; the last fifth of the training dates validates."""
    edge = train.filter(F.col(label).isNotNull()).agg(F.percentile("t", F.lit(0.8))).head()[0]
    to, model = boosted_model(train.filter(F.col("t") <= edge), train.filter(F.col("t") > edge), factors, label, trees, depth, seed)
    return model.transform(to.transform(test)).select("t", "stock", F.col("prediction").alias("score"))


class LabelGate:
    """Test labels are given out only after scores are frozen."""

    def __init__(self, labels: DataFrame):
        self._labels, self._digest = labels, None

    def freeze(self, scores: DataFrame) -> str:
        row = scores.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[scores[c] for c in sorted(scores.columns)]))).head()
        self._digest = f"{row[0]}:{row[1]}"
        return self._digest

    def labels(self) -> DataFrame:
        if self._digest is None:
            raise PermissionError("scores must be frozen before test labels are read")
        return self._labels


def deciles(df: DataFrame, score: str = "score", groups: int = 10, least: int = LEAST_SAMPLE, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Adds g from 1: equal groups by (score, stock), larger groups first, on dates with enough names."""
    w = Window.partitionBy(*by)
    rows = df.filter(F.col(score).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= least)
    return rows.withColumn("g", F.ntile(groups).over(w.orderBy(score, "stock"))).drop("_n")


def decile_returns(df: DataFrame, ret: str, groups: int = 10, by: tuple[str, ...] = ("t",)) -> DataFrame:
    """Mean return of each group, spread, benchmark and excess of the top group."""
    cols = [F.avg(F.when(F.col("g") == k, F.col(ret))).alias(f"g{k}") for k in range(1, groups + 1)]
    out = df.groupBy(*by).agg(*cols, F.avg(ret).alias("benchmark"))
    return out.withColumns({"spread": F.col(f"g{groups}") - F.col("g1"), "excess": F.col(f"g{groups}") - F.col("benchmark")})


def turnover(holdings: DataFrame, periods: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """holdings: by, p, stock, ret (return after p). One-way turnover against drifted weights, and the share of names replaced.

    periods: p, valid, the same for each of by. A period compares with the one before it in the calendar, if both are valid; else it starts
    anew. Without holdings a period has no row, but where by is empty.
    """
    of = Window.partitionBy(*by, "p")
    now = holdings.withColumns({"w": 1.0 / F.count(F.lit(1)).over(of), "n": F.count(F.lit(1)).over(of)})
    grown = now.withColumn("d", F.col("w") * (F.col("ret") + 1)).withColumns({"_sum": F.sum("d").over(of), "_bad": F.sum(F.col("ret").isNull().cast("int")).over(of)})
    before = grown.select(*by, (F.col("p") + 1).alias("p"), "stock", F.try_divide(F.col("d"), F.when(F.col("_sum") > 0, F.col("_sum"))).alias("drift"), (F.col("_bad") > 0).alias("bad"))
    both = now.select(*by, "p", "stock", "w", "n").join(before, [*by, "p", "stock"], "full")
    moved = both.groupBy(*by, "p").agg(
        (F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("drift", F.lit(0.0)))) / 2).alias("turnover"),
        (1 - F.try_divide(F.count_if(F.col("w").isNotNull() & F.col("bad").isNotNull()), F.max("n"))).alias("replaced"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"), F.count("w").alias("names"), F.count("bad").alias("old"),
    )
    ok = periods.withColumn("ok", F.col("valid") & F.coalesce(F.lag("valid").over(Window.orderBy("p")), F.lit(False))).select("p", "ok")
    fine = F.col("ok") & ~F.col("bad") & (F.col("names") > 0) & (F.col("old") > 0)
    rows = moved.filter("names > 0").join(ok, "p") if by else ok.join(moved, "p", "left")
    return rows.select(*by, "p", F.when(fine, F.col("turnover")).alias("turnover"), F.when(fine, F.col("replaced")).alias("replaced"))


def net_of_costs(df: DataFrame, ret: str, rate: float) -> DataFrame:
    return df.withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * rate).withColumn("net", F.col(ret) - F.col("cost"))


def nav(df: DataFrame, ret: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Compounded value from 1, and drawdown from the highest value so far, the start included."""
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("nav", F.product(F.coalesce(F.col(ret), F.lit(0.0)) + 1).over(w))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)


def nav_from_start(df: DataFrame, ret: str, by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """by, date, nav, drawdown, initial: the value of each period, and a first row of 1 a day before the first."""
    rows = nav(df, ret, by).select(*by, date, "nav", "drawdown", F.lit(False).alias("initial"))
    g = df.groupBy(*by) if by else df.groupBy()
    first = g.agg(F.date_sub(F.min(date), 1).alias(date)).filter(F.col(date).isNotNull())
    return rows.unionByName(first.select(*by, date, F.lit(1.0).alias("nav"), F.lit(0.0).alias("drawdown"), F.lit(True).alias("initial")))


def performance(df: DataFrame, ret: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, geometric annual return, deviation, ratio, largest drawdown, and the share of periods above 0."""
    std = F.stddev_samp(ret)
    g = nav(df, ret, by)
    g = g.groupBy(*by) if by else g.groupBy()
    return g.agg(
        F.count(ret).alias("n"), (F.pow(F.product(F.coalesce(F.col(ret), F.lit(0.0)) + 1), F.lit(PERIODS) / F.count(ret)) - 1).alias("annual"),
        std.alias("std"), F.when(std > 0, F.try_divide(F.avg(ret), std) * PERIODS**0.5).alias("ratio"), F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"),
        F.avg(F.when(F.col(ret).isNotNull(), (F.col(ret) > EPS).cast("double"))).alias("wins"),
    )


def annual_returns(df: DataFrame, ret: str, date: str = "date") -> DataFrame:
    return df.filter(F.col(ret).isNotNull()).groupBy(F.year(date).alias("year")).agg((F.product(F.col(ret) + 1) - 1).alias("annual"), F.count(F.lit(1)).alias("n"))


def score_pivot(scores: DataFrame, labels: DataFrame, strategies: list[str], label: str = "label") -> DataFrame:
    """scores: strategy, t, stock, score. A row for each t and stock: a column for each strategy, and the label."""
    wide = scores.groupBy("t", "stock").agg(*[F.max(F.when(F.col("strategy") == k, F.col("score"))).alias(k) for k in strategies])
    return wide.join(labels.select("t", "stock", label), ["t", "stock"], "left")


def score_correlation(scores: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """scores: strategy, t, stock, score. Mean over dates of the rank correlation of each pair of strategies.

    A name's scores, as many as strategies, are paired in its row, so the scores are computed once.
    """
    rows = scores.groupBy("t", "stock").agg(F.collect_list(F.struct("strategy", "score")).alias("all"))
    one = rows.select("t", "all", F.explode("all").alias("x"))
    pairs = one.select("t", F.col("x.strategy").alias("a"), F.col("x.score").alias("xa"), F.explode(F.filter("all", lambda y: y["strategy"] > F.col("x.strategy"))).alias("y"))
    pairs = pairs.select("t", "a", "xa", F.col("y.strategy").alias("b"), F.col("y.score").alias("xb"))
    return rank_correlation(pairs, "xa", "xb", ("a", "b", "t"), least).groupBy("a", "b").agg(F.avg("ic").alias("correlation"), F.count("ic").alias("dates"))


def split_effectiveness(rows: DataFrame, score: str, label: str, split: str = "split", least: int = LEAST_SAMPLE) -> DataFrame:
    """rows: split, t, stock, score, label. Rank IC summary of each split, and the mean of the top group's return less the bottom one's.

    Both are over names with score and label, on dates with enough of them and scores that differ.
    """
    by = (split, "t")
    w = Window.partitionBy(*by)
    known = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_range", F.max(score).over(w) - F.min(score).over(w)).filter("_range > 0").drop("_range")
    ic = ic_summary(rank_correlation(known, score, label, by, least).filter(F.col("n") >= least), by=(split,))
    spread = decile_returns(deciles(known, score, least=least, by=by), label, by=by).groupBy(split).agg(F.avg("spread").alias("spread"))
    return ic.join(spread, split, "left")


class OutOfSample:
    """The evaluation of frozen scores against test labels: tables by date, and a summary by strategy.

    scores: strategy, t, stock, score, each strategy over the same names; labels: t, stock, label; calendar: t, date. A date is valid if
    enough names have a label and no strategy's scores are constant over them; all tables but coverage are over valid dates and labelled
    names. Portfolios hold the top group. Rows, coverage and portfolio serve several tables and are persisted; release() frees them.
    """

    def __init__(self, scores: DataFrame, labels: DataFrame, calendar: DataFrame, rate: float = 0.0, least: int = LEAST_SAMPLE, groups: int = 10):
        self.rate, self.groups, by = rate, groups, ("strategy", "t")
        rows = scores.join(labels.select("t", "stock", "label"), ["t", "stock"], "left")
        known = F.col("label").isNotNull()
        per = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(known).alias("labelled"), (F.max(F.when(known, F.col("score"))) - F.min(F.when(known, F.col("score")))).alias("_range"))
        flat = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("_range") <= CONSTANT, F.col("strategy")))))
        dates = per.groupBy("t").agg(F.max("eligible").alias("eligible"), F.max("labelled").alias("labelled"), flat.alias("_flat"))
        few = F.when(F.col("labelled") < least, F.lit("too few labels"))
        dates = dates.withColumn("reasons", F.array_join(F.array_compact(F.concat(F.array(few), F.transform("_flat", lambda x: F.concat(x, F.lit(" has constant scores"))))), "|"))
        order = F.row_number().over(Window.orderBy("t")) - 1  # a row for each date
        self.coverage = dates.withColumns({"p": order, "valid": F.col("reasons") == ""}).join(calendar, "t").select("t", "date", "p", "eligible", "labelled", "valid", "reasons").persist()
        good = rows.filter(known).join(self.coverage.filter("valid").select("t", "date", "p"), "t")
        self.rows = good = good.persist()
        self.assignments = deciles(good, "score", groups, least, by)
        self.deciles = decile_returns(self.assignments, "label", groups, (*by, "date", "p"))
        self.ic = rank_correlation(good, "score", "label", by, least)
        held = self.assignments.filter(F.col("g") == groups).select("strategy", "p", "stock", F.col("label").alias("ret"))
        self.turnover = turnover(held, self.coverage.select("p", "valid"), ("strategy",))
        out = self.deciles.select(*by, "date", "p", F.col(f"g{groups}").alias("long"), "benchmark", "excess", "spread").join(self.turnover, ["strategy", "p"], "left")
        # without a period before there is no turnover, no cost and no net return
        self.portfolio = out.withColumn("cost", F.col("turnover") * rate).withColumn("net", F.col("long") - F.col("cost")).persist()

    def release(self) -> None:
        for df in (self.portfolio, self.rows, self.coverage):
            df.unpersist()

    def cumulative_ic(self) -> DataFrame:
        w = Window.partitionBy("strategy").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return self.ic.withColumn("total", F.sum("ic").over(w))

    def navs(self) -> DataFrame:
        """strategy, series, date, nav, drawdown, initial: of the long leg, the benchmark, the excess and the spread."""
        return nav_from_start(self._series(), "x", ("strategy", "series"))

    def _series(self) -> DataFrame:
        return long_form(self.portfolio, ["long", "benchmark", "excess", "spread"], ("strategy", "t", "date"), "series")

    def performance(self) -> DataFrame:
        """strategy, series: annual return, ratio, largest drawdown and winning share of each series."""
        return performance(self._series(), "x", ("strategy", "series"))

    def summary(self) -> DataFrame:
        """A row for each strategy: rank IC, mean return of each group and the spread, turnover."""
        moved = self.turnover.groupBy("strategy").agg(F.avg("turnover").alias("turnover_mean"), F.percentile("turnover", F.lit(0.5)).alias("turnover_median"), F.percentile("turnover", F.lit(0.75)).alias("turnover_p75"), F.max("turnover").alias("turnover_most"), F.count("turnover").alias("turnovers"), F.avg("replaced").alias("replaced_mean"))
        means = self.deciles.groupBy("strategy").agg(*[F.avg(f"g{k}").alias(f"g{k}") for k in range(1, self.groups + 1)], F.avg("spread").alias("spread"))
        ic = ic_summary(self.ic, by=("strategy",)).select("strategy", "mean", "std", "icir", "positive", "valid")
        return ic.join(means, "strategy", "left").join(moved, "strategy", "left")

    def report(self) -> DataFrame:
        """The summary and the performance of every series side by side, a row for each strategy."""
        cols = ("annual", "ratio", "max_drawdown", "wins")
        wide = self.performance().groupBy("strategy").agg(*[F.max(F.when(F.col("series") == k, F.col(c))).alias(f"{k}_{c}") for k in ("long", "benchmark", "excess", "spread") for c in cols])
        return self.summary().join(wide, "strategy", "left")
