"""Aggregations for reports: summaries, usage, quality tables, funnels, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import finite


def numeric_summary(df: DataFrame, x: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """First, median, last, least, most, mean and 95th percentile of the finite values in order."""
    rows = df.withColumn("_x", finite(F.col(x))).filter("_x is not null")
    g = rows.groupBy(*by) if by else rows.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.min_by("_x", order).alias("first"), F.percentile("_x", F.lit(0.5)).alias("median"), F.max_by("_x", order).alias("last"),
        F.min("_x").alias("least"), F.max("_x").alias("most"), F.avg("_x").alias("mean"), F.percentile("_x", F.lit(0.95)).alias("p95"),
    )


def token_usage(candidates: DataFrame, vocabulary: DataFrame, by: tuple[str, ...] = ("name", "kind")) -> DataFrame:
    """candidates: hash, tokens; vocabulary: token, and what it is counted by (its name, kind, family, window, ...).

    Occurrences, and the share of candidates that use each; a candidate counts once, however often it does.
    """
    rows = candidates.select("hash", F.explode("tokens").alias("token")).join(vocabulary, "token")
    total = candidates.agg(F.count_distinct("hash").alias("_all"))  # one row
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("hash").alias("candidates"))
    return out.join(F.broadcast(total)).withColumn("share", F.col("candidates") / F.col("_all")).drop("_all")


def quality_table(df: DataFrame, metrics: list[str], thresholds: dict[str, float]) -> DataFrame:
    """metric, n, least, quartiles, most, mean, how many are above the threshold."""
    long = df.select(F.explode(F.create_map(*[v for m in metrics for v in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "x"))
    limit = F.create_map(*[F.lit(v) for m in metrics for v in (m, float(thresholds.get(m, float("inf"))))])
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    out = long.groupBy("metric").agg(F.count("x").alias("n"), F.min("x").alias("least"), q.alias("q"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.count_if(F.col("x") > limit[F.col("metric")]).alias("above"))
    return out.select("metric", "n", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most", "mean", "above")


def exploration(accepted: DataFrame, found: DataFrame, block: int = 10) -> DataFrame:
    """cycle counts: accepted and newly found, running totals, block number, share of new ones."""
    a = accepted.groupBy("cycle").agg(F.count(F.lit(1)).alias("accepted"))
    b = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("found"))
    rows = a.join(b, "cycle", "full").select("cycle", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("found", F.lit(0)).alias("found"))
    w = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"accepted_total": F.sum("accepted").over(w), "found_total": F.sum("found").over(w), "block": F.floor(F.col("cycle") / block), "new_share": F.try_divide(F.col("found"), F.when(F.col("accepted") > 0, F.col("accepted")))})


def greedy_audit(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pairs: a, b, c with a before b; verdicts: rank, verdict. Largest absolute correlation of each candidate with those retained before."""
    kept = verdicts.filter("verdict = 'retained'").select(F.col("rank").alias("a"))
    most = pairs.join(kept, "a").groupBy(F.col("b").alias("rank")).agg(F.max(F.abs("c")).alias("max_correlation"))
    return verdicts.join(most, "rank", "left")


def funnel(stages: DataFrame) -> DataFrame:
    """stages: k, stage, n. Input, remaining, rejected and share of each stage."""
    w = Window.orderBy("k")
    return stages.withColumn("input", F.coalesce(F.lag("n").over(w), F.col("n"))).withColumns({"rejected": F.col("input") - F.col("n"), "share": F.try_divide(F.col("n"), F.when(F.col("input") > 0, F.col("input")))})


def depth_table(df: DataFrame) -> DataFrame:
    """df: hash, nodes, depth, valid, reward, ic, seconds. A row for each size and depth from 0 to the size's deepest, absent ones too."""
    rows = df.dropDuplicates(["hash"])
    p = F.percentile("reward", F.array(F.lit(0.9), F.lit(0.99)))
    stats = rows.groupBy("nodes", "depth").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), p.alias("p"), F.percentile(F.abs("ic"), F.lit(0.9)).alias("ic90"), F.avg("seconds").alias("mean_seconds"), F.percentile("seconds", F.lit(0.5)).alias("median_seconds"))
    grid = rows.groupBy("nodes").agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("all")).select("nodes", "all", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("depth"))
    out = grid.join(stats, ["nodes", "depth"], "left")
    return out.select("nodes", "depth", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"), F.try_divide("valid", "n").alias("valid_rate"), F.col("p")[0].alias("reward90"), F.col("p")[1].alias("reward99"), "ic90", "mean_seconds", "median_seconds")


def unique_records(df: DataFrame, source: str, of: str, identity: list[str], first: list[str], key: str = "hash") -> DataFrame:
    """Of the records of one source a row for each key, the least by the columns `first`, then by the others; adds visits.

    The query fails if records of a key differ in the identity columns; nulls are equal. Keys that are null are left out.
    """
    same = F.struct(*identity)
    rest = [c for c in df.columns if c not in (key, source, *first)]
    rows = df.filter((F.col(source) == of) & F.col(key).isNotNull())
    out = rows.groupBy(key).agg(F.min(same).alias("_a"), F.max(same).alias("_b"), F.min(F.struct(*first, *rest)).alias("_r"), F.count(F.lit(1)).alias("visits"))
    agreed = F.assert_true(F.col("_a").eqNullSafe(F.col("_b")), "records of one key disagree")
    return out.filter(agreed.isNull()).select(key, *[F.col(f"_r.{c}").alias(c) for c in (*first, *rest)], "visits")


def source_snapshot(records: DataFrame, branch: str, branches: list[str]) -> DataFrame:
    """The records of some branches, with content: the SHA-256 of a record as JSON, its columns by name and nulls spelt out."""
    whole = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    return records.filter(F.col(branch).isin(branches)).withColumn("content", F.sha2(whole, 256))


def set_fingerprints(snapshot_: DataFrame, branch: str) -> DataFrame:
    """branch, n, fingerprint: a sum of 60 bits of each content, so that the order and the partitions of the records don't matter."""
    bits = F.conv(F.substring("content", 1, 15), 16, 10).cast("decimal(38,0)")
    return snapshot_.groupBy(branch).agg(F.count(F.lit(1)).alias("n"), F.sum(bits).cast("string").alias("fingerprint"))


def health(df: DataFrame, x: str, by: tuple[str, ...]) -> DataFrame:
    """Mean, deviation, median, root mean square, and the share of values above 0."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, F.lit(0.5)).alias("median"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.avg((F.col(x) > 0).cast("double")).alias("positive"))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """Sorted values and the share at or below, a step for each row."""
    w = Window.orderBy(x)
    return df.filter(F.col(x).isNotNull()).select(F.col(x).alias("x"), (F.row_number().over(w) / F.count(F.lit(1)).over(Window.partitionBy())).alias("share"))


def rolling_median(df: DataFrame, x: str, order: str, by: tuple[str, ...], window: int = 5, least: int = 3) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn("rolling_median", F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w)))


def stability(df: DataFrame, a: str, b: str) -> DataFrame:
    """Levels of two metrics of the same rows, share of equal signs, change."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.filter(both).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("same_sign"), F.avg(F.col(b) - F.col(a)).alias("change"), F.percentile(F.col(b) - F.col(a), F.lit(0.5)).alias("median_change"))


def window_stability(df: DataFrame, x: str, order: str, size: int = 16, tolerance: float = 0.1) -> DataFrame:
    """The two latest windows of `size` rows: medians, interquartile ranges, and whether both moved less than the tolerance."""
    rows = df.orderBy(F.desc(order)).limit(2 * size).withColumn("_k", F.floor((F.row_number().over(Window.orderBy(F.desc(order))) - 1) / size))
    q = lambda k: F.percentile(F.when(F.col("_k") == k, F.col(x)), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    s = rows.agg(q(0).alias("late"), q(1).alias("early"), F.count(F.lit(1)).alias("n"))
    s = s.select("n", F.col("late")[1].alias("median"), F.col("early")[1].alias("median_before"), (F.col("late")[2] - F.col("late")[0]).alias("iqr"), (F.col("early")[2] - F.col("early")[0]).alias("iqr_before"))
    return s.withColumn("stable", (F.abs(F.col("median") - F.col("median_before")) <= tolerance) & (F.abs(F.col("iqr") - F.col("iqr_before")) <= tolerance))


def effective(base: DataFrame, extra: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The base value, else the extra one, and which it is."""
    rows = base.join(extra.withColumnRenamed(x, "_extra"), keys, "left")
    return rows.withColumn("origin", F.when(F.col(x).isNotNull(), "base").when(F.col("_extra").isNotNull(), "extra").otherwise("missing")).withColumn(x, F.coalesce(x, "_extra")).drop("_extra")


def snapshot(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def projected_cost(df: DataFrame, planned: DataFrame, stratum: str, seconds: str) -> DataFrame:
    """Seconds of planned rows at their stratum's mean; savings of reused rows are not below 0."""
    mean = df.groupBy(stratum).agg(F.avg(seconds).alias("mean_seconds"))
    return planned.join(mean, stratum, "left").withColumns({"projected": F.col("n") * F.col("mean_seconds"), "saved": F.greatest(F.lit(0.0), F.col("reused") * F.col("mean_seconds"))})


def subset(metrics: DataFrame, later: DataFrame, key: str = "hash") -> DataFrame:
    return metrics.join(later.select(key), key, "left_semi")


def log_sum_exp(df: DataFrame, x: str, by: tuple[str, ...], out: str = "log_mass") -> DataFrame:
    """Logarithm of the sum of exponentials of each group, about its maximum so that nothing overflows."""
    most = df.groupBy(*by).agg(F.max(x).alias("_m"))
    return df.join(most, list(by)).groupBy(*by).agg((F.max("_m") + F.log(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias(out), F.count(x).alias("n"))


def calibration(df: DataFrame, x: str, by: str) -> DataFrame:
    """Percentiles 10, 25, 50, 75, 90 of each group, valid rows and attempts."""
    p = F.percentile(x, F.array(*[F.lit(v) for v in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = df.groupBy(by).agg(p.alias("p"), F.count(x).alias("valid"), F.count(F.lit(1)).alias("attempts"))
    return out.select(by, *[F.col("p")[k].alias(n) for k, n in enumerate(("p10", "p25", "p50", "p75", "p90"))], "valid", "attempts")


def series_diagnostics(df: DataFrame, x: str, by: tuple[str, ...], periods: float, least: int = 60) -> DataFrame:
    """Valid periods, mean, deviation, ratio, compounded return; unusable if too short or constant."""
    std = F.stddev_samp(x)
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"), F.when(std > 0, F.try_divide(F.avg(x), std) * periods**0.5).alias("ratio"), (F.product(F.coalesce(F.col(x), F.lit(0.0)) + 1) - 1).alias("total"))
    return out.withColumn("usable", (F.col("n") >= least) & F.coalesce(F.col("std") > 0, F.lit(False)))


def correlation_matrix(pairs: DataFrame, names: list) -> DataFrame:
    """pairs: a, b, c. A row for each name with its correlation to every other; 1 to itself."""
    both = pairs.select("a", "b", "c").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    own = pairs.sparkSession.createDataFrame([(n, n, 1.0) for n in names], pairs.select("a", "b", "c").schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "))
    return both.unionAll(own).groupBy("a").pivot("b", names).agg(F.first("c"))


def matrix_summary(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, c. One row: how many are known, and mean, median, least and most of the signed and of the absolute correlations."""
    cols = [f(x).alias(f"{k}{n}") for k, x in (("", F.col("c")), ("absolute_", F.abs("c"))) for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("least", F.min), ("most", F.max))]
    return pairs.agg(F.count("c").alias("n"), *cols)


def distribution(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, median, population deviation, least and most."""
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))


def examples(df: DataFrame, orders: list[tuple[str, list]], n: int = 5, key: str = "hash") -> DataFrame:
    """The first n rows by each of some orders, a row once: by the first order that has it, with its name and place."""
    parts = None
    for k, (name, order) in enumerate(orders):
        top = df.orderBy(*order).limit(n)
        one = top.withColumns({"by": F.lit(name), "place": F.row_number().over(Window.orderBy(*order)), "_k": F.lit(k)})  # n rows
        parts = one if parts is None else parts.unionAll(one)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_k"))
    return parts.withColumn("_n", first).filter("_n = 1").drop("_n", "_k")


def masses(df: DataFrame, log_reward: str, by: tuple[str, ...]) -> DataFrame:
    """The exact mass of each stratum: logarithm of the sum of rewards, the sum, valid and invalid (missing) ones. In one aggregation:
    rewards are summed about the largest of their group."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_m", F.max(log_reward).over(w))
    about = F.sum(F.exp(F.col(log_reward) - F.col("_m")))
    out = rows.groupBy(*by).agg((F.max("_m") + F.log(about)).alias("log_mass"), F.count(log_reward).alias("valid"), F.count_if(F.col(log_reward).isNull()).alias("invalid"))
    return out.withColumn("mass", F.exp("log_mass"))


def stratum_coverage(evaluated: DataFrame, expected: DataFrame, stratum: str) -> DataFrame:
    """evaluated: stratum, valid; expected: stratum, expected. Expected, evaluated and valid of each stratum, shares, and completeness."""
    seen = evaluated.groupBy(stratum).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("valid").alias("valid"))
    out = expected.join(seen, stratum, "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("evaluated", "valid")})
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumns({"share": share("evaluated", "expected"), "valid_share": share("valid", "evaluated"), "complete": F.col("evaluated") >= F.col("expected")})


def flow_losses(df: DataFrame, by: tuple[str, ...], log_z: str, forward: str, log_reward: str, backward: str) -> DataFrame:
    """Trajectory balance, the mean of (log_z + forward - log_reward - backward)^2, and the variance of the implied log partition.

    forward and backward are sums of log probabilities along a trajectory.
    """
    implied = F.col(log_reward) + F.col(backward) - F.col(forward)
    off = F.col(log_z) - implied
    return df.groupBy(*by).agg(F.avg(off * off).alias("trajectory_balance"), F.var_pop(implied).alias("log_partition_variance"), F.count(F.lit(1)).alias("n"))


def identified(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that must find every row of the left side once."""
    many = right.groupBy(key).agg(F.count(F.lit(1)).alias("_many"))
    if left.select(key).join(many, key, "left").filter("_many is null or _many > 1").head(1):
        raise ValueError("some rows have no match, or several")
    return left.join(right, key)
