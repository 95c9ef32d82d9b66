"""Candidate import, screening, decorrelation and sampling.

Candidates are one row for each expression; their number is that of expressions tried, not of market data.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: limits of the screen; all comparisons are strict
LEAST_IC, LEAST_RATIO, MOST_STYLE, MOST_CORRELATION, LEAST_PERIODS = 0.01, 0.25, 0.7, 0.7, 60
#: Up to so many rows are sorted in one task.
SORTED_ROWS = 1_000_000
CODES = ("train_ic", "validation_ic", "ic_sign", "train_ratio", "validation_ratio", "train_style")


def conditions() -> dict[str, Column]:
    """Three-valued: missing where its metric is."""
    return {
        "train_ic": F.abs("train_ic") > LEAST_IC,
        "validation_ic": F.abs("validation_ic") > LEAST_IC,
        "ic_sign": F.col("train_ic") * F.col("validation_ic") > 0,
        "train_ratio": F.col("train_ratio") > LEAST_RATIO,
        "validation_ratio": F.col("validation_ratio") > LEAST_RATIO,
        "train_style": F.col("train_style") < MOST_STYLE,
    }


def hard_filter(candidates: DataFrame, codes=CODES) -> DataFrame:
    """Adds passed and failed (the codes that are false or missing, comma-joined)."""
    checks = {k: v for k, v in conditions().items() if k in codes}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))
    return candidates.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.col("failed") == "")


def train_prefilter(candidates: DataFrame) -> DataFrame:
    return hard_filter(candidates, ("train_ic", "train_ratio", "train_style"))


def pass_counts(candidates: DataFrame) -> DataFrame:
    """code, observed, passed: missing results are not counted."""
    checks = conditions()
    long = candidates.select(F.explode(F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), c)])).alias("code", "ok"))
    return long.groupBy("code").agg(F.count("ok").alias("observed"), F.count_if("ok").alias("passed"))


def failure_combinations(screened: DataFrame, top: int = 15) -> DataFrame:
    """The most common combinations of failed codes, the tail as OTHER."""
    counts = screened.filter("not passed").groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "failed"))  # at most 2**6 rows
    return counts.withColumn("combination", F.when(rank <= top, F.col("failed")).otherwise("OTHER")).groupBy("combination").agg(F.sum("n").alias("n"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Adds rank from 1: strongest train coefficient first, then hash."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("train_ic")), "hash")))


def top_k(candidates: DataFrame, k: int = 100) -> DataFrame:
    return ranked(candidates.orderBy(F.desc(F.abs("train_ic")), "hash").limit(k))


def pair_correlations(series: DataFrame, ranks: DataFrame, least: int = LEAST_PERIODS, late: int | None = None) -> DataFrame:
    """series: hash, t, x; ranks: hash, rank. (a, b, n, c, status, reason): pairs with rank a < rank b, over common dates; c is missing if
    the pair is unusable. late: only pairs whose b has at least this rank.

    A date's values, as many as candidates, are paired in its row, so the series are computed once.
    """
    rows = series.filter(F.col("x").isNotNull()).join(ranks.select("hash", "rank"), "hash").groupBy("t").agg(F.collect_list(F.struct("rank", "x")).alias("all"))
    one = rows.select("all", F.explode("all").alias("l"))
    behind = lambda y: (y["rank"] > F.col("l.rank")) & (y["rank"] >= late if late is not None else F.lit(True))
    pairs = one.select(F.col("l.rank").alias("a"), F.col("l.x").alias("xa"), F.explode(F.filter("all", behind)).alias("r"))
    pairs = pairs.select("a", "xa", F.col("r.rank").alias("b"), F.col("r.x").alias("xb"))
    sa, sb = F.stddev_pop("xa"), F.stddev_pop("xb")
    c = F.when((sa > 0) & (sb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop("xa", "xb"), F.when(sa * sb > 0, sa * sb)))))
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), c.alias("_c"))
    status = F.when(F.col("n") < least, "insufficient_common_periods").when(F.col("_c").isNull(), "correlation_unavailable").otherwise("valid")
    reason = F.when(F.col("n") < least, "too few common periods").when(F.col("_c").isNull(), "a series is constant")
    return out.select("a", "b", "n", F.when(F.col("n") >= least, F.col("_c")).alias("c"), status.alias("status"), reason.alias("reason"))


def _judge(rank: int, kept: list[int], known: dict[int, float | None], most: float) -> tuple[int, str, int | None]:
    """Against the retained in their order: rejected or invalid on the first that decides."""
    for k in kept:
        c = known.get(k)
        if c is None or abs(c) >= most:
            return rank, "invalid" if c is None else "rejected", k
    return rank, "retained", None


def greedy_decorrelate(ranks: DataFrame, pairs: DataFrame, most: float = MOST_CORRELATION) -> list[tuple[int, str, int | None]]:
    """(rank, verdict, the retained rank that decided): candidates in rank order; rejected on the first retained one with |c| >= most.

    Each verdict depends on those before, so the scan is a loop; pairs are streamed in its order, and those of one candidate are held.
    """
    known: dict[int, dict[int, float | None]] = {}
    rows = itertools.groupby(pairs.select("a", "b", "c").orderBy("b", "a").toLocalIterator(), key=lambda r: r["b"])
    ahead = next(rows, None)
    kept, out = [], []
    for (rank,) in ranks.select("rank").orderBy("rank").toLocalIterator():
        known = {}
        while ahead is not None and ahead[0] <= rank:
            if ahead[0] == rank:
                known = {r["a"]: r["c"] for r in ahead[1]}
            ahead = next(rows, None)
        out.append(_judge(rank, kept, known, most))
        if out[-1][1] == "retained":
            kept.append(rank)
    return out


def greedy_select(series: DataFrame, ranks: DataFrame, most: float = MOST_CORRELATION, least: int = LEAST_PERIODS, batch: int = 256) -> list[tuple[int, str, int | None]]:
    """greedy_decorrelate() without all pairs: a batch of candidates at a time is correlated with those retained so far and with itself."""
    series = series.persist()
    try:
        order = [r for (r,) in ranks.select("rank").orderBy("rank").toLocalIterator()]
        kept, out = [], []
        for lo in range(0, len(order), batch):
            now = order[lo : lo + batch]
            some = ranks.join(ranks.sparkSession.createDataFrame([(r,) for r in [*kept, *now]], "rank int"), "rank")
            known: dict[int, dict[int, float | None]] = {}
            for r in pair_correlations(series, some, least, now[0]).select("a", "b", "c").toLocalIterator():
                known.setdefault(r["b"], {})[r["a"]] = r["c"]
            for rank in now:
                out.append(_judge(rank, kept, known.get(rank, {}), most))
                if out[-1][1] == "retained":
                    kept.append(rank)
        return out
    finally:
        series.unpersist()


class Selection:
    """The selection of candidates: screen, rank, greedy decorrelation. records: hash and the screened metrics; series: hash, t, x.

    screened: records with passed and failed; ranked: those that pass, with rank; verdicts: rank, hash, verdict, decided_by (a hash);
    retained: hash, rank and place; funnel: what each step left.
    """

    def __init__(self, records: DataFrame, series: DataFrame, most: float = MOST_CORRELATION, least: int = LEAST_PERIODS):
        spark = records.sparkSession
        self.screened = hard_filter(records)
        self.ranked = ranked(self.screened.filter("passed"))
        found = spark.createDataFrame(greedy_select(series, self.ranked, most, least), "rank int, verdict string, by int")
        names = self.ranked.select("rank", "hash")
        decided = names.select(F.col("rank").alias("by"), F.col("hash").alias("decided_by"))
        self.verdicts = found.join(names, "rank").join(decided, "by", "left").select("rank", "hash", "verdict", "decided_by")
        place = F.row_number().over(Window.orderBy("rank"))  # of the retained
        self.retained = self.verdicts.filter("verdict = 'retained'").select("hash", "rank", place.alias("place"))
        steps = [self.screened, self.ranked, self.retained]
        self.funnel = functools.reduce(DataFrame.unionAll, [d.agg(F.lit(k).alias("k"), F.lit(s).alias("stage"), F.count(F.lit(1)).alias("n")) for k, (s, d) in enumerate(zip(("candidates", "passed", "retained"), steps, strict=True))])

    def write(self, path: str) -> None:
        """The five tables, each in a folder of its own."""
        for name in ("screened", "ranked", "verdicts", "retained", "funnel"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def structure_tags(tokens: Column) -> dict[str, Column]:
    """What a candidate's tokens say of its structure: number of nodes, and whether rolling or cross-sectional operators occur."""
    series, section = F.exists(tokens, lambda x: x.startswith("ts_")), F.exists(tokens, lambda x: x.startswith("cs_"))
    return {"nodes": F.size(tokens), "series": series, "section": section}


def structure_strata(quotas: dict[str, int], small: int = 3, middle: int = 6, nodes: str = "nodes", origins: str = "origins") -> list[tuple[str, Column, int]]:
    """Strata of a structure-diverse sample, in order: small, middle, series only, section only, both, most complex, several origins, fill."""
    n, s, c = F.col(nodes), F.col("series"), F.col("section")
    inside = {"small": n <= small, "middle": (n > small) & (n <= middle), "series": s & ~c, "section": c & ~s, "both": s & c, "complex": n > middle, "origins": F.size(origins) > 1, "fill": F.lit(True)}
    return [(k, inside[k], quotas[k]) for k in inside if quotas.get(k)]


def group_candidates(origins: DataFrame) -> DataFrame:
    """origins: hash, digest, origin. A row for each expression: sorted origins, and whether its representations disagree."""
    return origins.groupBy("hash").agg(F.sort_array(F.collect_set("origin")).alias("origins"), F.count(F.lit(1)).alias("visits"), (F.count_distinct("digest") > 1).alias("conflict"))


def reject_reasons(rows: DataFrame) -> Column:
    """The first broken rule of a candidate record, null if none."""
    return F.when(F.col("formula").isNull() | (F.trim("formula") == ""), "formula").when(~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash").when(F.coalesce(F.col("node_count"), F.lit(0)) < 1, "node_count")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """hash, first_seen, last_seen, visits."""
    return old.unionByName(new).groupBy("hash").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("visits").alias("visits"))


def quota_sample(df: DataFrame, strata: list[tuple[str, Column, int]], order: list, total: int | None = None) -> DataFrame:
    """Rows of each stratum in turn up to its quota; a row counts for the first stratum that takes it. total: as many in all, from the last
    stratum, which then has as many as are wanting."""
    parts = None
    for k, (name, inside, quota) in enumerate(strata):
        quota = total if total is not None and k == len(strata) - 1 else quota
        one = df.filter(inside).orderBy(*order).limit(quota).select(*df.columns, F.lit(name).alias("stratum"), F.lit(k).alias("_k"))
        parts = one if parts is None else parts.unionAll(one)
    chosen = parts.groupBy("hash").agg(F.min_by("stratum", "_k").alias("stratum"), F.min("_k").alias("_k"), *[F.first(c).alias(c) for c in df.columns if c != "hash"])
    if total is not None:
        chosen = chosen.orderBy("_k", *order).limit(total)
    return chosen.select("hash", "stratum")


def spread_sample(df: DataFrame, n: int, order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows of each of by at evenly spaced places of the order, with their place; samples of several groups interleave by place.

    Rows are sorted and numbered part by part: the parts' sizes, one row each, tell where each begins.
    """
    total = df.count()
    if by or total <= SORTED_ROWS:
        of = Window.partitionBy(*by)
        rows = df.withColumn("_n", F.row_number().over(of.orderBy(*order)) - 1).withColumn("_all", F.count(F.lit(1)).over(of))
    else:
        parts = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).persist()
        before = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
        starts, at = {}, 0
        for k in sorted(before):
            starts[k], at = at, at + before[k]
        first = F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)])
        rows = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + first[F.col("_p")]).withColumn("_all", F.lit(total)).drop("_p")
    if n < 2:
        return rows.filter(F.col("_n") < n).withColumn("place", F.lit(0)).drop("_n", "_all")
    place = lambda k: F.floor(k * (F.col("_all") - 1) / (n - 1))
    near = F.floor(F.col("_n") * (n - 1) / F.greatest(F.col("_all") - 1, F.lit(1)))  # the place at or about the row, if there are more rows than places
    sparse = F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 2, F.lit(n - 1)))
    some = F.when(F.col("_all") > n, sparse).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return rows.withColumn("place", F.explode(F.filter(some, lambda k: place(k) == F.col("_n")))).withColumn("place", F.col("place").cast("int")).drop("_n", "_all")


def greedy_coverage(rows: list[tuple[str, frozenset]], n: int, weight=lambda tag: 10 if tag.startswith("op:") else 2) -> list[str]:
    """Hashes chosen one by one, each adding most weight of tags not seen; ties by hash."""
    seen, left, out = set(), dict(rows), []
    while left and len(out) < n:
        best = min(left, key=lambda h: (-sum(weight(t) for t in left[h] - seen), h))
        seen |= left.pop(best)
        out.append(best)
    return out


def close_enough(a: Column, b: Column, absolute: float = 1e-12, relative: float = 1e-9) -> Column:
    return (a.isNull() & b.isNull()) | (F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * relative + absolute)
