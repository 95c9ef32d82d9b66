"""Compatibility audit of stored expressions, and calendars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expression import RAW, ExpressionError, from_prefix
from ..plans.grammar import Grammar
from ..session import ship
from .evaluate import LEAST_SAMPLE

AUDIT = "hash string, verdict string, reason string, formula string"


def compatibility(candidates: DataFrame, max_nodes: int = 15, max_depth: int = 6, leaves: tuple[str, ...] = RAW) -> DataFrame:
    """candidates: hash, tokens. Parses each record again: accept, reject (it can't be an expression here) or review (its hash differs)."""
    ship(candidates.sparkSession)

    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(max_nodes, max_depth, leaves)
        for b in batches:
            out = []
            for h, tokens in zip(b["hash"], b["tokens"], strict=True):
                try:
                    node = from_prefix(list(tokens) if tokens is not None else [], leaves)
                except ExpressionError as e:
                    out.append((h, "reject", str(e), None))
                    continue
                if node.stats()["nodes"] > grammar.max_nodes or node.depth() > grammar.max_depth:
                    out.append((h, "reject", "beyond the limits of size", node.formula()))
                else:
                    same = node.hash() == h
                    out.append((h, "accept" if same else "review", None if same else "its hash differs", node.formula()))
            yield pd.DataFrame(out, columns=["hash", "verdict", "reason", "formula"])

    return candidates.select("hash", "tokens").mapInPandas(audit, AUDIT)


def global_calendar(panel: DataFrame, columns: list[str], every: int = 5, least: int = LEAST_SAMPLE) -> DataFrame:
    """t, n, included: every `every` rows from the first date on which enough names have all columns."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    dates = panel.groupBy("t").agg(F.count_if(ok).alias("n"))
    first = F.min(F.when(F.col("n") >= least, F.col("t"))).over(Window.partitionBy())  # one row for each date
    return dates.withColumn("_f", first).filter((F.col("t") >= F.col("_f")) & ((F.col("t") - F.col("_f")) % every == 0)).select("t", "n", (F.col("n") >= least).alias("included"))


def industry_codes(panel: DataFrame, industry: str = "industry") -> DataFrame:
    """Adds code: dense from 0 on each date, -1 where the industry is unknown."""
    w = Window.partitionBy("t", F.col(industry).isNull()).orderBy(industry)
    return panel.withColumn("code", F.when(F.col(industry).isNull(), -1).otherwise(F.dense_rank().over(w) - 1))


def coverage_by_date(scores: DataFrame, labels: DataFrame, least: int = LEAST_SAMPLE) -> DataFrame:
    """scores: t, stock, score; labels: t, stock, label. Counts, share of labelled scores, validity and its reason, by date."""
    rows = scores.join(labels, ["t", "stock"], "left")
    out = rows.groupBy("t").agg(F.count("score").alias("scored"), F.count_if(F.col("score").isNotNull() & F.col("label").isNotNull()).alias("labelled"))
    out = out.withColumn("share", F.try_divide(F.col("labelled").cast("double"), F.col("scored").cast("double")))
    return out.withColumn("reason", F.when(F.col("scored") < least, "too few scores").when(F.col("labelled") < F.col("scored"), "labels are missing"))
