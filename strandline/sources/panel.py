"""Panels over the star schema: one row for each date and entity, on a dense grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def densify(facts: DataFrame, dates: DataFrame, entities: DataFrame) -> DataFrame:
    """facts on the grid of dates (date) and entities (stock, and what belongs to it); adds t, the number of the date from 0.

    The calendar, a date a row whatever the facts, becomes one sorted array, which each entity unfolds in its own task.
    """
    calendar = dates.agg(F.sort_array(F.collect_set("date")).alias("_dates"))  # one row
    grid = entities.join(F.broadcast(calendar)).select(*entities.columns, F.posexplode("_dates").alias("t", "date"))
    return grid.select(*entities.columns, "date", "t").join(facts, ["date", "stock"], "left")


def weekly_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of unit prices by brand: open, high, low, close, volume, amount, vwap, close_raw, shares; industry by brand number."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("stock"))
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.date_trunc("week", "l_shipdate").cast("date"))
    u = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("date", "stock", u.alias("u"), "l_quantity", "l_extendedprice", "l_tax", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("k"))
    facts = rows.groupBy("date", "stock").agg(
        F.min_by("u", "k").alias("open"), F.max("u").alias("high"), F.min("u").alias("low"), F.max_by("u", "k").alias("close"),
        F.round(F.sum("l_quantity"), 2).alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.round(F.avg("l_tax"), 6).alias("tax"),
    )
    facts = facts.withColumn("vwap", F.col("amount") / F.col("volume")).withColumn("close_raw", F.col("close") / (F.col("tax") + 1))
    brands = parts.select("stock").distinct().withColumn("industry", F.regexp_extract("stock", r"(\d+)$", 1).cast("int") % 5)
    brands = brands.withColumn("shares", (F.regexp_extract("stock", r"(\d+)$", 1).cast("int") * 1000 + 7).cast("double"))
    return densify(facts, lines.select("date").distinct(), brands)


PANEL_SQL = r"""
lines AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, p_brand AS stock, l_extendedprice / l_quantity AS u, l_quantity, l_extendedprice, l_tax,
                 row(l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
facts AS (SELECT date, stock, arg_min(u, k) AS open, max(u) AS high, min(u) AS low, arg_max(u, k) AS close,
                 round(sum(l_quantity), 2) AS volume, round(sum(l_extendedprice), 2) AS amount, round(avg(l_tax), 6) AS tax FROM lines GROUP BY date, stock),
brands AS (SELECT DISTINCT p_brand AS stock, regexp_extract(p_brand, '(\d+)$', 1)::INT % 5 AS industry, (regexp_extract(p_brand, '(\d+)$', 1)::INT * 1000 + 7)::DOUBLE AS shares FROM part),
dates AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM lines)),
panel AS (SELECT d.date, d.t, b.stock, b.industry, b.shares, open, high, low, close, volume, amount, tax, amount / volume AS vwap, close / (tax + 1) AS close_raw
          FROM brands b CROSS JOIN dates d LEFT JOIN facts f ON f.date = d.date AND f.stock = b.stock)
"""
