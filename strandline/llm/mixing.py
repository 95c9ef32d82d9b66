"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash of its id. Sizes are summed by source and leading hash bits; prefix sums of that histogram show in which bucket
the budget of a source ends. Only the rows of that boundary bucket are summed again by the next bits, and so on, until the boundary
holds rows of a single hash. What lies below the threshold is taken: a filter, no sort of the rows.

Null ids share one hash; rows of equal id have equal hashes and are taken together. A null source is a source. Empty and null texts have
size 0 and are taken 0 words of; very long texts are counted as they stand, within a task. An empty table gives an empty result. Extra
columns are not read. Sources have a row each in one sorted window: their number is that of sources, not of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import Scratch, small

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits by which each histogram level refines the one before.
HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of matches of WORDS; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(5, 2, 1)) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target.

    The weights repeat over the sources in code-point order, null last. All targets sum to share times all sizes; no target is above cap
    times its source's size, and what a capped source leaves is shared among the others by weight until none is above. That is the level
    t for which the sum of min(weight * t, cap * size) is the budget, found from prefix sums over cap * size / weight.
    """
    alone = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    rank = (F.row_number().over(alone) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * cap)
    by_fill = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("ceiling"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("ceiling") / F.col("weight"), "level"))).over(every)["level"]
    return free.select("source", "source_size", F.when(first.isNull(), F.col("ceiling")).otherwise(F.least(first * F.col("weight"), "ceiling")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep=(), **how) -> DataFrame:
    """A row for each row of docs: key, size, source_size, target, taken (words the mix takes, repeats counted).

    A document is taken as many whole times as the target holds its source, at most twice here, and those below the hash threshold once
    more. The row at the threshold is taken where that comes nearer to the target. keep: columns of docs that are carried along.
    """
    with Scratch(docs.sparkSession, docs) as scratch:
        return scratch.keep(_mixed(docs, scratch, key, text, source, keep, how))


def _mixed(docs: DataFrame, scratch: Scratch, key: str, text: str, source: str, keep, how: dict) -> DataFrame:
    sized = [F.col(key).alias("k"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key)).alias("h")]
    rows = scratch.table(docs.select(*sized), "rows")
    totals = scratch.table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "sources")
    few = small(totals, BROADCAST_SOURCES)
    hint = F.broadcast if few else (lambda df: df)

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return left.join(hint(right.withColumnRenamed("source", "s")), left["source"].eqNullSafe(F.col("s")), how).drop("s")

    # below: words under the threshold so far; prefix: the leading bits of the boundary bucket
    edge = totals.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        left = HASH_BITS - level * LEVEL_BITS
        inside = joined(rows.filter("size > 0"), edge).filter(F.shiftright("h", left + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = buckets.withColumn("end", F.col("below") + F.sum("words").over(by)).filter("end > rest")
        edge = scratch.table(
            upto.groupBy("source").agg(F.min(F.struct("bucket", "end", "words", "rest", "least", "most")).alias("b")).select("source", "b.rest", F.col("b.bucket").alias("prefix"), (F.col("b.end") - F.col("b.words")).alias("below"), F.col("b.words").alias("words"), F.col("b.least").alias("least"), F.col("b.most").alias("most")),
            f"edge{level}",
        )
        if not edge.filter("least < most").head(1):
            break
    # rows under `least` are taken once more, and those at it if that is nearer
    threshold = edge.select("source", F.when(F.col("words") <= 2 * (F.col("rest") - F.col("below")), F.col("most")).otherwise(F.col("least") - 1).alias("last"))
    plan = totals.join(hint(threshold.withColumnRenamed("source", "s")), totals["source"].eqNullSafe(F.col("s")), "left").drop("s")
    plan = scratch.table(plan.select("source", "source_size", "target", "epochs", F.when(F.col("last").isNotNull(), F.col("last")).when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(-1)).cast("long").alias("last")), "plan")
    # carried columns, such as texts, are read again with their rows rather than written twice
    out = joined(docs.select(*sized, F.struct(*keep).alias("carried")) if keep else rows, plan)
    taken = (F.col("size") * (F.col("epochs") + (F.col("h") <= F.col("last")).cast("long"))).alias("taken")
    return out.select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken, *([F.col("carried")[c].alias(c) for c in keep]))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS ceiling FROM t),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT arg_min(level, ceiling / weight) AS level FROM l WHERE level * weight <= ceiling),
p AS (SELECT l.source, l.source_size, CASE WHEN g.level IS NULL THEN l.ceiling ELSE least(g.level * l.weight, l.ceiling) END AS target FROM l, g),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM p),
c AS (SELECT d.*, q.source_size, q.target, q.epochs, q.target - q.epochs * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND own <= 2 * (rest - (upto - own)))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
