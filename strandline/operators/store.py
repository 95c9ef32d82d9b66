"""Stored results of evaluations: a table keyed by candidate and context, a ledger of conflicts, and a run that can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Of a set of rows, whatever their order: their number, and a sum and an exclusive or of their hashes."""
    h = F.xxhash64(*[df[c] for c in sorted(df.columns)])
    row = df.select(h.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).head()
    return ":".join(str(x) for x in row)


class ResultStore:
    """Results are inserted once and never changed: rows (hash, context, digest, and what schema adds) in path/results.

    A result of a key that is there with another digest goes to path/conflicts instead.
    """

    KEYS = ("hash", "context")

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"hash string, context string, digest string, {schema}"
        for name in ("results", "conflicts"):
            spark.createDataFrame([], self.schema).write.mode("append").parquet(f"{path}/{name}")

    def results(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/results")

    def conflicts(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/conflicts")

    def lookup(self, candidates: DataFrame, context: str) -> DataFrame:
        """The stored results of candidates (hash) in a context."""
        return self.results().filter(F.col("context") == context).join(candidates.select("hash").distinct(), "hash", "left_semi")

    def pending(self, candidates: DataFrame, context: str) -> DataFrame:
        """Candidates without a stored result."""
        return candidates.join(self.results().filter(F.col("context") == context).select("hash"), "hash", "left_anti")

    def insert(self, new: DataFrame) -> None:
        """new: hash, context, the columns of the schema; digest is added. Equal results again are no news."""
        values = [c for c in self.results().columns if c not in (*self.KEYS, "digest")]
        rows = new.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(values)), {"ignoreNullFields": "false"}), 256)).select(*self.results().columns)
        rows = rows.dropDuplicates([*self.KEYS, "digest"]).persist()
        old = self.results().select(*self.KEYS, F.col("digest").alias("_old"))
        # of several results of a new key the one with the smallest digest is stored
        least = rows.groupBy(*self.KEYS).agg(F.min("digest").alias("_least"))
        judged = rows.join(old, list(self.KEYS), "left").join(least, list(self.KEYS))
        fresh = judged.filter(F.col("_old").isNull() & (F.col("digest") == F.col("_least")))
        differs = judged.filter(F.coalesce(F.col("digest") != F.col("_old"), F.col("digest") != F.col("_least")))
        differs = differs.join(self.conflicts().select(*self.KEYS, "digest"), [*self.KEYS, "digest"], "left_anti").persist()
        differs.count()  # judged before the results grow
        fresh.select(*rows.columns).write.mode("append").parquet(f"{self.path}/results")
        differs.select(*rows.columns).write.mode("append").parquet(f"{self.path}/conflicts")
        rows.unpersist()
        differs.unpersist()

    def run(self, candidates: DataFrame, context: str, evaluate: Callable[[DataFrame], DataFrame], batch: int = 1000, order: str = "hash") -> DataFrame:
        """Evaluates what is pending, a batch of candidates at a time, and stores each batch: a run that was stopped goes on where it was.

        evaluate: candidates to hash and the columns of the schema. Returns hash and state of every candidate: completed, or failed if
        its evaluation gave no row.
        """
        todo = self.pending(candidates, context).orderBy(order)
        names = [r["hash"] for r in todo.select("hash").toLocalIterator()]  # of expressions tried
        for lo in range(0, len(names), batch):
            some = self.spark.createDataFrame([(h,) for h in names[lo : lo + batch]], "hash string")
            self.insert(evaluate(candidates.join(some, "hash", "left_semi")).withColumn("context", F.lit(context)))
        done = self.lookup(candidates, context).select("hash", F.lit("completed").alias("state"))
        return candidates.select("hash").distinct().join(done, "hash", "left").withColumn("state", F.coalesce("state", F.lit("failed")))


def freeze_pool(ranked: DataFrame, path: str, k: int = 100) -> dict:
    """The first k candidates by rank as a table sorted by it, and a manifest with its fingerprint, which verify_pool() compares."""
    pool = ranked.orderBy("rank").limit(k)
    pool.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").parquet(f"{path}/pool")
    spark = ranked.sparkSession
    stored = spark.read.parquet(f"{path}/pool")
    manifest = {"rows": stored.count(), "fingerprint": fingerprint(stored), "columns": ",".join(sorted(stored.columns))}
    spark.createDataFrame([manifest]).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def verify_pool(spark: SparkSession, path: str) -> DataFrame:
    """The frozen pool, if it is what its manifest says."""
    pool, manifest = spark.read.parquet(f"{path}/pool"), spark.read.json(f"{path}/manifest").head()
    if manifest is None or manifest["fingerprint"] != fingerprint(pool):
        raise ValueError("the pool differs from its manifest")
    return pool
