"""Session helpers: the folder that all executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Bytes of input for each file of an intermediate table.
FILE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where one machine is all there is, a temporary folder if it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the engine may be gone
        _remove(spark, path)


class Scratch:
    """Tables in a folder of their own under the shared folder, removed at the end of a with block. What outlives it is checkpointed.

    inputs: what the tables are made of. A table has no more files than its inputs' size calls for, and at least two for each core:
    small tables in hundreds of files cost more in file operations than in work.
    """

    def __init__(self, spark: SparkSession, *inputs: DataFrame):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark)}/strandline-{uuid.uuid4().hex}"
        size = sum(int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for x in inputs)
        self.files = max(2 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)) if inputs else None

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def packed(self, df: DataFrame) -> DataFrame:
        """df in no more partitions than a table has files."""
        return df.coalesce(self.files) if self.files else df

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back: lineage ends here and a lost executor costs nothing that was done before."""
        self.packed(df).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        _remove(self.spark, f"{self.path}/{name}".rstrip("/"))

    def keep(self, df: DataFrame) -> DataFrame:
        """A checkpoint of df, which outlives the tables. Spark removes it when nothing refers to it, if its cleaner is set to; else it
        goes when the application ends."""
        shared_folder(self.spark)
        out = self.packed(df).checkpoint()
        if self.spark.conf.get("spark.cleaner.referenceTracking.cleanCheckpoints", "false") != "true":
            file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
            if file.isDefined():
                atexit.register(_remove_at_exit, self.spark, file.get())
        return out


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has no more rows than the bound under which it may be broadcast."""
    return df.limit(rows + 1).count() <= rows
