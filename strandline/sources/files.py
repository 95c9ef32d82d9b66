"""File sources and sinks with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the columns of an industry file, in order
INDUSTRY_COLUMNS = ("TradingDay", "StockCode", "StockName", "SWCode1", "SWName1", "SWCode2", "SWName2", "SWCode3", "SWName3")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of one table; columns are matched by name, absent ones are missing."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_industry_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, in the contract's order, and the name of each row's file. A header that differs fails the read."""
    schema = ", ".join(f"{c} string" for c in INDUSTRY_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    return rows.select(*INDUSTRY_COLUMNS, F.col("_metadata.file_name").alias("file"))


def read_jsonl(spark: SparkSession, path: str, schema: str, first: int | None = None) -> DataFrame:
    """Records of a strict schema; a broken line fails the read. first: only records whose `request_index` is below it."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if first is None else rows.filter(F.col("request_index") < first)


def read_jsonl_prefix(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first n lines of a log, in their order, as records of a strict schema. Later lines, which may still be written, are not parsed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    first = lines.orderBy("_f", "_s", "_i").limit(n)  # numbers ascend within a block
    return first.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_until(spark: SparkSession, path: str, date: str, end) -> DataFrame:
    """Rows up to a date: later row groups are skipped by their statistics, so that test data are not read before their time."""
    return spark.read.parquet(path).filter(F.col(date) <= F.lit(end))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One record a line, keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, order: list[str], partition: list[str] | None = None) -> None:
    """Compressed Parquet, sorted within files; the commit protocol makes it appear whole."""
    out = df.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(*partition) if partition else out).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], spark: SparkSession) -> int:
    """Appends rows whose keys the table doesn't have yet; how many."""
    try:
        old = spark.read.parquet(path).select(*keys)
        df = df.join(old, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df = df.dropDuplicates(keys)
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    return n


def consolidate(parts: DataFrame, path: str, keys: list[str], values: list[str], rows_per_group: int = 500_000) -> None:
    """Parts of one table as one: rows of a key must agree, one of them stays, sorted by key, compressed, in row groups of bounded size.

    A table that is there is replaced only after the new one is written whole beside it.
    """
    if parts.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n")).filter("n > 1").head(1):
        raise ValueError("rows of one key disagree")
    beside = f"{path.rstrip('/')}.new"
    parts.dropDuplicates(keys).orderBy(*keys).write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).parquet(beside)
    spark = parts.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    system = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{beside} could not be renamed")


def industry_files(spark: SparkSession, path: str) -> DataFrame:
    """file and date of each file of a folder; a file whose name has no date, or one date in two files, is an error."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"))
    out = names.select("file", F.try_to_date(F.regexp_extract("file", r"(\d{8})\.csv$", 1), "yyyyMMdd").alias("date"))
    bad = out.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or date is null").head(1)
    if bad:
        raise ValueError("a file has no date in its name" if bad[0]["date"] is None else f"several files of {bad[0]['date']}")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A small table as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
