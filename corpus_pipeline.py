"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, mixture.

Each stage takes all that the one before kept and returns a DataFrame, which run() writes as Parquet and reads again. All but the last
return the columns of documents. Rows that a stage keeps are unchanged but for the text and n_chars of documents that lose repeated
passages. Null and empty texts pass every stage but the first, which judges them by their statistics.

Each row is judged by its own text, whatever its doc_id: ids may be null or repeated. Of a group of near duplicates the smallest id
stays, null ids last, and of several texts with that id the one with the smaller hash. Rows that repeat id and text are one document, of
which near_dedup keeps the row with the smallest other columns; texts without words are linked with nothing, and those of null ids are
documents each. Very long texts pass whole through every stage. The last stage returns doc_id, source, size, source_size, target, taken,
text, lang and n_chars. Equality of texts rests on 128 bits of SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._spark import Scratch, small
from strandline.llm.decontaminate import find_contamination
from strandline.llm.mixing import mix
from strandline.llm.neardup import near_duplicates
from strandline.llm.quality import classify
from strandline.llm.suffix_dedup import find_spans, repeat_marks, with_keys, without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stages are not written in SQL: the first learns trees, the second hashes by bins. Each is tested against its operator and brute force.
ORACLE_SQL = None
#: Documents that score below this are rejected.
LEAST_QUALITY = 0.5
#: Up to so many documents that go are broadcast to the others; beyond, both are shuffled.
BROADCAST_IDS = 1_000_000


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with the hash h of the text, null for null."""
    return docs.select(*COLUMNS, F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("h"))


def _beside(docs: DataFrame, marks: DataFrame, by: list[str], how: str) -> DataFrame:
    """docs joined by these columns, in which nulls are equal, with marks, whose columns they are."""
    marks = F.broadcast(marks) if small(marks, BROADCAST_IDS) else marks
    marks = marks.withColumnsRenamed({c: f"_{c}" for c in by})
    on = [docs[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    return docs.join(marks, on, how).drop(*(f"_{c}" for c in by))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    with Scratch(spark, docs) as scratch:
        rows = _hashed(docs)
        scores = classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch, keep=("h",))
        gone = scratch.keep(scores.filter(F.col("score") < LEAST_QUALITY).select("h").distinct())
        return scratch.packed(_beside(rows, gone, ["h"], "left_anti").select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the document of the smallest id stays."""
    with Scratch(spark, docs) as scratch:
        if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("many")).filter("many > 1 or doc_id is null").head(1):
            return _near_dedup_of_odd_ids(docs, scratch)
        found = near_duplicates(docs, scratch).filter("n_shingles > 0 and doc_id <> component_id")
        gone = scratch.keep(found.select("doc_id"))
        return scratch.packed(_beside(docs.select(*COLUMNS), gone, ["doc_id"], "left_anti"))


def _near_dedup_of_odd_ids(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """near_dedup where ids are null or repeat: rows have numbers of their own."""
    rows = scratch.table(_hashed(docs).select("doc_id", "text", "h", F.monotonically_increasing_id().alias("row")), "rows")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), scratch).withColumnRenamed("doc_id", "row")
    words = F.col("n_shingles") > 0
    found = found.join(rows.select("row", "doc_id", "h"), "row").filter(words | F.col("doc_id").isNotNull())
    pairs = scratch.table(found.groupBy("doc_id", "h", F.when(words, F.col("component_id")).alias("group")).agg(F.count(F.lit(1)).alias("many")), "pairs")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    linked = pairs.filter("group is not null")
    least = linked.groupBy("group").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    least = F.broadcast(least) if small(least, BROADCAST_IDS) else least  # a shuffle by group would gather the largest one
    gone = linked.join(least, "group").filter(~rank.eqNullSafe(F.col("least"))).select("doc_id", "h", F.lit(False).alias("again"))
    # the decision on a pair of id and text: it goes, or one of its rows stays
    marks = gone.unionAll(pairs.filter("many > 1").select("doc_id", "h", F.lit(True).alias("again"))).groupBy("doc_id", "h").agg(F.min("again").alias("again"))
    marks = scratch.keep(marks)
    rows = _hashed(docs)
    if not marks.filter("again").head(1):
        return scratch.packed(_beside(rows, marks, ["doc_id", "h"], "left_anti").select(*COLUMNS))
    rows = _beside(rows, marks, ["doc_id", "h"], "left")
    one = rows.filter("again").groupBy("doc_id", "h").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))
    return scratch.packed(rows.filter("again is null").select(*COLUMNS).unionAll(one.select("doc_id", *(f"r.{c}" for c in COLUMNS[1:]))))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out of the texts; a document of which nothing is left goes."""
    with Scratch(spark, docs) as scratch:
        texts, base = with_keys(docs, scratch)
        marks = scratch.keep(repeat_marks(base, find_spans(texts, scratch)))
        return scratch.packed(without_repeats(docs, marks))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    with Scratch(spark, docs) as scratch:
        rows = _hashed(docs)
        hits = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch, keep=("h",))
        gone = scratch.keep(hits.filter("n_hit > 0").select("h").distinct())
        return scratch.packed(_beside(rows, gone, ["h"], "left_anti").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, beside its text; documents of which it takes none go."""
    return mix(docs, keep=("text", "lang", "n_chars")).filter("taken > 0")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontaminate", decontaminate), ("mixture", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    with Scratch(spark, docs) as scratch:
        for name, stage in STAGES:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return scratch.keep(docs)
