"""Corpus cleaning pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it again, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, classifier, decontamination, line_dedup, near_dup
from quarry.llm.common import table, written
from quarry.session import ship_package


BATCH_ROWS = 1000  # rows of an Arrow batch: what a Python worker holds of the texts at once


def prepared(spark: SparkSession) -> None:
    """Package on the workers, and Arrow batches that keep long texts within a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label model rejects; the others stay as they are.

    NULL texts and texts without a word score 0 and go; equal texts share one verdict.
    """
    prepared(spark)
    return classifier.keep_good(docs)


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that stand on many sites; every document stays, n_chars follows its text."""
    prepared(spark)
    out = line_dedup.remove_boilerplate(docs)
    n_chars = F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).drop("__n_lines", "__n_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the least doc_id.

    Texts without words all stay, but equal rows of them become one; of repeated rows one stays.
    """
    prepared(spark)
    return near_dup.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; NULL and empty texts hold none and stay."""
    prepared(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the kept texts and decodes the ids: doc_id, n_tokens, digests, exact."""
    prepared(spark)
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", boilerplate_lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", tokens),
]

# The classifier and the alignment have no SQL form: tests/llm/test_pipeline.py checks each stage on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
