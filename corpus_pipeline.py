"""From raw documents to token ids: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertloom.llm import bpe, decontaminate, quality, secrets, simhash
from alertloom.llm.tables import materialize, read


#: Rows of a batch that goes to Python. A row is a whole document, so Spark's default of 10 000 rows is tens of MB
#: in the JVM and again in each worker.
BATCH_ROWS = 1000
#: Bytes of a batch that goes to Python: long texts and rows of the index make batches of fewer rows.
BATCH_BYTES = 2 << 20
#: Bytes of text in a run of the last stage, whose executors hold the memory that the stages before took.
RUN_BYTES = 4 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a calibrated rule rejects go. The session's batches hold BATCH_ROWS and BATCH_BYTES from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return quality.keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    return secrets.masked(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids."""
    return bpe.encode(docs, run_bytes=RUN_BYTES)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("encoding", encoding),
]

#: SimHash components and BPE merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
