"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A single-process session without one gets a temporary folder; a cluster must name one, as a
    folder of one machine would hide each executor's files from the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="alertloom-llm-")
    return _local[context.applicationId]


def materialize(df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; survives lost executors.

    ``group_bytes`` bounds a row group, which a reader may hold whole; for rows of many KB.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    writer = df.write
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.page.size.row.check.min", "4")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends; its written result is what later ones read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts).cast("bigint"))


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
