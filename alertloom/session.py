"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}


def build_session(app: str = "alertloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Generated methods above 8000 bytes are never compiled by the JVM; fall back before that.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.parquet.compression.codec": "zstd",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A single-process session without one gets a local folder; on a cluster that would hide each
    executor's files from the others, so one must be named.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = tempfile.mkdtemp(prefix="alertloom-")
    return _unset[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The operators with several passes use this to evaluate their input once. A table on shared
    storage survives lost executors and keeps column pruning for the later passes.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by ``key`` over all cores, whatever their splits were."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
