"""S3: incremental ingest of export files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from ..sources import table
from ..sources.syslog import explode_loki_export


def ingest_stream(spark: SparkSession, path: str, horizon: str = "10 minutes", fmt: str = "text",
                  max_files: int | None = None) -> DataFrame:
    """Streaming ``ts_ns, ts, line``; an entry read again within ``horizon`` is delivered once.

    The checkpoint of the query that consumes this is the restart anchor. Repeats are tracked per
    (ts_ns, line), so the state is spread over all partitions however uneven the sources are. Spark drops what comes
    behind the watermark; :func:`run_ingest` keeps it.
    """
    return entries(spark, path, fmt, max_files).withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["ts_ns", "line"])


def entries(spark: SparkSession, path: str, fmt: str = "text", max_files: int | None = None) -> DataFrame:
    """Streaming ``ts_ns, line, ts`` of export files, as they come."""
    reader = spark.readStream.format(fmt).schema("value string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ts = F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000).cast("bigint")))
    return explode_loki_export(reader.load(path)).withColumn("ts", ts)


def _batch_writer(path: str, late_path: str, horizon_us: int, source: str):
    """foreachBatch: entries of a micro-batch into the table, those behind the watermark into the late one.

    The watermark of a batch is the newest time of all batches before it less the horizon; it is kept with the batch's
    commit, so a batch that runs again decides the same. An entry that one of the tables has already is left out; only
    their dates that the batch can meet are read.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = table.version(spark, path)
        if now.done(source, number):
            return
        before = now.sources.get(source, {}).get("newest")
        mark = None if before is None else before - horizon_us
        rows = materialize(batch.dropDuplicates(["ts_ns", "line"]).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "ingest")
        span = rows.agg(F.max("us").alias("z")).first()
        newest = max([x for x in (span["z"], before) if x is not None], default=None)
        behind = F.col("us").isNull() if mark is None else F.col("us").isNull() | (F.col("us") <= mark)
        for late, target in ((True, late_path), (False, path)):
            own = rows.where(behind if late else ~behind)
            # A late entry may have been on time, or late, before; one on time can only be among those after the mark.
            known = table.version(spark, path), table.version(spark, late_path)
            if late:
                dates = {str(r[0]) if r[0] else table.NO_DATE for r in own.select(F.to_date("ts")).distinct().collect()}
                seen = [table.read_version(spark, v, dates=dates) for v in known if v.schema is not None]
            else:
                since = None if mark is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=mark)
                seen = [table.read_version(spark, v, since) for v in known[:1] if v.schema is not None]
            for old in seen:
                own = _without(own, old)
            table.append(spark, own.drop("us"), target, "ts", source, number, {"newest": newest})

    return write


def _without(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose (ts_ns, line) ``known`` lacks; NULL equals NULL."""
    k = known.select(F.col("ts_ns").alias("_ns"), F.col("line").alias("_line")).distinct()
    return rows.join(k, F.col("ts_ns").eqNullSafe(F.col("_ns")) & (F.col("line") == F.col("_line")), "left_anti")


def run_ingest(spark: SparkSession, path: str, out: str, checkpoint: str, horizon: str = "10 minutes", late: str | None = None,
               max_files: int | None = None, source: str = "ingest") -> None:
    """Read what is there, add the new entries to the table ``out`` and those that came late to ``late``, and stop.

    Late is an entry that is ``horizon`` or more older than the newest of all micro-batches before its own, or has no
    time. Both tables are by event date (:mod:`alertloom.sources.table`) with ``ts_ns, line, ts``; together they hold
    every distinct entry once, whatever the order of arrival. ``late`` is ``out`` with ``-late`` unless given.
    """
    us = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01' + INTERVAL {horizon}) AS us").first()["us"]
    write = _batch_writer(out, late or f"{out.rstrip('/')}-late", us, source)
    q = entries(spark, path, "text", max_files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    q.awaitTermination()
