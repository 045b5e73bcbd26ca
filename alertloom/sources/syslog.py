"""Raw lines, export envelopes, restart anchor and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LINE_SCHEMA = "value string"
_TAIL = "struct<streams:array<struct<values:array<array<string>>>>>"
_RANGE = "struct<data:struct<result:array<struct<values:array<array<string>>>>>>"


def clean_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Strip trailing line breaks, drop empty lines."""
    return df.withColumn(raw, F.rtrim(F.col(raw), F.lit("\n\r"))).where(F.col(raw) != "")


def read_syslog(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Lines of text files (or a parquet table with ``raw``) as ``raw`` plus the file they are from."""
    if fmt == "text":
        df = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    else:
        df = spark.read.format(fmt).load(path)
    return clean_lines(df)


def explode_loki_export(df: DataFrame, body: str = "value") -> DataFrame:
    """``ts_ns, line`` of both JSON envelopes; empty lines and undecodable JSON give no rows.

    Rows keep the other columns of ``df``. Order by ``ts_ns`` where order matters: a DataFrame has
    none of its own.
    """
    tail = F.from_json(body, _TAIL)["streams"]
    rng = F.from_json(body, _RANGE)["data"]["result"]
    values = F.flatten(F.transform(F.coalesce(tail, rng), lambda s: F.coalesce(s["values"], F.array().cast("array<array<string>>"))))
    rest = [c for c in df.columns if c != body]
    pairs = df.select(*rest, F.explode(values).alias("_v"))
    return (
        pairs.where(F.size("_v") >= 2)
        .select(*rest, F.get("_v", F.lit(0)).try_cast("bigint").alias("ts_ns"), F.get("_v", F.lit(1)).alias("line"))
        .where("line <> ''")
    )


def distinct_entries(entries: DataFrame) -> DataFrame:
    """S3 in batch: an entry read again at a page boundary is delivered once."""
    return entries.dropDuplicates(["ts_ns", "line"])


def resume_point(alerts: DataFrame) -> DataFrame:
    """Newest stored timestamp."""
    return alerts.agg(F.max("timestamp").alias("resume_from"))


def backfill(parsed: DataFrame, failed: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts by outcome).

    ``parsed`` are enriched rows of the missed range with ``seq``; a row is skipped when its
    (device, mnemonic, timestamp) is stored already or came earlier in the range. ``failed`` are the
    quarantined lines.
    """
    key = ["device_name", "mnemonic", "timestamp"]
    first = parsed.groupBy(*key).agg(F.min("seq").alias("seq"))
    new = first.join(alerts.select(*key), key, "left_anti")
    rows = parsed.join(new.select("seq"), "seq", "left_semi")
    total = parsed.agg(F.count("*").alias("n"))
    inserted = new.agg(F.count("*").alias("n"))
    skipped = total.select((F.col("n") - inserted.scalar()).alias("n"))
    counts = (
        inserted.select(F.lit("inserted").alias("outcome"), "n")
        .unionByName(skipped.select(F.lit("skipped").alias("outcome"), "n"))
        .unionByName(failed.agg(F.count("*").alias("n")).select(F.lit("failed").alias("outcome"), "n"))
    )
    return rows, counts
