"""Alert rows, writes by event date, CSV export and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.times import as_datetime, in_period, ntz
from . import table

ALERT_COLUMNS = [
    "timestamp", "source_ip", "device_name", "hostname", "rp_location", "facility", "subfacility",
    "severity_level", "mnemonic", "message", "raw", "classification", "interface_name",
    "interface_description", "client_name", "bgp_neighbor", "as_number", "as_name", "incident_id",
    "notification_sent",
]


def alert_rows(df: DataFrame) -> DataFrame:
    """S5 row build: stored columns of routed events (``to_store``), absent AS as 0."""
    return df.where("to_store").withColumns({
        "as_number": F.coalesce("as_number", F.lit(0)), "incident_id": F.coalesce("incident_id", F.lit("")),
    }).select(F.col("seq").alias("alert_id"), *ALERT_COLUMNS)


def write_alerts(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append in one commit, one folder per event date (see :mod:`.table`). Rebalancing splits a busy date over
    many tasks and joins quiet ones, by measured size."""
    table.append(df.sparkSession, df, path, ts)


def replace_dates(spark: SparkSession, df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Replace the dates that ``df`` touches. Their old folders go, so readers of older versions must be done."""
    table.replace_dates(spark, df, path, ts=ts)
    table.vacuum(spark, path)


def export_view(alerts: DataFrame, period: str, as_of, limit: int | None = None) -> DataFrame:
    """S7 rows: the alerts of a period, or its newest ``limit``, with the nine export columns as text."""
    newest = in_period(alerts, period, as_of).orderBy(F.desc("timestamp"), F.desc("alert_id"))
    newest = newest if limit is None else newest.limit(limit)
    micro = F.extract(F.lit("SECOND"), F.col("timestamp")) % 1 != 0
    iso = F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
                   F.when(micro, F.date_format("timestamp", ".SSSSSS")).otherwise(""))
    return newest.select(
        F.coalesce(iso, F.lit("")).alias("timestamp"), F.col("device_name").alias("device"), "mnemonic",
        "classification", "message", F.col("interface_name").alias("interface"),
        F.col("client_name").alias("client"), "as_name", F.coalesce("incident_id", F.lit("")).alias("incident_id"),
    )


def export_alerts_csv(alerts: DataFrame, path: str, period: str, as_of, limit: int | None = None) -> None:
    """Write the export as CSV with a header; quotes are doubled as CSV readers expect."""
    export_view(alerts, period, as_of, limit).write.mode("overwrite").option("header", True).option(
        "escape", '"').option("emptyValue", "").csv(path)


def prune(df: DataFrame, ts: str, days: int, as_of, offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    """Rows that stay. The original cuts local face values at the UTC clock and so keeps
    ``offset_hours`` more; pass 0 for an exact local cut."""
    cutoff = ntz(as_of) - F.expr(f"INTERVAL '{offset_hours}' HOUR") - F.expr(f"INTERVAL '{days}' DAY")
    return df.where(F.col(ts) >= cutoff)


def prune_alerts(alerts: DataFrame, days: int, as_of, offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    return prune(alerts, "timestamp", days, as_of, offset_hours)


def prune_hourly(stats: DataFrame, as_of, days: int = 365, offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    return prune(stats, "hour", days, as_of, offset_hours)


def prune_alert_table(spark: SparkSession, path: str, days: int, as_of,
                      offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> None:
    """S9 on a date-partitioned table, whether a batch or a stream wrote it: whole older dates are dropped unread, only
    the boundary date is rewritten. A folder without a table stays; one with Parquet files but no commits is refused."""
    if table.version(spark, path).number < 0:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop.Path(path)) and fs.listStatus(hadoop.Path(path)):
            raise ValueError(f"{path} holds files but no commits; write it with write_alerts or write_alert_stream")
        return
    table.prune(spark, path, as_datetime(as_of) - dt.timedelta(hours=offset_hours, days=days))
    table.vacuum(spark, path)
