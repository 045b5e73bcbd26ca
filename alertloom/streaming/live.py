"""Streaming jobs: parsed alerts by date, quarantine, hourly counts, escalation timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed, text
from ..functions.times import to_us
from ..operators import classify, enrich, parse
from ..operators.stats import CLASS_COLS
from ..sources import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def enrich_stream(lines: DataFrame, as_of, device: DataFrame, iface: DataFrame, as_dim: DataFrame) -> DataFrame:
    """P1-P10 on a stream of ``seq, raw``. ``as_of`` may be a Column with each row's ingest time, so
    that a replay after New Year infers the same years."""
    rows = enrich.enrich(classify.classify(parse.parse(lines, as_of)), device, iface, as_dim)
    return enrich.with_recovery(rows.withColumn("us", to_us(F.col("timestamp"))))


def write_alert_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                       source: str = "alerts") -> StreamingQuery:
    """Add each micro-batch to the alert table, in the layout of ``sinks.write_alerts``.

    A micro-batch commits under ``source`` and its number, so one that runs again after a failure adds nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        table.append(batch.sparkSession, batch, path, source=source, batch=number)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def hourly_stream(rows: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A5 on a stream: final counts per device and hour once the watermark has passed the hour."""
    cls = F.col("classification")
    ts = F.timestamp_micros("us")
    return (
        rows.withColumn("event_time", ts).withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 hour"), "device_name")
        .agg(*[F.count_if(cls == c).alias(f"{n}_count") for c, n in CLASS_COLS.items()])
        .select("device_name", F.col("window.start").cast("timestamp_ntz").alias("hour"),
                *[f"{n}_count" for n in CLASS_COLS.values()])
    )


class EscalationTimer(StatefulProcessor):
    """N8 per (device, mnemonic, discriminator): a tracked alert that nothing ends within the delay."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracked = handle.getValueState("tracked", "seq bigint, us bigint")

    def _stop(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.tracked.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"])
        fired = []
        current = tuple(self.tracked.get()) if self.tracked.exists() else None
        for seq, us, what in zip(pdf["seq"].tolist(), pdf["us"].tolist(), pdf["what"].tolist()):
            if current is not None and us // 1000 > current[1] // 1000 + self.delay_ms:
                fired.append(current)
            current = (seq, us) if what == "track" else None
        self._stop()
        if current is not None:
            self.tracked.update(current)
            self.handle.registerTimer(current[1] // 1000 + self.delay_ms)
        yield pd.DataFrame(fired, columns=["seq", "us"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [tuple(self.tracked.get())] if self.tracked.exists() else []
        self.tracked.clear()
        yield pd.DataFrame(rows, columns=["seq", "us"]).astype("int64")

    def close(self) -> None:
        pass


def escalation_stream(events: DataFrame, delay_s: int = fixed.ESCALATION_DELAY, watermark: str = "5 minutes") -> DataFrame:
    """N8 on a stream: alerts whose clock ran out, by event time.

    ``events``: seq, us, device_name, mnemonic, bgp_neighbor, interface_name, what (``track`` or
    ``recover``). Acks and device resolutions reach several keys; send them as one row per key.
    """
    disc = F.coalesce(text.blank_to_null(F.col("bgp_neighbor")), F.col("interface_name"), F.lit(""))
    timed = events.withColumns({"disc": disc, "event_time": F.timestamp_micros("us")}).withWatermark(
        "event_time", watermark)
    return timed.groupBy("device_name", "mnemonic", "disc").transformWithStateInPandas(
        EscalationTimer(delay_s * 1000), "seq bigint, us bigint", "Append", "EventTime")


def alert_table(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The alerts that batches and streams wrote to ``path``, of the event dates from ``start`` to ``end`` if given."""
    return table.read(spark, path, start, end)
