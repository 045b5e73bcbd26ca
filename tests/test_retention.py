"""Retention and state rules on ordinary tables."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from alertloom.operators import stats
from alertloom.sources import sinks


def days_left(spark, path):
    return sorted(int(n[-2:]) for n in os.listdir(path) if n.startswith("event_date="))


@pytest.mark.parametrize("days, left", [
    ([1, 2, 20, 21], [20, 21]),         # no folder of the boundary date
    ([14, 15, 20], [20]),               # all rows of the boundary date are too old
    ([16, 17], [16, 17]),               # nothing to drop
])
def test_prune_table(spark, days, left):
    path = os.path.join(tempfile.mkdtemp(), "alerts")
    rows = [(i, dt.datetime(2024, 1, d, 3)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "alert_id long, timestamp timestamp_ntz")
    sinks.write_alerts(df, path)
    sinks.prune_alert_table(spark, path, 5, "2024-01-20 12:00:00", offset_hours=0)
    assert days_left(spark, path) == left
    assert spark.read.parquet(path).count() == len(left)


def test_prune_keeps_the_rest_of_the_boundary(spark):
    path = os.path.join(tempfile.mkdtemp(), "alerts")
    rows = [(1, dt.datetime(2024, 1, 15, 3)), (2, dt.datetime(2024, 1, 15, 20)), (3, dt.datetime(2024, 1, 1))]
    sinks.write_alerts(spark.createDataFrame(rows, "alert_id long, timestamp timestamp_ntz"), path)
    sinks.prune_alert_table(spark, path, 5, "2024-01-20 12:00:00", offset_hours=0)
    assert [r["alert_id"] for r in spark.read.parquet(path).collect()] == [2]


def test_prune_without_a_table(spark):
    path = tempfile.mkdtemp()
    sinks.prune_alert_table(spark, path, 5, "2024-01-20 12:00:00")
    sinks.prune_alert_table(spark, os.path.join(path, "none"), 5, "2024-01-20 12:00:00")


def test_health_counts_peers_that_stay_down(spark):
    at = dt.datetime(2024, 1, 1)
    say = lambda i, m, text, peer: (i, "r1", at + dt.timedelta(minutes=i), "CRITICAL", m, text, peer, "be1")
    rows = [say(1, "ADJCHANGE", "neighbor a Down", "a"), say(2, "ADJCHANGE", "neighbor a Down", "a"), say(3, "ADJCHANGE", "neighbor a Up", "a"),
            say(4, "ADJCHANGE", "neighbor b Down", "b"), say(5, "ACTIVE", "is no longer Active", None), say(6, "ACTIVE", "is Active", None)]
    df = spark.createDataFrame(rows, "alert_id long, device_name string, timestamp timestamp_ntz, classification string, mnemonic string, "
                               "message string, bgp_neighbor string, interface_name string")
    got = stats.health_by_day(df).first()
    assert (got["critical"], got["bgp_down"], got["degraded"]) == (6, 1, 0)


def test_staleness_equals_plain_gaps(spark):
    times = [0, 10, 700, 701, 5000, 5100, 100_000, 400_000]
    df = spark.createDataFrame([(t * 1_000_000,) for t in times], "us long")
    got = sorted((r[0] // 1_000_000, r[1] // 1_000_000 if r[1] is not None else None) for r in stats.staleness(df, 400_100 * 1_000_000, 600).collect())
    assert got == [(a, b) for a, b in zip(times, times[1:]) if b - a > 600]
    assert stats.staleness(df.where(F.lit(False)), 0).count() == 0
