"""Counts, calendars, health, SLA, forecasts and status tables.

Group counts aggregate map-side, so one dominant device or class does not skew a shuffle. Zero
rows come from generated calendars (24 hours, 7 days, 60 minutes), never from the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.times import as_datetime, in_period, ntz, shift_of, shift_start, within
from . import timeline

CLASS_COLS = {c: ("login" if c == "USER_LOGIN" else c.lower()) for c in fixed.CLASSES}


def class_counts() -> list[Column]:
    """One ``count_if`` per fixed class and their total; other classes do not count."""
    cls = F.col("classification")
    return [F.count_if(cls == c).alias(n) for c, n in CLASS_COLS.items()] + [
        F.count_if(cls.isin(fixed.CLASSES)).alias("total")
    ]


def _zero_filled(grid: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    cols = [c for c in counts.columns if c not in on]
    return grid.join(counts, on, "left").select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def counts(alerts: DataFrame, period: str, as_of) -> DataFrame:
    """A1: one row with the five class counts, zero where a class is absent, and their total."""
    return in_period(alerts, period, as_of).agg(*class_counts()).select(
        F.lit(period).alias("period"), "*")


def _day(alerts: DataFrame, date, days: int = 1) -> DataFrame:
    start = as_datetime(f"{date} 00:00:00")
    return within(alerts, start, start + dt.timedelta(days=days))


def _last(alerts: DataFrame, as_of, **span) -> DataFrame:
    return within(alerts, as_datetime(as_of) - dt.timedelta(**span))


def daily_stats(alerts: DataFrame, date: str) -> DataFrame:
    """A2: class counts of one local day."""
    return _day(alerts, date).agg(*class_counts()).select(F.lit(str(date)).alias("date"), "*")


def weekly_stats(alerts: DataFrame, start: str) -> DataFrame:
    """A3: seven days from ``start``, days without alerts included."""
    first = F.to_date(F.lit(str(start)))
    grid = alerts.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.date_add(first, 6))).alias("day"))
    got = _day(alerts, start, 7).groupBy(F.to_date("timestamp").alias("day")).agg(*class_counts())
    return _zero_filled(grid, got, ["day"]).withColumn("day", F.col("day").cast("string"))


def device_stats(alerts: DataFrame, device: str, days: int, as_of) -> DataFrame:
    """A4: class counts of one device over the last ``days`` days, both ends inclusive."""
    end = as_datetime(as_of)
    rows = within(alerts, end - dt.timedelta(days=days), end, closed=True).where(F.col("device_name") == device)
    return rows.agg(*class_counts()).select(F.lit(device).alias("device_name"), "*")


def device_stats_all(alerts: DataFrame, days: int, as_of) -> DataFrame:
    """A4 for every device at once."""
    end = as_datetime(as_of)
    return within(alerts, end - dt.timedelta(days=days), end, closed=True).groupBy("device_name").agg(*class_counts())


def hourly_stats(alerts: DataFrame, as_of, days: int = 7,
                 offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    """A5: per device and hour the five class counts of the last ``days`` days.

    ``as_of`` is local; the original cuts local face values at the UTC clock, so it starts
    ``offset_hours`` earlier. Pass 0 for an exact local cut.
    """
    return (
        _last(alerts, as_of, days=days, hours=offset_hours)
        .groupBy("device_name", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"))
        .agg(*[F.count_if(F.col("classification") == c).alias(f"{n}_count") for c, n in CLASS_COLS.items()])
    )


def upsert_hourly(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """A5 upsert: recomputed buckets replace stored ones, other buckets stay; running it again
    changes nothing."""
    kept = stored.join(recomputed.select("device_name", "hour"), ["device_name", "hour"], "left_anti")
    return kept.unionByName(recomputed)


def hour_of_day(alerts: DataFrame, period: str, as_of) -> DataFrame:
    """24 rows with the five class counts."""
    grid = alerts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    got = in_period(alerts, period, as_of).groupBy(
        F.hour("timestamp").alias("hour")).agg(*class_counts()[:-1])
    return _zero_filled(grid, got, ["hour"])


def top_devices(alerts: DataFrame, period: str, as_of, n: int = 10) -> DataFrame:
    """The ``n`` busiest named devices, ties by name."""
    return (
        in_period(alerts, period, as_of).where(F.col("device_name") != "")
        .groupBy("device_name").agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "device_name").limit(n)
    )


def heatmap(alerts: DataFrame, period: str, as_of) -> DataFrame:
    """7 x 24 cells (Monday = 0) with counts and the largest cell. Only the start applies."""
    if period not in ("7d", "30d", "1y", "all"):
        raise ValueError(f"invalid heatmap period {period!r}")
    grid = alerts.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("day"), (F.col("id") % 24).cast("int").alias("hour"))
    got = in_period(alerts, period, as_of).groupBy(
        F.weekday("timestamp").alias("day"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("cnt"))
    return _zero_filled(grid, got, ["day", "hour"]).withColumn(
        "max_count", F.max("cnt").over(Window.partitionBy()))


def calendar_counts(alerts: DataFrame, fmt: str, name: str) -> DataFrame:
    """Class counts and total per formatted period, plus one ``ALL`` row from a rollup."""
    bucketed = alerts.where(F.col("timestamp").isNotNull()).withColumn(name, F.date_format("timestamp", fmt))
    return bucketed.rollup(name).agg(*class_counts()).withColumn(name, F.coalesce(name, F.lit("ALL")))


def monthly(alerts: DataFrame) -> DataFrame:
    return calendar_counts(alerts, "yyyy-MM", "month")


def yearly(alerts: DataFrame) -> DataFrame:
    return calendar_counts(alerts, "yyyy", "year")


def shift_counts(alerts: DataFrame, cards: DataFrame, as_of) -> DataFrame:
    """A10: counts since the current shift began and the number of unacknowledged cards.

    ``cards`` is the incident card table with ``acknowledged_at``.
    """
    shift = shift_of(ntz(as_of))
    cls = F.col("classification")
    since = within(alerts, shift_start(as_of)).agg(
        *[F.count_if(cls == c).alias(f"{c.lower()}_since_shift") for c in ("CRITICAL", "WARNING", "INFO")])
    unacked = cards.where(F.col("acknowledged_at").isNull()).agg(F.count("*"))
    return since.select(
        shift["name"].alias("shift_name"), shift["start"].alias("shift_start"), shift["end"].alias("shift_end"),
        "*", unacked.scalar().alias("open_incidents"))


def shift_history(alerts: DataFrame) -> DataFrame:
    """A10 for all past shifts."""
    cls = F.col("classification")
    return (
        alerts.withColumn("s", shift_of(F.col("timestamp")))
        .groupBy(F.col("s.name").alias("shift_name"), F.col("s.start").alias("shift_start"))
        .agg(*[F.count_if(cls == c).alias(c.lower()) for c in ("CRITICAL", "WARNING", "INFO")])
    )


def timeline_60(alerts: DataFrame, as_of, minutes: int = 60) -> DataFrame:
    """The last ``minutes`` one-minute buckets up to the current one, zero-filled."""
    last = as_datetime(as_of).replace(second=0, microsecond=0)
    first = last - dt.timedelta(minutes=minutes - 1)
    grid = alerts.sparkSession.range(1).select(F.explode(F.sequence(
        ntz(first), ntz(last), F.expr("INTERVAL '1' MINUTE"))).alias("minute"))
    rows = within(alerts, first, last + dt.timedelta(minutes=1))
    got = rows.groupBy(F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("minute")).agg(
        *class_counts()[:-1])
    return _zero_filled(grid, got, ["minute"])


def health_score(critical: Column, warning: Column, bgp_down: Column | None = None,
                 flapping: Column | None = None, degraded: Column | None = None,
                 pni_healthy: Column | None = None) -> Column:
    """0..100 score of counts."""
    zero = F.lit(0)

    def cost(c, each: float, cap: float) -> Column:
        return F.least((c if c is not None else zero) * F.lit(each), F.lit(cap))

    bonus = F.when(pni_healthy if pni_healthy is not None else F.lit(True), 5.0).otherwise(0.0)
    score = (
        F.lit(100.0) - cost(critical, 15.0, 60.0) - cost(warning, 2.0, 20.0) - cost(bgp_down, 3.0, 30.0)
        - cost(flapping, 5.0, 25.0) - cost(degraded, 10.0, 40.0) + bonus
        + F.when(critical == 0, 5.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def health_by_day(alerts: DataFrame) -> DataFrame:
    """A12 per device and day: CRITICAL and WARNING rows, BGP peers whose last report of the day is Down, and
    links whose last report is that a member is gone. A peer that came back does not count."""
    cls, mnem, msg = F.col("classification"), F.col("mnemonic"), F.col("message")
    down = (mnem == "ADJCHANGE") & msg.rlike(r"(?U)\bDown\b")
    lost = (mnem == "ACTIVE") & msg.contains("no longer")
    kind = F.when(mnem.isin("ADJCHANGE", "ACTIVE"), mnem)
    subject = F.when(mnem == "ADJCHANGE", F.coalesce("bgp_neighbor", F.lit(""))).when(
        mnem == "ACTIVE", F.coalesce("interface_name", F.lit("")))
    day = F.to_date("timestamp").cast("string").alias("day")
    last = alerts.groupBy("device_name", day, kind.alias("kind"), subject.alias("subject")).agg(
        F.count_if(cls == "CRITICAL").alias("critical"), F.count_if(cls == "WARNING").alias("warning"),
        F.max_by(down | lost, F.struct("timestamp", "alert_id")).alias("bad"))
    rows = last.groupBy("device_name", "day").agg(
        F.sum("critical").alias("critical"), F.sum("warning").alias("warning"),
        F.count_if((F.col("kind") == "ADJCHANGE") & F.col("bad")).alias("bgp_down"),
        F.count_if((F.col("kind") == "ACTIVE") & F.col("bad")).alias("degraded"))
    return rows.withColumn("score", health_score(
        F.col("critical"), F.col("warning"), F.col("bgp_down"), None, F.col("degraded")))


def client_sla(incidents: DataFrame, days: int, as_of) -> DataFrame:
    """Per client uptime %, MTBF hours, MTTR minutes and incident count over resolved incidents
    created in the window. Durations are summed as they are; text that is no JSON list matches no
    client. A client absent from the result has 100 / 0 / 0 / 0."""
    window_min = days * 24 * 60.0
    rows = incidents.where(
        (F.col("status") == "resolved")
        & (F.col("created_at") >= ntz(as_of) - F.expr(f"INTERVAL '{days}' DAY")))
    names = F.from_json("affected_clients", "array<string>")
    minutes = (
        F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("resolved_at")).cast("double") / 6e7
    )
    per = rows.select(F.explode(F.array_distinct(names)).alias("client_name"), minutes.alias("m"))
    agg = per.where("client_name IS NOT NULL").groupBy("client_name").agg(
        F.count("*").alias("incidents_count"), F.sum("m").alias("down"), F.avg("m").alias("avg_m"))
    up = F.greatest(F.lit(0.0), F.lit(window_min) - F.coalesce("down", F.lit(0.0))) / window_min * 100
    return agg.select(
        "client_name", F.greatest(F.lit(0.0), F.least(F.lit(100.0), up)).alias("uptime_percent"),
        F.when(F.col("incidents_count") >= 2, F.lit(days * 24.0) / F.col("incidents_count")).otherwise(0.0)
        .alias("mtbf_hours"),
        F.coalesce("avg_m", F.lit(0.0)).alias("mttr_minutes"), "incidents_count")


def prefix_forecast(df: DataFrame, current: str = "current_count", limit: str = "max_count",
                    growth: str = "growth_rate") -> DataFrame:
    """80 % / 90 % flags and whole days until 80 %, 90 % and the limit; NULL days when the
    growth is not positive."""
    cur, mx, g = F.col(current), F.col(limit), F.col(growth)
    at80, at90 = mx * F.lit(0.80), mx * F.lit(0.90)

    def days(target: Column) -> Column:
        return F.when(g > 0, F.when(cur < target, ((target - cur) / g).cast("bigint")).otherwise(F.lit(0)))

    return df.withColumns({
        "warning_80_reached": cur >= at80, "warning_90_reached": cur >= at90,
        "days_until_max": days(mx), "days_until_80": days(at80), "days_until_90": days(at90),
    })


def peer_growth(maxpfx: DataFrame) -> DataFrame:
    """A14 input per device and peer: newest count and limit, and prefixes per day by regression (0
    for a peer with a single reading)."""
    day = F.col("us") / F.lit(86_400.0 * timeline.SECOND)
    newest = F.struct("us", "seq")
    return maxpfx.groupBy("device_name", "peer").agg(
        F.max_by("prefix_count", newest).alias("current_count"),
        F.max_by("max_prefixes", newest).alias("max_count"),
        F.coalesce(F.regr_slope(F.col("prefix_count").cast("double"), day), F.lit(0.0)).alias("growth_rate"))


def flapping_peers(history: DataFrame, as_of, offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    """Distinct device:neighbor in FLAPPING state since midnight.

    The original takes midnight of the UTC date and compares it with local times; with
    ``offset_hours=0`` the local date's midnight is used.
    """
    utc = as_datetime(as_of) - dt.timedelta(hours=offset_hours)
    start = utc.replace(hour=0, minute=0, second=0, microsecond=0)
    rows = history.where((F.col("state") == "FLAPPING") & (F.col("timestamp") >= ntz(start)))
    return rows.agg(F.count_distinct(F.concat_ws(":", "device_name", "neighbor")).alias("flapping_peers"))


def daily_digest(alerts: DataFrame, incidents: DataFrame, history: DataFrame, as_of,
                 title: str = "Daily Digest", offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    """One row with the day's counts, active incidents, health score and the digest text.

    Devices with equal counts are listed by name.
    """
    date = as_datetime(as_of).date().isoformat()
    active = incidents.where("status = 'active'").agg(F.count("*"))
    flaps = flapping_peers(history, as_of, offset_hours)
    top = (
        _day(alerts, date).groupBy("device_name").agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "device_name").limit(5)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "device_name"))).alias("top"))
    )
    one = daily_stats(alerts, date).select(
        "*", active.scalar().alias("active_incidents"), flaps.scalar().alias("flapping_peers"),
        top.scalar().alias("top"))
    one = one.withColumn("score", health_score(F.col("critical"), F.col("warning"), None, F.col("flapping_peers")))
    label = [("CRITICAL", "critical"), ("WARNING", "warning"), ("INFO", "info"), ("NOISE", "noise"),
             ("TOTAL", "total")]
    counts_text = [F.concat(F.lit(f"  {name:<9}: "), F.col(c).cast("string")) for name, c in label]
    listing = F.transform("top", lambda t: F.concat(
        F.lit("  "), t["device_name"], F.lit(": "), (-t["c"]).cast("string"), F.lit(" alerts")))
    lines = F.concat(
        F.array(F.lit(title), F.concat(F.lit("Date: "), F.col("date")), F.lit(""), F.lit("Alert Summary"),
                *counts_text, F.lit(""),
                F.concat(F.lit("Active Incidents : "), F.col("active_incidents").cast("string")),
                F.concat(F.lit("Health Score     : "), F.format_string("%.1f", "score"), F.lit("/100")),
                F.lit("")),
        F.when(F.size("top") > 0, F.concat(F.array(F.lit("Top Active Devices")), listing))
        .otherwise(F.array(F.lit("Top Active Devices: none"))))
    return one.withColumn("digest", F.array_join(lines, "\n")).drop("top")


def _aliases(nodes: DataFrame, device: DataFrame) -> DataFrame:
    """(name, alias) both ways for addresses that two tables name differently."""
    dev = device.select("ip", F.col("name").alias("alias"))
    pairs = nodes.join(dev, "ip").where(F.col("name") != F.col("alias")).select("name", "alias")
    return pairs.unionByName(pairs.select(F.col("alias").alias("name"), F.col("name").alias("alias"))).distinct()


def _with_aliases(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found(name, ...)`` plus copies under the alias of each name whose alias has no row."""
    copies = found.join(pairs, "name").drop("name").withColumnRenamed("alias", "name")
    missing = copies.join(found.select("name").distinct(), "name", "left_anti")
    return found.unionByName(missing)


def _statuses(alerts: DataFrame, nodes: DataFrame, device: DataFrame, as_of) -> DataFrame:
    """name -> status of every device name with alerts in 24 h."""
    cls = F.col("classification")
    worst = F.max(F.when(cls == "CRITICAL", 2).when(cls == "WARNING", 1).otherwise(0))
    sev = _last(alerts, as_of, hours=24).groupBy(F.col("device_name").alias("name")).agg(worst.alias("w"))
    status = F.when(F.col("w") == 2, "critical").when(F.col("w") == 1, "warning").otherwise("ok")
    return _with_aliases(sev.select("name", status.alias("status")), _aliases(nodes, device))


def device_status(alerts: DataFrame, nodes: DataFrame, device: DataFrame, as_of) -> DataFrame:
    """Node -> critical / warning / ok by the worst class of 24 h, unknown without alerts.

    Alerts under the device table's name count for a node whose own name has none.
    """
    first = nodes.groupBy("name").agg(F.min_by("ip", "ordinal").alias("ip"))
    return first.join(_statuses(alerts, nodes, device, as_of), "name", "left").select(
        F.col("name").alias("node"), "ip", F.coalesce("status", F.lit("unknown")).alias("status"))


def link_status(alerts: DataFrame, topology: DataFrame, nodes: DataFrame, device: DataFrame, as_of) -> DataFrame:
    """Links without repeats; critical when a member of the declaring end has an unresolved
    CRITICAL in 24 h, else warning when either end is critical or warning, else ok; unknown when
    neither end has alerts."""
    status = _statuses(alerts, nodes, device, as_of)
    bad = _last(alerts, as_of, hours=24).where(
        (F.col("classification") == "CRITICAL") & F.col("resolved_at").isNull() & (F.col("interface_name") != "")
    ).select(F.col("device_name").alias("name"), F.col("interface_name").alias("member")).distinct()
    hits = _with_aliases(bad, _aliases(nodes, device)).select(F.col("name").alias("source"), "member")
    ends = nodes.select("ip", F.col("name").alias("node"))
    devs = device.select(F.col("ip").alias("remote_ip"), F.col("name").alias("dev_name"))
    links = (
        topology.join(ends.withColumnRenamed("node", "source"), "ip")
        .join(ends.select(F.col("ip").alias("remote_ip"), F.col("node").alias("remote_node")), "remote_ip", "left")
        .join(devs, "remote_ip", "left")
        .withColumn("target", F.coalesce("remote_node", "dev_name", "remote_ip"))
    )
    first = (
        links.withColumn("ends", F.array_sort(F.array_distinct(F.array("source", "target", "bundle"))))
        .groupBy("ends")
        .agg(F.min(F.struct("ordinal", "source", "target", "bundle", "members")).alias("l"))
        .select("l.source", "l.target", "l.bundle", "l.members")
    )
    member_hit = (
        first.select("source", "target", "bundle", F.explode("members").alias("member"))
        .join(hits, ["source", "member"], "left_semi")
        .select("source", "target", "bundle").distinct().withColumn("hit", F.lit(True))
    )
    s1, s2 = (F.coalesce(c, F.lit("unknown")) for c in ("s1", "s2"))
    result = (
        F.when((s1 == "unknown") & (s2 == "unknown"), "unknown")
        .when(F.col("hit"), "critical")
        .when(s1.isin("critical", "warning") | s2.isin("critical", "warning"), "warning")
        .otherwise("ok")
    )
    return (
        first.join(member_hit, ["source", "target", "bundle"], "left")
        .join(status.select(F.col("name").alias("source"), F.col("status").alias("s1")), "source", "left")
        .join(status.select(F.col("name").alias("target"), F.col("status").alias("s2")), "target", "left")
        .select("source", "target", "bundle", F.size("members").alias("members"), result.alias("status"))
    )


def bgp_peers(alerts: DataFrame) -> DataFrame:
    """The last event per neighbor, whatever the device; ``last_state`` is its class."""
    last = F.struct("timestamp", "alert_id")
    return alerts.where(F.col("bgp_neighbor") != "").groupBy(F.col("bgp_neighbor").alias("neighbor")).agg(
        F.max_by(F.struct("as_number", "as_name", "device_name", "classification"), last).alias("r")
    ).select("neighbor", "r.as_number", "r.as_name", F.col("r.device_name").alias("device"),
             F.col("r.classification").alias("last_state"))


def device_list(device: DataFrame) -> DataFrame:
    """One row per device name; the first declared address wins."""
    return device.groupBy("name").agg(F.min(F.struct(
        "ordinal", "ip", "hostname", "location")).alias("r")).select(
        "name", "r.ip", "r.hostname", "r.location", F.lit("unknown").alias("status"))


def event_metrics(decided: DataFrame) -> DataFrame:
    """``metric, label, value`` rows: events by class, suppressed events, notifications by channel.

    ``decided`` has classification, should_send, discord_ok, telegram_ok.
    """
    totals = decided.groupBy("classification").agg(
        F.count("*").alias("alerts_processed"), F.count_if(~F.col("should_send")).alias("dedup_suppressed"),
        F.count_if("discord_ok").alias("discord"), F.count_if("telegram_ok").alias("telegram"))
    by_class = totals.select(F.lit("alerts_processed").alias("metric"), F.col("classification").alias("label"),
                             F.col("alerts_processed").alias("value"))
    rest = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dedup_suppressed", "discord", "telegram")])
    stacked = rest.select(F.explode(F.array(
        F.struct(F.lit("dedup_suppressed").alias("metric"), F.lit("").alias("label"), F.col("dedup_suppressed").alias("value")),
        F.struct(F.lit("notifications_sent").alias("metric"), F.lit("discord").alias("label"), F.col("discord").alias("value")),
        F.struct(F.lit("notifications_sent").alias("metric"), F.lit("telegram").alias("label"), F.col("telegram").alias("value")),
    )).alias("r")).select("r.*")
    return by_class.unionByName(stacked)


def staleness(events: DataFrame, as_of_us: int, after_s: int = fixed.STALE_AFTER,
              width: int = timeline.CHUNK_US) -> DataFrame:
    """Silent gaps longer than ``after_s``: ``gap_start_us, gap_end_us, seconds``; the gap since
    the last event has no end. One row per outage.

    No gap inside ``after_s`` of the clock can be too long, so such a bucket is only its first and
    last event, which are summed up before the shuffle. Buckets are compared chunk by chunk, and
    chunks by one row each.
    """
    limit = after_s * timeline.SECOND
    buckets = events.groupBy(timeline.chunk("us", limit).alias("bucket")).agg(F.min("us").alias("a"), F.max("us").alias("z"))
    rows = buckets.withColumn("chunk", timeline.chunk("bucket", max(width, 1024 * limit)))
    inner = Window.partitionBy("chunk").orderBy("bucket")
    gaps = rows.select(F.lag("z").over(inner).alias("prev"), F.col("a").alias("us")).where(F.col("us") - F.col("prev") > limit)
    ends = rows.groupBy("chunk").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    across = ends.withColumn("nxt", F.lead("a").over(Window.orderBy("chunk")))
    across = across.where(
        (F.coalesce("nxt", F.lit(as_of_us)) - F.col("z")) > limit
    ).select(F.col("z").alias("prev"), F.col("nxt").alias("us"))
    return gaps.select("prev", "us").unionByName(across).select(
        F.col("prev").alias("gap_start_us"), F.col("us").alias("gap_end_us"),
        ((F.coalesce("us", F.lit(as_of_us)) - F.col("prev")) / timeline.SECOND).alias("seconds"))
