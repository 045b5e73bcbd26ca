"""Queries for statistics (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.times import to_us
from ..operators import enrich, resolve, stats
from . import fixtures as fx
from .checks import CTES, check, ts as sts
from .registry import alerts, enriched, query, shared, ts
from .tables import decided, faults

A = f"TIMESTAMP '{fx.AS_OF}'"
FIVE = ", ".join(f"count(*) FILTER (classification = '{c}') AS {n}" for c, n in stats.CLASS_COLS.items())
KNOWN = "classification IN (" + ", ".join(f"'{c}'" for c in fixed.CLASSES) + ")"
SIX = f"{FIVE}, count(*) FILTER ({KNOWN}) AS total"
ZERO = ", ".join(f"coalesce({n}, 0) AS {n}" for n in stats.CLASS_COLS.values())


@query("a1_counts", check(f"SELECT '7d' AS period, {SIX} FROM alerts WHERE timestamp >= {A} - INTERVAL 7 DAY", "alerts"))
def _(spark, sf):
    return stats.counts(alerts(spark, sf), "7d", fx.AS_OF)


@query("a2_daily_stats", check(
    f"SELECT '2024-01-17' AS date, {SIX} FROM alerts WHERE CAST(timestamp AS DATE) = DATE '2024-01-17'", "alerts"))
def _(spark, sf):
    return stats.daily_stats(alerts(spark, sf), "2024-01-17")


@query("a3_weekly_stats", check(f"""
SELECT CAST(d AS VARCHAR) AS day, {ZERO}, coalesce(total, 0) AS total
FROM (SELECT CAST(DATE '2024-01-27' + CAST(i AS INTEGER) AS DATE) AS d FROM range(7) r(i)) g
LEFT JOIN (SELECT CAST(timestamp AS DATE) AS d, {SIX} FROM alerts GROUP BY 1) a USING (d)""", "alerts"))
def _(spark, sf):
    return stats.weekly_stats(alerts(spark, sf), "2024-01-27")


@query("a4_device_stats", check(f"""
SELECT 'rtr-1' AS device_name, {SIX} FROM alerts WHERE device_name = 'rtr-1' AND timestamp BETWEEN {A} - INTERVAL 20 DAY AND {A}""", "alerts"))
def _(spark, sf):
    return stats.device_stats(alerts(spark, sf), "rtr-1", 20, fx.AS_OF)


@query("a4_device_stats_all", check(
    f"SELECT device_name, {SIX} FROM alerts WHERE timestamp BETWEEN {A} - INTERVAL 20 DAY AND {A} GROUP BY 1", "alerts"))
def _(spark, sf):
    return stats.device_stats_all(alerts(spark, sf), 20, fx.AS_OF)


HOURLY = ", ".join(f"count(*) FILTER (classification = '{c}') AS {n}_count" for c, n in stats.CLASS_COLS.items())


@query("a5_hourly_stats", check(f"""
SELECT device_name, strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS hour, {HOURLY} FROM alerts
WHERE timestamp >= {A} - INTERVAL 6 HOUR - INTERVAL 7 DAY GROUP BY 1, 2""", "alerts"))
def _(spark, sf):
    return stats.hourly_stats(alerts(spark, sf), fx.AS_OF).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("a5_upsert_hourly", check(f"""
SELECT coalesce(n.device_name, o.device_name) AS device_name, strftime(coalesce(n.hour, o.hour), '%Y-%m-%d %H') AS hour,
  CASE WHEN n.hour IS NOT NULL THEN n.critical_count ELSE o.critical_count END AS critical_count
FROM (SELECT device_name, date_trunc('hour', timestamp) AS hour, {HOURLY} FROM alerts WHERE alert_id % 2 = 0
      AND timestamp >= {A} - INTERVAL 6 HOUR - INTERVAL 30 DAY GROUP BY 1, 2) o
FULL JOIN (SELECT device_name, date_trunc('hour', timestamp) AS hour, {HOURLY} FROM alerts
      WHERE timestamp >= {A} - INTERVAL 6 HOUR - INTERVAL 7 DAY GROUP BY 1, 2) n ON n.device_name = o.device_name AND n.hour = o.hour""", "alerts"))
def _(spark, sf):
    a = alerts(spark, sf)
    old = stats.hourly_stats(a.where("alert_id % 2 = 0"), fx.AS_OF, 30)
    out = stats.upsert_hourly(old, stats.hourly_stats(a, fx.AS_OF))
    return out.select("device_name", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "critical_count")


@query("a6_hour_of_day", check(f"""
SELECT CAST(h AS INTEGER) AS hour, {ZERO} FROM range(24) g(h) LEFT JOIN (SELECT hour(timestamp) AS h, {FIVE} FROM alerts
  WHERE timestamp >= {A} - INTERVAL 30 DAY GROUP BY 1) a USING (h)""", "alerts"))
def _(spark, sf):
    return stats.hour_of_day(alerts(spark, sf), "30d", fx.AS_OF)


@query("a7_top_devices", check(f"""
SELECT device_name, count(*) AS cnt FROM alerts WHERE device_name <> '' AND timestamp >= {A} - INTERVAL 7 DAY
GROUP BY 1 ORDER BY cnt DESC, device_name LIMIT 10""", "alerts"))
def _(spark, sf):
    return stats.top_devices(alerts(spark, sf), "7d", fx.AS_OF)


@query("a8_heatmap", check(f"""
SELECT day, hour, coalesce(cnt, 0) AS cnt, max(coalesce(cnt, 0)) OVER () AS max_count
FROM (SELECT CAST(i // 24 AS INTEGER) AS day, CAST(i % 24 AS INTEGER) AS hour FROM range(168) r(i)) g
LEFT JOIN (SELECT isodow(timestamp) - 1 AS day, hour(timestamp) AS hour, count(*) AS cnt FROM alerts
  WHERE timestamp >= {A} - INTERVAL 7 DAY GROUP BY 1, 2) a USING (day, hour)""", "alerts"))
def _(spark, sf):
    return stats.heatmap(alerts(spark, sf), "7d", fx.AS_OF)


@query("a9_monthly", check(
    f"SELECT coalesce(strftime(timestamp, '%Y-%m'), 'ALL') AS month, {SIX} FROM alerts GROUP BY ROLLUP (strftime(timestamp, '%Y-%m'))", "alerts"))
def _(spark, sf):
    return stats.monthly(alerts(spark, sf))


INCIDENT_ALERTS = "SELECT id AS alert_id, created_at AS timestamp, CASE status WHEN 'active' THEN 'CRITICAL' WHEN 'resolved' THEN 'INFO' ELSE 'odd' END AS classification FROM incidents"


@query("a9_yearly", check(
    f"SELECT coalesce(strftime(timestamp, '%Y'), 'ALL') AS year, {SIX} FROM ia GROUP BY ROLLUP (strftime(timestamp, '%Y'))", "incidents", ia=INCIDENT_ALERTS))
def _(spark, sf):
    return stats.yearly(fx.derive(spark, sf, INCIDENT_ALERTS, incidents=shared(spark, sf, "INCIDENTS")))


@query("a10_shift_counts", check(f"""
SELECT 'evening' AS shift_name, '2024-01-29 15:00:00.000000' AS shift_start, '2024-01-29 22:30:00.000000' AS shift_end,
  count(*) FILTER (classification = 'CRITICAL') AS critical_since_shift, count(*) FILTER (classification = 'WARNING') AS warning_since_shift,
  count(*) FILTER (classification = 'INFO') AS info_since_shift,
  (SELECT count(*) FROM recent_cards WHERE acknowledged_at IS NULL) AS open_incidents
FROM alerts WHERE timestamp >= TIMESTAMP '2024-01-29 15:00:00'""", "alerts", "recent_cards"))
def _(spark, sf):
    cards = resolve.incident_cards(faults(spark, sf))
    out = stats.shift_counts(alerts(spark, sf), cards, "2024-01-29 18:45:00")
    return out.withColumns({"shift_start": ts("shift_start"), "shift_end": ts("shift_end")})


@query("a10_shift_history", check(f"""
SELECT CASE WHEN m >= 480 AND m < 900 THEN 'morning' WHEN m >= 900 AND m < 1350 THEN 'evening' ELSE 'night' END AS shift_name,
  {sts("d + INTERVAL 1 MINUTE * CASE WHEN m < 480 THEN -90 WHEN m < 900 THEN 480 WHEN m < 1350 THEN 900 ELSE 1350 END")} AS shift_start,
  count(*) FILTER (classification = 'CRITICAL') AS critical, count(*) FILTER (classification = 'WARNING') AS warning,
  count(*) FILTER (classification = 'INFO') AS info
FROM (SELECT *, hour(timestamp) * 60 + minute(timestamp) AS m, date_trunc('day', timestamp) AS d FROM alerts) x GROUP BY 1, 2""", "alerts"))
def _(spark, sf):
    return stats.shift_history(alerts(spark, sf)).withColumn("shift_start", ts("shift_start"))


@query("a11_timeline", check(f"""
SELECT {sts('g.minute')} AS minute, {ZERO} FROM (SELECT TIMESTAMP '2024-01-29 11:31:00' + i * INTERVAL 1 MINUTE AS minute FROM range(60) r(i)) g
LEFT JOIN (SELECT date_trunc('minute', timestamp) AS minute, {FIVE} FROM alerts GROUP BY 1) a USING (minute)""", "alerts"))
def _(spark, sf):
    return stats.timeline_60(alerts(spark, sf), "2024-01-29 12:30:20").withColumn("minute", ts("minute"))


SCORE = ("greatest(0, least(100, 100 - least(15 * critical, 60) - least(2 * warning, 20) - least(3 * bgp_down, 30)"
         " - least(10 * degraded, 40) + 5 + CASE WHEN critical = 0 THEN 5 ELSE 0 END))")


@query("a12_health_score", check(f"""
SELECT *, CAST({SCORE} AS DOUBLE) AS score FROM (SELECT device_name, day, CAST(sum(critical) AS BIGINT) AS critical,
  CAST(sum(warning) AS BIGINT) AS warning, count(*) FILTER (mnemonic = 'ADJCHANGE' AND contains(last_message, ' Down')) AS bgp_down,
  count(*) FILTER (mnemonic = 'ACTIVE' AND contains(last_message, 'no longer')) AS degraded
  FROM (SELECT device_name, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, mnemonic,
      CASE mnemonic WHEN 'ADJCHANGE' THEN coalesce(bgp_neighbor, '') WHEN 'ACTIVE' THEN coalesce(interface_name, '') END AS subject,
      count(*) FILTER (classification = 'CRITICAL') AS critical, count(*) FILTER (classification = 'WARNING') AS warning,
      arg_max(message, (timestamp, alert_id)) AS last_message FROM alerts GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2) x""", "alerts"))
def _(spark, sf):
    return stats.health_by_day(alerts(spark, sf))


@query("a13_client_sla", check("""
SELECT client_name, round(greatest(0, least(100, greatest(0, 2400 * 1440.0 - coalesce(sum(m), 0)) / (2400 * 1440.0) * 100)), 6) AS uptime_percent,
  round(CASE WHEN count(*) >= 2 THEN 2400 * 24.0 / count(*) ELSE 0 END, 6) AS mtbf_hours, round(coalesce(avg(m), 0), 6) AS mttr_minutes,
  count(*) AS incidents_count
FROM (SELECT DISTINCT id, unnest(CAST(json(affected_clients) AS VARCHAR[])) AS client_name,
    date_diff('microsecond', created_at, resolved_at) / 6e7 AS m
  FROM incidents WHERE status = 'resolved' AND affected_clients LIKE '[%' AND created_at >= TIMESTAMP '1998-12-01 00:00:00' - INTERVAL 2400 DAY) x
GROUP BY 1""", "incidents"))
def _(spark, sf):
    out = stats.client_sla(shared(spark, sf, "INCIDENTS"), 2400, "1998-12-01 00:00:00")
    return out.select("client_name", *[F.round(c, 6).alias(c) for c in ("uptime_percent", "mtbf_hours", "mttr_minutes")], "incidents_count")


@query("a14_prefix_forecast", check("""
SELECT *, current_count >= 0.8 * max_count AS warning_80_reached, current_count >= 0.9 * max_count AS warning_90_reached,
  coalesce(CASE WHEN growth_rate > 0 THEN CASE WHEN current_count < max_count THEN CAST(trunc((max_count - current_count) / growth_rate) AS BIGINT) ELSE 0 END END, -1) AS days_until_max,
  coalesce(CASE WHEN growth_rate > 0 THEN CASE WHEN current_count < 0.8 * max_count THEN CAST(trunc((0.8 * max_count - current_count) / growth_rate) AS BIGINT) ELSE 0 END END, -1) AS days_until_80,
  coalesce(CASE WHEN growth_rate > 0 THEN CASE WHEN current_count < 0.9 * max_count THEN CAST(trunc((0.9 * max_count - current_count) / growth_rate) AS BIGINT) ELSE 0 END END, -1) AS days_until_90
FROM (SELECT o_orderkey AS id, o_custkey % 1200 AS current_count, 1000 AS max_count,
  CAST((o_orderkey % 9 - 2) * 1.25 AS DOUBLE) AS growth_rate FROM orders) x"""))
def _(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 1200).alias("current_count"),
        F.lit(1000).alias("max_count"), ((F.col("o_orderkey") % 9 - 2) * F.lit(1.25)).alias("growth_rate"))
    out = stats.prefix_forecast(rows)
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("days_until_max", "days_until_80", "days_until_90")})


@query("a14_peer_growth", check(r"""
SELECT device_name, peer, arg_max(c, (us, seq)) AS current_count, arg_max(mx, (us, seq)) AS max_count,
  round(CASE WHEN count(DISTINCT us) > 1 THEN regr_slope(c, us / 86400000000.0) ELSE 0 END, 4) AS growth_rate
FROM (SELECT device_name, event_id AS seq, us, regexp_extract(message, 'from (\S+)', 1) AS peer,
  CAST(regexp_extract(message, 'reached (\d+)', 1) AS BIGINT) AS c, CAST(regexp_extract(message, 'max (\d+)', 1) AS BIGINT) AS mx
  FROM enriched WHERE mnemonic = 'MAXPFX') x GROUP BY 1, 2""", "enriched"))
def _(spark, sf):
    rows = enrich.extract_maxpfx(enriched(spark, sf))
    return stats.peer_growth(rows).withColumn("growth_rate", F.round("growth_rate", 4))


HISTORY_SQL = """SELECT event_id, device_name, bgp_neighbor AS neighbor, timestamp, CASE WHEN event_id % 3 = 0 THEN 'FLAPPING' ELSE 'Up' END AS state
  FROM (SELECT alert_id AS event_id, * FROM alerts) a WHERE bgp_neighbor <> ''"""
CTES["history"] = (["alerts"], HISTORY_SQL)


def history(spark, sf):
    return alerts(spark, sf).where("bgp_neighbor <> ''").select(
        F.col("alert_id").alias("event_id"), "device_name", F.col("bgp_neighbor").alias("neighbor"), "timestamp",
        F.when(F.col("alert_id") % 3 == 0, "FLAPPING").otherwise("Up").alias("state"))


FLAPS = "SELECT count(DISTINCT concat(device_name, ':', neighbor)) FROM history WHERE state = 'FLAPPING' AND timestamp >= TIMESTAMP '2024-01-25 00:00:00'"


@query("a15_daily_digest", check(f"""
SELECT active_incidents, flapping_peers, score, concat('Daily Digest', n, 'Date: 2024-01-25', n, n, 'Alert Summary', n,
  '  CRITICAL : ', critical, n, '  WARNING  : ', warning, n, '  INFO     : ', info, n, '  NOISE    : ', noise, n, '  TOTAL    : ', total, n, n,
  'Active Incidents : ', active_incidents, n, 'Health Score     : ', printf('%.1f', score), '/100', n, n, 'Top Active Devices', n, tops) AS digest
FROM (SELECT *, chr(10) AS n, CAST(greatest(0, least(100, 100 - least(15 * critical, 60) - least(2 * warning, 20) - least(5 * flapping_peers, 25) + 5
    + CASE WHEN critical = 0 THEN 5 ELSE 0 END)) AS DOUBLE) AS score
  FROM (SELECT (SELECT count(*) FROM incidents WHERE status = 'active') AS active_incidents, ({FLAPS}) AS flapping_peers, {SIX},
    (SELECT string_agg(concat('  ', device_name, ': ', cnt, ' alerts'), chr(10) ORDER BY cnt DESC, device_name) FROM (
      SELECT device_name, count(*) AS cnt FROM alerts WHERE CAST(timestamp AS DATE) = DATE '2024-01-25'
      GROUP BY 1 ORDER BY cnt DESC, device_name LIMIT 5) t) AS tops
    FROM alerts WHERE CAST(timestamp AS DATE) = DATE '2024-01-25') y) z""", "alerts", "incidents", "history"))
def _(spark, sf):
    out = stats.daily_digest(alerts(spark, sf), shared(spark, sf, "INCIDENTS"), history(spark, sf), "2024-01-25 09:00:00")
    return out.select("active_incidents", "flapping_peers", "score", "digest")


@query("a16_flapping_peers", check(f"SELECT ({FLAPS}) AS flapping_peers", "history"))
def _(spark, sf):
    return stats.flapping_peers(history(spark, sf), "2024-01-25 09:00:00")


ALIAS = """SELECT n.name AS a, d.name AS b FROM node n JOIN device d USING (ip) WHERE n.name <> d.name
  UNION SELECT d.name, n.name FROM node n JOIN device d USING (ip) WHERE n.name <> d.name"""
SEV = f"""SELECT device_name AS name, max(CASE classification WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS w
  FROM alerts WHERE timestamp >= TIMESTAMP '2024-01-20 10:00:00' - INTERVAL 24 HOUR GROUP BY 1"""
CTES.update({
    "alias": (["node", "device"], ALIAS),
    "sev0": (["alerts"], SEV),
    "sev": (["sev0", "alias"], """SELECT name, CASE w WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status FROM (
        SELECT * FROM sev0 UNION ALL SELECT alias.b, sev0.w FROM sev0 JOIN alias ON alias.a = sev0.name WHERE alias.b NOT IN (SELECT name FROM sev0)) x"""),
    "bad0": (["alerts"], """SELECT DISTINCT device_name AS name, interface_name AS member FROM alerts WHERE classification = 'CRITICAL'
        AND resolved_at IS NULL AND interface_name <> '' AND timestamp >= TIMESTAMP '2024-01-20 10:00:00' - INTERVAL 24 HOUR"""),
    "bad": (["bad0", "alias"], "SELECT * FROM bad0 UNION ALL SELECT alias.b, member FROM bad0 JOIN alias ON alias.a = bad0.name WHERE alias.b NOT IN (SELECT name FROM bad0)"),
})


@query("a17_device_status", check(
    "SELECT n.name AS node, n.ip, coalesce(s.status, 'unknown') AS status FROM node n LEFT JOIN sev s USING (name)", "node", "sev"))
def _(spark, sf):
    return stats.device_status(alerts(spark, sf), fx.dim(spark, "node"), fx.dim(spark, "device"), "2024-01-20 10:00:00")


@query("a18_link_status", check("""
SELECT source, target, bundle, 1 AS members, CASE WHEN s1 IS NULL AND s2 IS NULL THEN 'unknown' WHEN hit THEN 'critical'
  WHEN coalesce(s1, '') IN ('critical', 'warning') OR coalesce(s2, '') IN ('critical', 'warning') THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT a.name AS source, b.name AS target, t.bundle, x.status AS s1, y.status AS s2,
    EXISTS (SELECT 1 FROM bad WHERE bad.name = a.name AND bad.member = t.member) AS hit,
    row_number() OVER (PARTITION BY list_sort([a.name, b.name, t.bundle]) ORDER BY t.ordinal) AS rn
  FROM topo t JOIN node a ON a.ip = t.ip JOIN node b ON b.ip = t.remote_ip
  LEFT JOIN sev x ON x.name = a.name LEFT JOIN sev y ON y.name = b.name) z WHERE rn = 1""", "topo", "node", "sev", "bad"))
def _(spark, sf):
    return stats.link_status(alerts(spark, sf), fx.dim(spark, "topo"), fx.dim(spark, "node"), fx.dim(spark, "device"),
                             "2024-01-20 10:00:00")


@query("a19_bgp_peers", check("""
SELECT bgp_neighbor AS neighbor, arg_max(as_number, (timestamp, alert_id)) AS as_number, arg_max(as_name, (timestamp, alert_id)) AS as_name,
  arg_max(device_name, (timestamp, alert_id)) AS device, arg_max(classification, (timestamp, alert_id)) AS last_state
FROM alerts WHERE bgp_neighbor <> '' GROUP BY 1""", "alerts"))
def _(spark, sf):
    return stats.bgp_peers(alerts(spark, sf))


DEVICES = """SELECT s_suppkey AS ordinal, concat('10.', CAST(s_suppkey % 250 AS STRING), '.0.1') AS ip, concat('rtr-', CAST(s_suppkey % 37 AS STRING)) AS name,
  concat('HOST-', CAST(s_suppkey AS STRING)) AS hostname, concat('site-', CAST(s_nationkey AS STRING)) AS location FROM supplier"""


@query("a20_device_list", check("""
SELECT name, arg_min(ip, ordinal) AS ip, arg_min(hostname, ordinal) AS hostname, arg_min(location, ordinal) AS location, 'unknown' AS status
FROM devices GROUP BY name""", devices=DEVICES))
def _(spark, sf):
    return stats.device_list(fx.derive(spark, sf, DEVICES))


@query("a21_event_metrics", check("""
SELECT 'alerts_processed' AS metric, classification AS label, count(*) AS value FROM dec GROUP BY 2
UNION ALL SELECT 'dedup_suppressed', '', count(*) FROM dec WHERE NOT should_send
UNION ALL SELECT 'notifications_sent', 'discord', count(*) FROM dec WHERE sent AND seq % 3 > 0
UNION ALL SELECT 'notifications_sent', 'telegram', count(*) FROM dec WHERE sent AND seq % 4 > 0""", "dec", recursive=True))
def _(spark, sf):
    rows = decided(spark, sf).withColumns({
        "discord_ok": F.col("notification_sent") & (F.col("seq") % 3 > 0),
        "telegram_ok": F.col("notification_sent") & (F.col("seq") % 4 > 0)})
    return stats.event_metrics(rows)


@query("a22_staleness", check("""
SELECT epoch_us(ts) AS gap_start_us, coalesce(epoch_us(nxt), -1) AS gap_end_us,
  (coalesce(epoch_us(nxt), epoch_us(TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(ts)) / 1e6 AS seconds
FROM (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM events) x
WHERE coalesce(epoch_us(nxt), epoch_us(TIMESTAMP '2024-02-01 00:00:00')) - epoch_us(ts) > 120000000"""))
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select(to_us(F.col("ts")).alias("us"))
    out = stats.staleness(rows, 1_706_745_600_000_000, after_s=120)
    return out.withColumn("gap_end_us", F.coalesce("gap_end_us", F.lit(-1)))
