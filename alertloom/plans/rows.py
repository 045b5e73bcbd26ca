"""Queries over single rows: sources (S) and parsing, classification, enrichment (P)."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text, times
from ..functions.times import as_datetime, within
from ..operators import classify, enrich, parse, read, stats
from ..session import shared_dir
from ..sources import dims, sinks, syslog, table
from . import fixtures as fx
from .checks import (CTES, GROUP_KEY, INNER, MONTH_CASE, NORM, check, interface_sql, parsed_sql, q, recovery_sql,
                     rule_case, title_sql, ts as sts)
from .registry import alerts, classified, enriched, events, fields, parsed, query, shared, ts


def _scratch(spark, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------------------------ sources

@query("s1_read_syslog", check("SELECT raw FROM lines WHERE event_id % 41 <> 3", "lines"))
def _(spark, sf):
    path = _scratch(spark, "lines")
    raw = F.when(F.col("event_id") % 41 == 3, "").otherwise(F.col("raw"))
    fx.lines(spark, sf).select(F.concat(raw, F.lit("\r")).alias("value")).write.text(path)
    return syslog.read_syslog(spark, path).select("raw")


def envelopes(spark, sf):
    """Lines wrapped in both export envelopes, each with an empty line; some bodies are cut off."""
    pair = F.concat(F.lit('[["'), F.col("us").cast("string"), F.lit('000","'), "raw", F.lit('"],["1",""]]'))
    tail = F.concat(F.lit('{"streams":[{"stream":{"job":"syslog"},"values":'), pair, F.lit("}]}"))
    rng = F.concat(F.lit('{"data":{"result":[{"values":'), pair, F.lit("}]}}"))
    body = F.when(F.col("event_id") % 53 == 0, F.concat(F.lit('{"streams":[{'), "raw")).when(
        F.col("event_id") % 2 == 0, tail).otherwise(rng)
    return fx.lines(spark, sf).select("event_id", body.alias("value"))


@query("s2_explode_export", check(
    "SELECT event_id, us * 1000 AS ts_ns, raw AS line FROM lines WHERE event_id % 53 <> 0", "lines"))
def _(spark, sf):
    return syslog.explode_loki_export(envelopes(spark, sf))


@query("s3_distinct_entries", check("SELECT us * 1000 AS ts_ns, raw AS line FROM lines WHERE event_id % 53 <> 0", "lines"))
def _(spark, sf):
    entries = syslog.explode_loki_export(envelopes(spark, sf)).drop("event_id")
    again = entries.where(F.col("ts_ns") % 7000 < 3000)
    return syslog.distinct_entries(entries.unionByName(again))


LATE = "(SELECT max(us) - 600000000 FROM lines WHERE event_id % 53 <> 0 AND event_id % 7 < 5)"
CTES["entries"] = (["lines"], f"""SELECT us * 1000 AS ts_ns, raw AS line, event_id % 7 >= 5 AND us <= {LATE} AS late
  FROM lines WHERE event_id % 53 <> 0""")


def ingested(spark, sf):
    """(table of entries, table of late ones): export files in two micro-batches, the second from all over the range
    and with repeats, ten minutes of horizon."""
    from ..streaming import ingest

    src, out, state = (_scratch(spark, x) for x in ("export", "ingested", "offsets"))
    body = envelopes(spark, sf)
    for part in (body.where("event_id % 7 < 5"), body.where("event_id % 7 >= 3")):
        part.select("value").write.mode("append").text(src)
        ingest.run_ingest(spark, src, out, state, "10 minutes")
    return table.read(spark, out), table.read(spark, f"{out}-late")


@query("s3_ingest_stream", check("SELECT ts_ns, line, late FROM entries", "entries"))
def _(spark, sf):
    rows, late = ingested(spark, sf)
    return rows.select("ts_ns", "line", F.lit(False).alias("late")).unionByName(
        late.select("ts_ns", "line", F.lit(True).alias("late")))


@query("s4_resume_point", check(f"SELECT {sts('max(timestamp)')} AS resume_from FROM alerts", "alerts"))
def _(spark, sf):
    return syslog.resume_point(alerts(spark, sf)).select(ts("resume_from"))


@query("s5_write_alerts", check(
    "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, count(*) AS n, "
    "CAST(sum(alert_id) AS BIGINT) AS ids FROM alerts GROUP BY 1", "alerts"))
def _(spark, sf):
    path = _scratch(spark, "alerts")
    sinks.write_alerts(alerts(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n"), F.sum("alert_id").alias("ids"))


@query("s5_alert_stream", check(f"""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date, count(*) AS n, CAST(sum(alert_id) AS BIGINT) AS ids FROM alerts
WHERE timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 20 DAY AND timestamp < TIMESTAMP '{fx.AS_OF}' - INTERVAL 2 DAY GROUP BY 1""", "alerts"))
def _(spark, sf):
    """A stream writes the table, retention prunes it, and a period is read."""
    from ..streaming import live

    src, path, state = (_scratch(spark, x) for x in ("alert-files", "alerts", "offsets"))
    rows = alerts(spark, sf)
    rows.write.parquet(src)
    live.write_alert_stream(spark.readStream.schema(rows.schema).parquet(src), path, state).awaitTermination()
    sinks.prune_alert_table(spark, path, 20, fx.AS_OF, offset_hours=0)
    end = as_datetime(fx.AS_OF) - dt.timedelta(days=2)
    return within(live.alert_table(spark, path, end=end), end=end).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("*").alias("n"), F.sum("alert_id").alias("ids"))


@query("s6_backfill", check("""
SELECT 'inserted' AS outcome, count(DISTINCT (device_name, mnemonic, timestamp)) AS n FROM enriched
  WHERE (device_name, mnemonic, timestamp) NOT IN (SELECT (device_name, mnemonic, timestamp) FROM stored)
UNION ALL SELECT 'skipped', count(*) - (SELECT count(DISTINCT (device_name, mnemonic, timestamp)) FROM enriched
  WHERE (device_name, mnemonic, timestamp) NOT IN (SELECT (device_name, mnemonic, timestamp) FROM stored)) FROM enriched
UNION ALL SELECT 'failed', (SELECT count(*) FROM lines) - count(*) FROM enriched""", "enriched",
    stored="SELECT * FROM enriched WHERE event_id % 5 = 0"))
def _(spark, sf):
    rows = enriched(spark, sf)
    bad = parse.quarantine(fx.lines(spark, sf).drop("us"), fx.AS_OF_LINES)
    return syslog.backfill(rows, bad, rows.where("event_id % 5 = 0"))[1]


@query("s7_export_csv", check(f"""
SELECT CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
    ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp, device_name AS device, mnemonic, classification,
  message, interface_name AS interface, client_name AS client, as_name, coalesce(incident_id, '') AS incident_id
FROM alerts WHERE timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 7 DAY
ORDER BY alerts.timestamp DESC, alert_id DESC""", "alerts"))
def _(spark, sf):
    path = _scratch(spark, "csv")
    sinks.export_alerts_csv(alerts(spark, sf), path, "7d", fx.AS_OF)
    back = spark.read.option("header", True).option("escape", '"').schema(
        ", ".join(f"{c} string" for c in fixed.CSV_COLUMNS)).csv(path)
    return back.na.fill("")


INTERFACE_LINES = """
SELECT p_partkey AS line_no, CASE p_partkey % 13
    WHEN 0 THEN '' WHEN 1 THEN '# comment | a | b' WHEN 2 THEN concat('HOST-', CAST(p_partkey % 50 AS STRING), ' | only two')
    ELSE concat('  HOST-', CAST(p_partkey % 50 AS STRING), ' | TenGigE0/0/0/', CAST(p_size % 8 AS STRING),
      CASE WHEN p_partkey % 3 = 0 THEN ' l2transport' ELSE '' END, ' | ', p_name,
      CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' | -' WHEN 2 THEN ' | —' ELSE concat(' | Bundle-Ether', CAST(p_size AS STRING)) END,
      ' ') END AS value
FROM part
"""


@query("s8_interface_dim", check(r"""
SELECT hostname, interface, arg_max(description, line_no) AS description,
  nullif(arg_max(bundle, line_no), '') AS bundle FROM (
  SELECT line_no, trim(p[1]) AS hostname, regexp_replace(trim(p[2]), '\s+l2transport$', '') AS interface,
    trim(p[3]) AS description, CASE WHEN len(p) < 4 OR trim(p[4]) IN ('', '-', '—', '–') THEN '' ELSE trim(p[4]) END AS bundle
  FROM (SELECT line_no, string_split(trim(value), '|') AS p FROM ilines
        WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')) a WHERE len(p) >= 3) b
GROUP BY hostname, interface""", ilines=INTERFACE_LINES))
def _(spark, sf):
    return dims.parse_interface_lines(fx.derive(spark, sf, INTERFACE_LINES))


@query("s9_prune_alerts", check(
    f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS kept FROM alerts "
    f"WHERE timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 6 HOUR - INTERVAL 10 DAY GROUP BY 1", "alerts"))
def _(spark, sf):
    path = _scratch(spark, "retention")
    sinks.write_alerts(alerts(spark, sf), path)
    sinks.prune_alert_table(spark, path, 10, fx.AS_OF)
    return spark.read.parquet(path).groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(
        F.count("*").alias("kept"))


@query("s9_prune_hourly", check(f"""
SELECT device_name, strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H') AS hour,
  CAST(count(*) FILTER (classification = 'CRITICAL') AS BIGINT) AS critical_count FROM alerts
GROUP BY 1, 2 HAVING min(date_trunc('hour', timestamp)) >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 6 HOUR - INTERVAL 5 DAY""", "alerts"))
def _(spark, sf):
    hourly = stats.hourly_stats(alerts(spark, sf), fx.AS_OF, days=400)
    return sinks.prune_hourly(hourly, fx.AS_OF, 5).select(
        "device_name", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "critical_count")


# ------------------------------------------------------------------------------------ rows

@query("p1_parse_header", check(
    "SELECT event_id, source_ip, hostname, rp_location, facility, subfacility, severity_level, mnemonic, message "
    "FROM parsed", "parsed"))
def _(spark, sf):
    return parsed(spark, sf).select("event_id", "source_ip", "hostname", "rp_location", "facility",
                                    "subfacility", "severity_level", "mnemonic", "message")


@query("p2_inner_timestamp", check(f"""
SELECT id, CASE WHEN base IS NOT NULL THEN {sts("try_cast(concat(y + CASE WHEN mo > am + 1 THEN -1 WHEN am >= 11 AND mo <= 2 THEN 1 ELSE 0 END, rest) AS TIMESTAMP)")} END AS parsed
FROM (SELECT *, CASE WHEN CAST(i.h AS INT) < 24 AND CAST(i.s AS INT) < 60 THEN try_cast(concat(y, rest) AS TIMESTAMP) END AS base
 FROM (SELECT *, year(CAST(as_of AS TIMESTAMP)) AS y, month(CAST(as_of AS TIMESTAMP)) AS am, CAST({MONTH_CASE} AS INT) AS mo,
   concat('-', {MONTH_CASE}, '-', lpad(i.d, 2, '0'), ' ', i.h, ':', i.mi, ':', i.s, '.', rpad(left(i.f, 6), 6, '0')) AS rest
  FROM (SELECT *, regexp_extract(inner_ts, '{INNER}', ['mon', 'd', 'h', 'mi', 's', 'f']) AS i FROM inner_times) a) b) c""",
    "inner_times"))
def _(spark, sf):
    rows = shared(spark, sf, "INNER_TIMES")
    return rows.select("id", ts(times.parse_inner_ts(F.col("inner_ts"), F.col("as_of")), "parsed"))


@query("p3_quarantine", check(f"""
SELECT event_id, CASE WHEN NOT regexp_matches(raw, '\\S') THEN 'empty' WHEN length(raw) > 8192 THEN 'too_long'
    WHEN event_id IN (SELECT event_id FROM looks) THEN 'bad_timestamp' ELSE 'no_match' END AS reject_reason
FROM damaged WHERE event_id NOT IN (SELECT event_id FROM good)""", "damaged",
    good=parsed_sql("damaged"),
    looks=f"SELECT event_id FROM damaged WHERE length(raw) <= 8192 AND regexp_matches(raw, '{q(parse.HEADER)}')"))
def _(spark, sf):
    rows = shared(spark, sf, "DAMAGED", lines=fx.lines(spark, sf))
    return parse.quarantine(rows, fx.AS_OF_LINES).select("event_id", "reject_reason")


@query("p4_classify", check("SELECT event_id, rule_id, classification, event_type, "
                            f"{rule_case('notify')} AS notify FROM classified", "classified"))
def _(spark, sf):
    return classified(spark, sf).select("event_id", "rule_id", "classification", "event_type", "notify")


@query("p4_class_counts", check("SELECT classification, rule_id, count(*) AS n FROM classified GROUP BY 1, 2", "classified"))
def _(spark, sf):
    return classified(spark, sf).groupBy("classification", "rule_id").agg(F.count("*").alias("n"))


@query("p5_extract_interface", check(
    f"SELECT event_id, {interface_sql('message')} AS interface_name FROM parsed", "parsed"))
def _(spark, sf):
    return parsed(spark, sf).select("event_id", text.extract_interface(F.col("message")).alias("interface_name"))


@query("p6_extract_bgp", check(
    "SELECT event_id, bgp_neighbor, coalesce(as_number, -1) AS as_number, vrf FROM fields", "fields"))
def _(spark, sf):
    return fields(spark, sf).select(
        "event_id", "bgp_neighbor", F.coalesce("as_number", F.lit(-1)).alias("as_number"), "vrf")


@query("p7_join_device", check(
    "SELECT event_id, device_name, device_location, device_hostname FROM enriched", "enriched"))
def _(spark, sf):
    return enrich.join_device(parsed(spark, sf), fx.dim(spark, "device")).select(
        "event_id", "device_name", "device_location", "device_hostname")


@query("p8_join_interface", check(
    "SELECT event_id, interface_name, interface_description, bundle_parent FROM enriched", "enriched"))
def _(spark, sf):
    df = enrich.join_device(fields(spark, sf), fx.dim(spark, "device"))
    return enrich.join_interface(df, fx.dim(spark, "iface")).select(
        "event_id", "interface_name", "interface_description", "bundle_parent")


@query("p9_derive_client", check(r"""
SELECT p_partkey, CASE WHEN length(d) <= 50 THEN d ELSE regexp_extract(d, '^[^\s/]*') END AS client
FROM (SELECT p_partkey, concat(p_brand, '/', p_type, ' ', repeat(p_name, 1 + p_size % 4)) AS d FROM part) x"""))
def _(spark, sf):
    d = F.concat("p_brand", F.lit("/"), "p_type", F.lit(" "), F.expr("repeat(p_name, 1 + p_size % 4)"))
    return fx.table(spark, sf, "part").select("p_partkey", text.derive_client(d).alias("client"))


CACHE = """
SELECT c_custkey AS asn, concat('NET-', c_name) AS name, c_mktsegment AS as_type, 'lookup' AS source,
  CAST('2024-01-30 00:00:00' AS TIMESTAMP) + (c_custkey % 48 - 24) * INTERVAL '1' HOUR AS cached_at FROM customer
"""
STATIC = "SELECT s_suppkey * 7 AS asn, s_name AS name FROM supplier"


@query("p10_resolve_as", check("""
SELECT o_orderkey, CASE WHEN asn <= 0 THEN '' ELSE coalesce(s.name, c.name, '') END AS as_name
FROM (SELECT o_orderkey, o_custkey - 5 AS asn FROM orders) o LEFT JOIN st s USING (asn)
LEFT JOIN (SELECT asn, name FROM cache WHERE cached_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR + INTERVAL 12 HOUR) c USING (asn)""",
    st=STATIC, cache=CACHE))
def _(spark, sf):
    asns = fx.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") - 5).alias("asn"))
    out = enrich.resolve_as(asns, fx.derive(spark, sf, STATIC), fx.derive(spark, sf, CACHE), "2024-01-30 12:00:00")
    return out.select("o_orderkey", "as_name")


@query("p10_join_as", check("SELECT event_id, as_number, as_name FROM enriched WHERE as_number IS NOT NULL", "enriched"))
def _(spark, sf):
    return enrich.join_as(fields(spark, sf), fx.dim(spark, "as_dim")).where("as_number IS NOT NULL").select(
        "event_id", "as_number", "as_name")


@query("p11_upsert_as_cache", check(f"""
SELECT coalesce(n.asn, c.asn) AS asn, coalesce(n.name, c.name) AS name, CASE WHEN n.asn IS NOT NULL
    THEN '2024-02-01 00:00:00.000000' ELSE {sts('c.cached_at')} END AS cached_at
FROM cache c FULL JOIN (SELECT s_suppkey * 5 AS asn, s_name AS name FROM supplier) n ON n.asn = c.asn""", cache=CACHE))
def _(spark, sf):
    new = fx.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 5).alias("asn"), F.col("s_name").alias("name"), F.lit("ISP").alias("as_type"),
        F.lit("lookup").alias("source"))
    out = enrich.upsert_as_cache(fx.derive(spark, sf, CACHE), new, "2024-02-01 00:00:00")
    return out.select("asn", "name", ts("cached_at"))


@query("p12_render_summary", check(f"""
SELECT event_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '{{device}}', device_name),
  '{{neighbor}}', bgp_neighbor), '{{as_number}}', coalesce(CAST(as_number AS VARCHAR), '')), '{{interface}}', interface_name),
  '{{bundle}}', regexp_extract(message, 'Bundle-Ether\\d+')), '{{prefix_count}}', regexp_extract(message, 'has reached (\\d+)', 1)),
  '{{max_prefixes}}', regexp_extract(message, '\\bmax (\\d+)', 1)), '{{user}}', regexp_extract(message, '[uU]ser ''([^'']*)''', 1)),
  '{{source_ip}}', regexp_extract(message, 'from ''([^'']*)''', 1)) AS summary
FROM (SELECT *, {rule_case('summary_template')} AS t FROM enriched) x""", "enriched"))
def _(spark, sf):
    return enrich.render_summary(enriched(spark, sf)).select("event_id", "summary")


@query("p13_extract_login", check(r"""
SELECT event_id, regexp_extract(message, '[uU]ser ''([^'']*)''', 1) AS username,
  regexp_extract(message, 'from ''([^'']*)''', 1) AS login_ip, regexp_extract(message, 'on ''([^'']*)''', 1) AS vty,
  regexp_extract(message, 'cipher ''([^'']*)''', 1) AS cipher,
  CASE WHEN rule_id = 'SSH_LOGIN' THEN 'login' ELSE 'logout' END AS action
FROM classified WHERE rule_id IN ('SSH_LOGIN', 'SSH_LOGOUT')""", "classified"))
def _(spark, sf):
    return enrich.extract_login(classified(spark, sf)).select(
        "event_id", "username", "login_ip", "vty", "cipher", "action")


@query("p14_extract_maxpfx", check(r"""
SELECT event_id, regexp_extract(message, 'from (\S+)', 1) AS peer,
  CAST(regexp_extract(message, 'reached (\d+)', 1) AS BIGINT) AS prefix_count,
  CAST(regexp_extract(message, 'max (\d+)', 1) AS BIGINT) AS max_prefixes
FROM classified WHERE mnemonic = 'MAXPFX'""", "classified"))
def _(spark, sf):
    return enrich.extract_maxpfx(parsed(spark, sf)).select("event_id", "peer", "prefix_count", "max_prefixes")


@query("p16_is_recovery", check(f"SELECT event_id, {recovery_sql(rule='rule_id')} AS is_recovery FROM classified", "classified"))
def _(spark, sf):
    return enrich.with_recovery(classified(spark, sf)).select("event_id", "is_recovery")


@query("p17_hardware_noise", check("""
SELECT event_id, CASE WHEN mnemonic IN ('RX_FAULT', 'SIGNAL', 'RFI') AND (source_ip, interface_name) IN
  (SELECT (ip, member) FROM topo) THEN 'NOISE' ELSE classification END AS classification FROM fields""", "fields", "topo"))
def _(spark, sf):
    return enrich.hardware_noise(fields(spark, sf), fx.dim(spark, "topo")).select("event_id", "classification")


@query("p18_event_bundle", check("SELECT event_id, event_bundle, event_remote FROM ev", "ev"))
def _(spark, sf):
    return enrich.event_bundle(fields(spark, sf), fx.dim(spark, "topo"), fx.dim(spark, "bgp_bundle")).select(
        "event_id", "event_bundle", "event_remote")


@query("p19_incident_title", check(f"SELECT event_id, {title_sql()} AS title FROM enriched", "enriched"))
def _(spark, sf):
    return enrich.with_title(enriched(spark, sf)).select("event_id", "title")


@query("p19_alert_title", check(f"SELECT alert_id, {title_sql()} AS title FROM alerts", "alerts"))
def _(spark, sf):
    return enrich.with_title(alerts(spark, sf)).select("alert_id", "title")


@query("p20_group_key", check(f"SELECT alert_id, {GROUP_KEY} AS group_key FROM alerts", "alerts"))
def _(spark, sf):
    return enrich.with_group_key(alerts(spark, sf)).select("alert_id", "group_key")


@query("p21_shift_of", check(f"""
SELECT event_id, CASE WHEN m >= 480 AND m < 900 THEN 'morning' WHEN m >= 900 AND m < 1350 THEN 'evening' ELSE 'night' END AS name,
  {sts("d + INTERVAL 1 MINUTE * CASE WHEN m < 480 THEN -90 WHEN m < 900 THEN 480 WHEN m < 1350 THEN 900 ELSE 1350 END")} AS start_at,
  {sts("d + INTERVAL 1 MINUTE * CASE WHEN m < 480 THEN 480 WHEN m < 900 THEN 900 WHEN m < 1350 THEN 1350 ELSE 1920 END")} AS end_at
FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, date_trunc('day', ts) AS d FROM events) x"""))
def _(spark, sf):
    s = fx.table(spark, sf, "events").select("event_id", times.shift_of(F.col("ts")).alias("s"))
    return s.select("event_id", "s.name", ts("s.start", "start_at"), ts("s.end", "end_at"))


_PERIOD_SQL = {
    "today": "timestamp >= date_trunc('day', a)", "yesterday":
    "timestamp >= date_trunc('day', a) - INTERVAL 1 DAY AND timestamp < date_trunc('day', a)",
    "7d": "timestamp >= a - INTERVAL 7 DAY", "30d": "timestamp >= a - INTERVAL 30 DAY",
    "1y": "timestamp >= a - INTERVAL 365 DAY", "all": "true",
}


@query("p22_period_filter", check(" UNION ALL ".join(
    f"SELECT '{p}' AS period, count(*) AS n, CAST(sum(alert_id) AS BIGINT) AS ids FROM alerts, "
    f"(SELECT TIMESTAMP '2024-01-28 15:30:00' AS a) r WHERE {c}" for p, c in _PERIOD_SQL.items()), "alerts"))
def _(spark, sf):
    out = None
    for p in fixed.PERIODS:
        one = read.period_filter(alerts(spark, sf), p, "2024-01-28 15:30:00").agg(
            F.count("*").alias("n"), F.sum("alert_id").alias("ids")).select(F.lit(p).alias("period"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("p23_search_alerts", check("""
SELECT alert_id FROM alerts WHERE classification = 'CRITICAL' AND contains(lower(concat_ws(' ', nullif(device_name, ''),
  nullif(mnemonic, ''), nullif(message, ''), nullif(as_name, ''), nullif(client_name, ''))), 'down - bgp notification sent (vrf')""", "alerts"))
def _(spark, sf):
    return read.search_alerts(alerts(spark, sf), "Down - BGP Notification sent (VRF", "CRITICAL").select("alert_id")


@query("p24_reclassify", check(f"""
SELECT alert_id, classification AS old_classification, now AS classification FROM (
  SELECT *, {rule_case('classification')} AS now FROM alerts
  WHERE timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 7 DAY AND raw LIKE 'Jan%'
    AND NOT (mnemonic IN ('RX_FAULT', 'SIGNAL', 'RFI') AND classification = 'NOISE')) x WHERE now <> classification""", "alerts"))
def _(spark, sf):
    return classify.reclassify(alerts(spark, sf), fx.AS_OF)


@query("p24_apply_reclassification", check(f"""
SELECT classification, count(*) AS n FROM (SELECT CASE WHEN timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 7 DAY AND raw LIKE 'Jan%'
  AND NOT (mnemonic IN ('RX_FAULT', 'SIGNAL', 'RFI') AND classification = 'NOISE') THEN {rule_case('classification')}
  ELSE classification END AS classification FROM alerts) x GROUP BY 1""", "alerts"))
def _(spark, sf):
    a = alerts(spark, sf)
    return classify.apply_reclassification(a, classify.reclassify(a, fx.AS_OF)).groupBy("classification").agg(
        F.count("*").alias("n"))


@query("p25_sanitise", check(r"""
SELECT doc_id, CASE WHEN length(c) > 1024 THEN concat(left(c, 1023), '…') ELSE c END AS clean
FROM (SELECT doc_id, regexp_replace(concat(text, chr(7), chr(127)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS c FROM documents) x"""))
def _(spark, sf):
    dirty = F.concat("text", F.lit("\x07\x7f"))
    return fx.table(spark, sf, "documents").select("doc_id", text.sanitise(dirty).alias("clean"))
