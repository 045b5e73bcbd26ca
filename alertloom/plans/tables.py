"""Queries for resolution (R), notification (N) and paged reads (Q)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.times import to_us
from ..operators import classify, correlate, dedup, notify, read, resolve
from ..session import materialize, shared_dir
from ..sources import sinks, table
from . import fixtures as fx
from .checks import CTES, GROUP_KEY, MSG_IFACE, STATE_KEY, check, recovery_sql, title_sql, ts as sts
from .folds import incident_table, link_events
from .registry import CHECKS, alerts, enriched, events, query, shared, ts

S = 1_000_000
REC = recovery_sql()
HARD = "('RX_FAULT', 'SIGNAL', 'RFI')"
ASN = "coalesce(as_number, 0)"


def _resolved(df, *extra):
    return df.where("resolved_at IS NOT NULL").select(
        "alert_id", ts("resolved_at"), "resolution_reason", *extra)


RESOLVED = f"alert_id, {sts('resolved_at')} AS resolved_at, resolution_reason"

CTES.update({
    "recs": (["alerts"], f"""SELECT alert_id, timestamp, device_name, mnemonic, source_ip, bgp_neighbor, {ASN} AS asn,
        coalesce(nullif(interface_name, ''), {MSG_IFACE}, '') AS ifc FROM alerts WHERE {REC}"""),
    "r1": (["recs"], """SELECT a.alert_id, min(r.timestamp) AS at FROM alerts a JOIN recs r ON r.device_name = a.device_name
        AND r.timestamp <= a.timestamp + INTERVAL 24 HOUR AND (r.timestamp, r.alert_id) >= (a.timestamp, a.alert_id)
        AND ((r.ifc <> '' AND a.interface_name = r.ifc)
          OR (r.mnemonic = 'ADJCHANGE' AND r.bgp_neighbor <> '' AND a.mnemonic = 'ADJCHANGE'
              AND (a.bgp_neighbor = r.bgp_neighbor OR (r.asn <> 0 AND coalesce(a.as_number, 0) = r.asn)))
          OR (r.ifc = '' AND NOT (r.mnemonic = 'ADJCHANGE' AND r.bgp_neighbor <> '') AND r.mnemonic = 'ACTIVE' AND a.mnemonic = 'ACTIVE'))
      WHERE a.classification = 'CRITICAL' AND a.resolved_at IS NULL GROUP BY a.alert_id"""),
    "r2": (["recs", "topo", "bgp_bundle"], f"""SELECT a.alert_id, min(r.timestamp) AS done FROM alerts a JOIN recs r ON r.device_name = a.device_name
        AND r.mnemonic = 'ADJCHANGE' AND r.timestamp <= a.timestamp + INTERVAL 24 HOUR AND (r.timestamp, r.alert_id) >= (a.timestamp, a.alert_id)
      JOIN bgp_bundle b ON b.ip = r.source_ip AND b.neighbor = r.bgp_neighbor
      JOIN topo t ON t.ip = r.source_ip AND t.bundle = b.bundle AND t.member = a.interface_name
      WHERE a.mnemonic IN {HARD} AND a.resolved_at IS NULL GROUP BY a.alert_id"""),
})


@query("r1_resolve_by_recovery", check(f"""
SELECT {RESOLVED} FROM (SELECT a.alert_id, coalesce(a.resolved_at, r1.at) AS resolved_at,
  CASE WHEN a.resolved_at IS NULL THEN 'recovery_event' ELSE resolution_reason END AS resolution_reason
  FROM alerts a LEFT JOIN r1 USING (alert_id)) x WHERE resolved_at IS NOT NULL""", "r1"))
def _(spark, sf):
    a = alerts(spark, sf)
    rec = a.where(text.is_recovery(F.col("mnemonic"), F.col("message")))
    return _resolved(resolve.resolve_by_recovery(a, rec))


@query("r2_resolve_silent_faults", check("SELECT alert_id, " + sts("done") + " AS resolved_at FROM r2", "r2"))
def _(spark, sf):
    a = alerts(spark, sf)
    ups = a.where((F.col("mnemonic") == "ADJCHANGE") & text.is_recovery(F.col("mnemonic"), F.col("message")))
    out = resolve.resolve_silent_faults(a, ups, fx.dim(spark, "topo"), fx.dim(spark, "bgp_bundle"))
    return out.where("resolution_reason = 'bgp_up_inferred'").select("alert_id", ts("resolved_at"))


@query("r3_resolve_noise", check(f"""
SELECT classification, resolution_reason, count(*) AS n, count(resolved_at) AS resolved FROM (
  SELECT CASE WHEN hit THEN 'NOISE' ELSE classification END AS classification,
    CASE WHEN hit THEN 'noise_toggle_enabled' ELSE resolution_reason END AS resolution_reason,
    CASE WHEN hit THEN TIMESTAMP '{fx.AS_OF}' ELSE resolved_at END AS resolved_at
  FROM (SELECT *, mnemonic IN {HARD} AND resolved_at IS NULL AS hit FROM alerts) a) b GROUP BY 1, 2""", "alerts"))
def _(spark, sf):
    return resolve.resolve_noise(alerts(spark, sf), fx.AS_OF).groupBy("classification", "resolution_reason").agg(
        F.count("*").alias("n"), F.count("resolved_at").alias("resolved"))


def _resolved_incidents(spark, sf):
    inc = shared(spark, sf, "INCIDENTS")
    return inc, inc.where("status = 'resolved'").select(
        "id", (F.col("resolved_at") + F.expr("INTERVAL '1' HOUR")).alias("at"))


@query("r4_resolve_incidents", check(f"""
SELECT id, CASE WHEN status = 'resolved' THEN 'resolved' ELSE status END AS status,
  {sts("CASE WHEN status = 'resolved' THEN resolved_at + INTERVAL 1 HOUR ELSE resolved_at END")} AS resolved_at FROM incidents""", "incidents"))
def _(spark, sf):
    inc, done = _resolved_incidents(spark, sf)
    return resolve.resolve_incidents(inc, done).select("id", "status", ts("resolved_at"))


@query("r4_resolve_incident_alerts", check(f"""
SELECT alert_id, {sts('coalesce(a.resolved_at, i.resolved_at + INTERVAL 1 HOUR)')} AS resolved_at,
  CASE WHEN a.resolved_at IS NULL THEN 'incident_resolved' ELSE a.resolution_reason END AS resolution_reason
FROM alerts a LEFT JOIN incidents i ON i.id = a.incident_id AND i.status = 'resolved'
WHERE coalesce(a.resolved_at, i.resolved_at) IS NOT NULL""", "alerts", "incidents"))
def _(spark, sf):
    return _resolved(resolve.resolve_incident_alerts(alerts(spark, sf), _resolved_incidents(spark, sf)[1]))


CARD_SQL = f"""SELECT {GROUP_KEY} AS group_key, arg_max(alert_id, (timestamp, alert_id)) AS last_id,
    arg_min(alert_id, (timestamp, alert_id)) AS first_id, count(*) AS alert_count, max(timestamp) AS last_alert
  FROM alerts WHERE classification = 'CRITICAL' AND NOT {REC} GROUP BY 1"""
CTES["cards"] = (["alerts"], f"""SELECT concat('ALERT-', c.first_id) AS card_id, c.group_key, c.alert_count, c.last_alert, a.*,
    a.timestamp AS started_at FROM ({CARD_SQL}) c JOIN alerts a ON a.alert_id = c.first_id""")
CTES["recent_cards"] = (["alerts"], f"""SELECT concat('ALERT-', c.last_id) AS card_id, c.group_key, c.alert_count, c.last_alert, a.*,
    a.timestamp AS started_at FROM ({CARD_SQL}) c JOIN alerts a ON a.alert_id = c.last_id""")


def faults(spark, sf):
    return alerts(spark, sf).where(
        (F.col("classification") == "CRITICAL") & ~text.is_recovery(F.col("mnemonic"), F.col("message")))


def _prune_sql(first: str, mnemonics: str) -> str:
    same = f"concat(mnemonic, '|', coalesce(nullif(interface_name, ''), {MSG_IFACE}, ''))"
    return f"""SELECT card_id FROM (SELECT *, {same} AS card_text FROM cards) c WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT device_name, timestamp, bgp_neighbor, {first} AS ifc, mnemonic,
          coalesce({MSG_IFACE if first == 'interface_name' else first}, '') AS in_text FROM alerts WHERE {REC} {mnemonics}) r
      WHERE r.device_name = c.device_name AND r.timestamp > c.started_at
        AND ((r.ifc <> '' AND r.ifc = c.interface_name) OR (r.bgp_neighbor <> '' AND r.bgp_neighbor = c.bgp_neighbor)
          OR (r.in_text <> '' AND concat(r.mnemonic, '|', r.in_text) = c.card_text)))"""


@query("r5_prune_recovered", check(_prune_sql("interface_name", ""), "cards"))
def _(spark, sf):
    cards = resolve.incident_cards(faults(spark, sf), "live")
    return resolve.prune_recovered(cards, alerts(spark, sf)).select("card_id")


@query("r5_prune_recovered_stored", check(_prune_sql(
    f"coalesce(nullif(interface_name, ''), {MSG_IFACE}, '')", "AND mnemonic IN ('ADJCHANGE', 'UPDOWN', 'ACTIVE')"), "cards"))
def _(spark, sf):
    cards = resolve.incident_cards(faults(spark, sf), "live")
    return resolve.prune_recovered(cards, alerts(spark, sf), from_storage=True).select("card_id")


def _active_sql(limit: str, rec_limit: str) -> dict[str, str]:
    return {
        "crit": f"""SELECT *, {STATE_KEY} AS sk, {REC} AS rec FROM alerts WHERE classification = 'CRITICAL' AND resolved_at IS NULL
            AND mnemonic NOT IN {HARD} ORDER BY alerts.timestamp DESC, alert_id DESC {limit}""",
        "recov": f"""SELECT * FROM (SELECT *, {STATE_KEY} AS sk, {REC} AS rec FROM alerts WHERE mnemonic IN ('ADJCHANGE', 'UPDOWN', 'ACTIVE')
            AND timestamp >= (SELECT min(timestamp) FROM crit) ORDER BY alerts.timestamp DESC, alert_id DESC {rec_limit}) r WHERE rec""",
        "state": """SELECT sk, arg_max(rec, (timestamp, o, alert_id)) AS ended FROM (
            SELECT sk, timestamp, 1 AS o, alert_id, rec FROM crit UNION ALL SELECT sk, timestamp, 0, alert_id, rec FROM recov) s GROUP BY sk""",
        "act": "SELECT c.* FROM crit c JOIN state s USING (sk) WHERE NOT c.rec AND NOT s.ended",
    }


@query("r6_active_alerts", check("SELECT alert_id FROM act ORDER BY act.timestamp DESC, alert_id DESC LIMIT 50", "alerts", **_active_sql("", "")))
def _(spark, sf):
    return resolve.active_alerts(alerts(spark, sf), page=50).select("alert_id")


@query("r6_active_alerts_all", check("SELECT alert_id FROM act", "alerts", **_active_sql("", "")))
def _(spark, sf):
    return resolve.active_alerts(alerts(spark, sf)).select("alert_id")


CARD_COLS = ["card_id", "group_key", "title", "device_name", "mnemonic", "alert_count"]


def _cards(df):
    return df.select(*CARD_COLS, ts("started_at"), ts("last_alert"))


@query("r7_incident_cards", check(f"""
SELECT card_id, group_key, {title_sql()} AS title, device_name, mnemonic, alert_count, {sts('started_at')} AS started_at,
  {sts('last_alert')} AS last_alert FROM recent_cards""", "recent_cards"))
def _(spark, sf):
    return _cards(resolve.incident_cards(faults(spark, sf)))


@query("r7_live_cards", check(f"""
SELECT card_id, group_key, {title_sql()} AS title, device_name, mnemonic, alert_count, {sts('started_at')} AS started_at,
  {sts('last_alert')} AS last_alert FROM cards""", "cards"))
def _(spark, sf):
    return _cards(resolve.incident_cards(faults(spark, sf), "live"))


@query("r8_restore_acks", check(f"""
SELECT card_id, {sts('coalesce(k.at, acknowledged_at)')} AS acknowledged_at, coalesce(k.op, '') AS acknowledged_by,
  coalesce(k.note, '') AS ack_comment
FROM recent_cards c LEFT JOIN (SELECT incident_id, max(created_at) AS at, arg_max(operator_name, (created_at, operator_name, comment)) AS op,
  arg_max(comment, (created_at, operator_name, comment)) AS note FROM alert_acks GROUP BY 1) k ON k.incident_id = c.card_id""",
    "recent_cards", "alert_acks"))
def _(spark, sf):
    out = resolve.restore_acks(resolve.incident_cards(faults(spark, sf)), shared(spark, sf, "ALERT_ACKS"))
    return out.select("card_id", ts("acknowledged_at"), F.coalesce("acknowledged_by", F.lit("")).alias("acknowledged_by"),
                      F.coalesce("ack_comment", F.lit("")).alias("ack_comment"))


@query("r9_apply_acks", check(f"""
SELECT alert_id, {sts('coalesce(o.at, acknowledged_at, i.at)')} AS acknowledged_at FROM alerts a
LEFT JOIN (SELECT CAST(replace(incident_id, 'ALERT-', '') AS BIGINT) AS alert_id, max(created_at) AS at FROM alert_acks
  WHERE incident_id LIKE 'ALERT-%' GROUP BY 1) o USING (alert_id)
LEFT JOIN (SELECT incident_id, min(created_at) AS at FROM alert_acks WHERE incident_id LIKE 'INC-%' GROUP BY 1) i USING (incident_id)
WHERE coalesce(o.at, acknowledged_at, i.at) IS NOT NULL""", "alerts", "alert_acks"))
def _(spark, sf):
    out = resolve.apply_acks(alerts(spark, sf), shared(spark, sf, "ALERT_ACKS"))
    return out.where("acknowledged_at IS NOT NULL").select("alert_id", ts("acknowledged_at"))


# -------------------------------------------------------------------------------- notification

@query("n1_meets_threshold", check(" UNION ALL ".join(
    f"SELECT '{f}' AS floor, count(*) AS n FROM alerts WHERE CASE classification WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 "
    f"WHEN 'CRITICAL' THEN 3 ELSE 0 END >= {r}" for f, r in
    (("INFO", 1), ("WARNING", 2), ("CRITICAL", 3), ("odd", 3))), "alerts"))
def _(spark, sf):
    floors = ["INFO", "WARNING", "CRITICAL", "odd"]
    one = alerts(spark, sf).agg(*[F.count_if(notify.meets_threshold(F.col("classification"), f)).alias(f) for f in floors])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("floor"), F.col(f).alias("n")) for f in floors])))


MUTED = "EXISTS (SELECT 1 FROM maintenance w WHERE w.device_name = {0}.device_name AND {0}.timestamp BETWEEN w.start_time AND w.end_time)"


@query("n2_under_maintenance", check(
    f"SELECT alert_id, {MUTED.format('a')} AS in_maintenance FROM alerts a", "alerts", "maintenance"))
def _(spark, sf):
    return notify.under_maintenance(alerts(spark, sf), shared(spark, sf, "MAINTENANCE")).select("alert_id", "in_maintenance")


@query("n3_active_windows", check(
    f"SELECT id, device_name, {sts('start_time')} AS start_time FROM maintenance WHERE end_time >= TIMESTAMP '2024-01-15 10:00:00'", "maintenance"))
def _(spark, sf):
    return notify.active_windows(shared(spark, sf, "MAINTENANCE"), "2024-01-15 10:00:00").select("id", "device_name", ts("start_time"))


ACKED_CARDS = """SELECT card_id, group_key, CASE WHEN k.at IS NOT NULL THEN k.at ELSE acknowledged_at END AS acknowledged_at
  FROM recent_cards c LEFT JOIN (SELECT incident_id, max(created_at) AS at FROM alert_acks GROUP BY 1) k ON k.incident_id = c.card_id
  UNION ALL SELECT incident_id, 'none', min(created_at) FROM alert_acks WHERE incident_id LIKE 'INC-%' GROUP BY 1"""
CTES["acked"] = (["recent_cards", "alert_acks"], ACKED_CARDS)


def acked_cards(spark, sf):
    acks = shared(spark, sf, "ALERT_ACKS")
    cards = resolve.restore_acks(resolve.incident_cards(faults(spark, sf)), acks).select("card_id", "group_key", "acknowledged_at")
    inc = acks.where("incident_id LIKE 'INC-%'").groupBy(F.col("incident_id").alias("card_id")).agg(
        F.min("created_at").alias("acknowledged_at"))
    return cards.unionByName(inc.select("card_id", F.lit("none").alias("group_key"), "acknowledged_at"))


ACK_MUTED = f"""CASE WHEN coalesce(incident_id, '') <> '' THEN EXISTS (SELECT 1 FROM acked k WHERE k.card_id = a.incident_id AND k.acknowledged_at <= a.timestamp)
  ELSE EXISTS (SELECT 1 FROM acked k WHERE k.card_id NOT LIKE 'INC-%' AND k.group_key = a.gk AND k.acknowledged_at <= a.timestamp) END"""


@query("n4_ack_suppressed", check(
    f"SELECT alert_id, {ACK_MUTED} AS ack_muted FROM (SELECT *, {GROUP_KEY} AS gk FROM alerts) a", "alerts", "acked"))
def _(spark, sf):
    from ..operators.enrich import with_group_key

    return notify.ack_suppressed(with_group_key(alerts(spark, sf)), acked_cards(spark, sf)).select("alert_id", "ack_muted")


CTES["dec"] = (["corr", "d4", "ev", "ids"], f"""SELECT e.seq, e.us, e.timestamp, e.device_name, e.mnemonic, e.message, e.classification, e.is_recovery,
    e.interface_name, e.bgp_neighbor, d4.reason, d4.reason IN ('new', 'flapping') AS should_send, c.is_symptom, e.event_type,
    CASE WHEN ids.incident_id IS NULL THEN '' ELSE ids.incident_id END AS incident_id,
    d4.reason IN ('new', 'flapping') AND e.classification = 'CRITICAL' AND NOT c.is_symptom AND e.mnemonic <> 'MAXPFX' AS sent
  FROM ev e JOIN d4 ON d4.seq = e.seq JOIN corr c ON c.seq = e.seq
  LEFT JOIN ids ON ids.kind = c.inc_kind AND ids.key = c.inc_key AND ids.inc = c.inc""")
LINE_WINDOWS = """SELECT s_suppkey AS id, concat('rtr-', CAST(s_suppkey % 6 AS STRING)) AS device_name,
  CAST('2026-05-20 00:00:00' AS TIMESTAMP) + s_suppkey * INTERVAL '1' HOUR AS start_time,
  CAST('2026-05-20 01:30:00' AS TIMESTAMP) + s_suppkey * INTERVAL '1' HOUR AS end_time FROM supplier"""
CTES["line_windows"] = ([], LINE_WINDOWS)
LINE_MUTED = MUTED.replace("maintenance", "line_windows")


def decided(spark, sf):
    return decided_with_incidents(spark, sf)[0]


def decided_with_incidents(spark, sf):
    """(events with every flag of a decision, openings); MAXPFX muted, maintenance on, nothing
    acknowledged."""
    ev, shown, opens = incident_table(spark, sf)
    corr = shown.select("seq", "is_symptom", "suppress_notification", "incident_id")
    rows = ev.join(dedup.should_notify(ev), "seq").join(corr, "seq")
    rows = rows.withColumn("ack_muted", F.lit(False))
    rows = notify.under_maintenance(rows, fx.derive(spark, sf, LINE_WINDOWS))
    return notify.will_notify(rows, maxpfx_enabled=False), opens


@query("n5_will_notify", check(f"""
SELECT seq, sent AS notification_sent, sent AND NOT {LINE_MUTED.format('e')} AS will_notify FROM dec e""", "dec", "line_windows", recursive=True))
def _(spark, sf):
    return decided(spark, sf).select("seq", "notification_sent", "will_notify")


@query("n6_route", check("""
SELECT seq, should_send OR is_recovery AS to_store,
  (should_send OR is_recovery OR classification = 'CRITICAL') AND mnemonic <> 'MAXPFX' AS to_tracker,
  should_send AND mnemonic <> 'MAXPFX' AS to_broadcast FROM dec""", "dec", recursive=True))
def _(spark, sf):
    return notify.route(decided(spark, sf)).select("seq", "to_store", "to_tracker", "to_broadcast")


def _peer_sql() -> str:
    return ("concat(bgp_neighbor, CASE WHEN as_number IS NOT NULL AND as_name <> '' THEN concat(' (AS', as_number, ' ', as_name, ')') "
            "WHEN as_number IS NOT NULL THEN concat(' (AS', as_number, ')') ELSE '' END)")


IFACE_TEXT = "concat(interface_name, CASE WHEN interface_description <> '' THEN concat(' — ', interface_description) ELSE '' END)"
EMOJI = "CASE classification " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SEVERITY_EMOJI.items()) + " ELSE '⚪' END"


def _field(name: str, value: str, inline: bool = True) -> str:
    return (f"CASE WHEN {value} <> '' THEN concat('{{\"name\":\"{name}\",\"value\":\"', {value}, "
            f"'\",\"inline\":{'true' if inline else 'false'}}}') END")


STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S UTC+06:00')"
FIELDS_SQL = ", ".join([
    _field("Device", "device_name"), _field("Location", "device_location"), _field("Event", "event_type"),
    f"CASE WHEN bgp_neighbor <> '' THEN {_field('BGP Peer', _peer_sql(), False)} END",
    f"CASE WHEN interface_name <> '' THEN {_field('Interface', IFACE_TEXT, False)} END",
    _field("VRF", "vrf"), _field("Client", "client_name"),
    _field("Incident", "inc"), f"CASE WHEN inc <> '' THEN {_field('Related Events', 'rel')} END"])


@query("n7_alert_outbox", check(rf"""
SELECT seq, concat({EMOJI}, ' ', classification, ' — ', event_type) AS title,
  concat_ws(',', {FIELDS_SQL}) AS fields,
  concat_ws(chr(10), concat('*', {EMOJI}, ' ', classification, ' — ', event_type, '*'), '', concat('*Device:* ', device_name),
    CASE WHEN device_location <> '' THEN concat('*Location:* ', device_location) END,
    CASE WHEN bgp_neighbor <> '' THEN concat('*Peer:* `', {_peer_sql()}, '`') END,
    CASE WHEN interface_name <> '' THEN concat('*Interface:* `', {IFACE_TEXT}, '`') END,
    CASE WHEN vrf <> '' THEN concat('*VRF:* ', vrf) END, CASE WHEN client_name <> '' THEN concat('*Client:* ', client_name) END,
    CASE WHEN inc <> '' THEN concat('*Incident:* `', inc, '`') END, CASE WHEN inc <> '' THEN concat('*Related Events:* ', rel) END,
    '', concat('_', {STAMP}, '_')) AS text
FROM (SELECT *, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN concat('INC-', event_id) ELSE '' END AS inc,
  CAST(event_id % 5 AS VARCHAR) AS rel FROM enriched) x""", "enriched"))
def _(spark, sf):
    rows = enriched(spark, sf).withColumns({
        "incident_id": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("INC-"), F.col("seq").cast("string"))),
        "related_count": F.col("seq") % 5})
    out = notify.notification_outbox(rows)
    inner = F.regexp_extract("payload", r'"fields":\[(.*?)\],"footer"', 1)
    return out.select("seq", "title", inner.alias("fields"), "text")


@query("n7_resolution_outbox", check(rf"""
SELECT event_id AS seq, concat('✅ RESOLVED — ', device_name) AS title,
  concat_ws(chr(10), concat('*✅ RESOLVED — ', device_name, '*'), concat('Incident `INC-', event_id, '` resolved'), '',
    concat('*Event:* ', event_type), CASE WHEN device_location <> '' THEN concat('*Location:* ', device_location) END,
    CASE WHEN interface_name <> '' THEN concat('*Interface:* `', {IFACE_TEXT}, '`') END,
    CASE WHEN bgp_neighbor <> '' THEN concat('*Peer:* `', {_peer_sql()}, '`') END, '', concat('_', {STAMP}, '_')) AS text
FROM ev WHERE is_recovery""", "ev"))
def _(spark, sf):
    rows = events(spark, sf).where("is_recovery").withColumn(
        "incident_id", F.concat(F.lit("INC-"), F.col("seq").cast("string")))
    return notify.notification_outbox(rows, "resolution").select("seq", "title", "text")


@query("n7_escalation_outbox", check(rf"""
SELECT event_id AS seq, concat('🚨 ESCALATION — ', device_name) AS title,
  concat_ws(chr(10), concat('*⚠️ ESCALATION — ', device_name, '*'), concat('*', mnemonic, '*'), '',
    concat('*Unacknowledged for ', event_id % 90, ' minutes*'), 'CRITICAL alert requires immediate attention', '',
    CASE WHEN interface_name <> '' THEN concat('*Interface:* `', {IFACE_TEXT}, '`') END,
    CASE WHEN bgp_neighbor <> '' THEN concat('*Peer:* `', {_peer_sql()}, '`') END,
    CASE WHEN device_location <> '' THEN concat('*Location:* ', device_location) END,
    '', concat('*Original Alert:* _', {STAMP}, '_')) AS text
FROM enriched WHERE classification = 'CRITICAL'""", "enriched"))
def _(spark, sf):
    rows = enriched(spark, sf).where("classification = 'CRITICAL'").withColumn("elapsed_minutes", F.col("seq") % 90)
    return notify.notification_outbox(rows, "escalation").select("seq", "title", "text")


LAST = "(SELECT max(us) FROM dec)"
CTES["tracked"] = (["dec"], "SELECT seq, us, device_name, mnemonic, coalesce(nullif(bgp_neighbor, ''), interface_name) AS disc FROM dec WHERE sent")
CTES["esc_events"] = (["tracked"], """
  SELECT device_name, mnemonic, disc, us, seq, 0 AS phase, 'track' AS what FROM tracked
  UNION ALL SELECT device_name, mnemonic, coalesce(nullif(bgp_neighbor, ''), interface_name), us, seq, 1, 'recover' FROM dec WHERE is_recovery""")
CTES["esc_acks"] = (["tracked"], "SELECT device_name, mnemonic, us + 400000000 AS us FROM tracked WHERE seq % 7 = 0 AND us + 400000000 <= (SELECT max(us) FROM dec)")
CTES["esc"] = (["esc_events", "esc_acks"], """
  SELECT *, us + 900000000 AS due_us FROM (SELECT t.*,
    (SELECT min((e.us, e.seq, e.phase, e.what)) FROM esc_events e WHERE e.device_name = t.device_name AND e.mnemonic = t.mnemonic
       AND e.disc = t.disc AND (e.us, e.seq, e.phase) > (t.us, t.seq, 0)) AS by_key,
    (SELECT min((a.us, 4611686018427387904, 3, 'ack')) FROM esc_acks a WHERE a.device_name = t.device_name AND a.mnemonic = t.mnemonic AND a.us >= t.us) AS by_ack,
    FROM tracked t) x""")
CTES["esc_out"] = (["esc"], f"""SELECT seq, device_name, mnemonic, disc, us, due_us, least(by_key[1], by_ack[1]) AS ended_us,
    coalesce(CASE WHEN by_ack[1] < coalesce(by_key[1], by_ack[1] + 1) THEN 'ack' ELSE by_key[4] END, '') AS ended_by FROM esc""")
CTES["esc_sent_src"] = (["esc_out"], f"""SELECT DISTINCT concat(device_name, '|', mnemonic) AS k, us, min(seq) AS seq, false AS reset FROM esc_out
    WHERE due_us < coalesce(ended_us, {LAST} + 1) GROUP BY device_name, mnemonic, us""")


def escalation_inputs(spark, sf):
    rows, opens = decided_with_incidents(spark, sf)
    rows = materialize(rows.select("seq", "us", "device_name", "mnemonic", "bgp_neighbor", "interface_name",
                                   "classification", "is_recovery", "notification_sent"), "q")
    tracked = rows.where("notification_sent AND classification = 'CRITICAL'")
    acks = tracked.where("seq % 7 = 0").select("device_name", "mnemonic", (F.col("us") + 400 * S).alias("us"))
    acks = acks.where(F.col("us") <= rows.agg(F.max("us")).scalar())
    return rows, tracked, rows.where("is_recovery"), acks, opens


def _register_escalations():
    from .folds import throttle_ctes

    CTES.update(throttle_ctes("esc_sent", fixed.ESCALATION_DELAY))
    sql = check(f"""
SELECT o.seq, o.ended_by, coalesce(o.ended_us, -1) AS ended_us, (o.ended_us IS NULL AND o.due_us <= {LAST}) AS pending,
  CASE WHEN o.due_us < coalesce(o.ended_us, {LAST} + 1) AND s.kept THEN o.due_us ELSE -1 END AS escalated_us
FROM esc_out o LEFT JOIN esc_sent s ON s.k = concat(o.device_name, '|', o.mnemonic) AND s.us = o.us""", "esc_sent", recursive=True)

    @query("n8_escalations", sql)
    def _(spark, sf):
        rows, tracked, recoveries, acks, _ = escalation_inputs(spark, sf)
        last = rows.agg(F.max("us")).first()[0]
        out = notify.escalations(tracked, recoveries, last, acks=acks)
        return out.select("seq", F.coalesce("ended_by", F.lit("")).alias("ended_by"),
                          F.coalesce("ended_us", F.lit(-1)).alias("ended_us"), "pending",
                          F.coalesce("escalated_us", F.lit(-1)).alias("escalated_us"))


_register_escalations()


@query("n9_cancel_events", check("""
SELECT what, count(*) AS n, CAST(sum(us % 1000003) AS BIGINT) AS us_sum FROM (
  SELECT what, us FROM esc_events UNION ALL SELECT 'ack', us FROM esc_acks
  UNION ALL SELECT 'clear', CAST(resolved_us AS BIGINT) FROM ids WHERE resolved_us IS NOT NULL) x GROUP BY what""", "esc_events", "esc_acks", recursive=True))
def _(spark, sf):
    _, tracked, recoveries, acks, opens = escalation_inputs(spark, sf)
    # Escalations know a device by its name, incidents by its address.
    names = fx.dim(spark, "device").select(F.col("ip").alias("device_ip"), F.col("name"))
    clears = opens.where("resolved_us IS NOT NULL").join(names, "device_ip", "left").select(
        F.coalesce("name", F.concat(F.lit("UNKNOWN-"), "device_ip")).alias("device_name"), F.col("resolved_us").alias("us"),
        F.col("resolved_by").alias("seq"))
    return notify.escalation_events(tracked, recoveries, clears, acks).groupBy("what").agg(
        F.count("*").alias("n"), F.sum(F.col("us") % 1000003).alias("us_sum"))


OPEN_ESC = "classification = 'CRITICAL' AND resolved_at IS NULL AND acknowledged_at IS NULL"


@query("n10_open_escalations", check(f"""
SELECT device_name, mnemonic, disc, arg_max(alert_id, (timestamp, alert_id)) AS alert_id,
  max(timestamp) + INTERVAL 14400 SECOND <= TIMESTAMP '2024-01-29 12:00:00' AS pending,
  date_diff('second', max(timestamp), TIMESTAMP '2024-01-29 12:00:00') // 60 AS elapsed_minutes
FROM (SELECT *, coalesce(nullif(bgp_neighbor, ''), interface_name) AS disc FROM alerts WHERE {OPEN_ESC}
  AND timestamp BETWEEN TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 28800 SECOND AND TIMESTAMP '2024-01-29 12:00:00') a
WHERE raw <> '' AND timestamp < TIMESTAMP '2099-01-01' GROUP BY 1, 2, 3""", "alerts"))
def _(spark, sf):
    out = notify.open_escalations(alerts(spark, sf), "2024-01-29 12:00:00", delay_s=14400)
    return out.select("device_name", "mnemonic", "disc", "alert_id", "pending", "elapsed_minutes")


@query("n11_failed_notifications", check("""
SELECT alert_id FROM alerts WHERE notification_sent AND (NOT discord_sent OR NOT telegram_sent)
ORDER BY alerts.timestamp DESC, alert_id DESC LIMIT 100""", "alerts"))
def _(spark, sf):
    return notify.failed_notifications(alerts(spark, sf)).select("alert_id")


DELIVERY = """SELECT event_id AS alert_id, CASE WHEN event_id % 4 = 1 THEN NULL ELSE event_id % 3 = 1 END AS discord_sent,
  CASE WHEN event_id % 5 = 1 THEN NULL ELSE true END AS telegram_sent, CASE WHEN event_id % 6 = 1 THEN repeat('e', 300) ELSE NULL END AS discord_error,
  CASE WHEN event_id % 9 = 1 THEN 'timeout' ELSE NULL END AS telegram_error FROM events"""


@query("n12_apply_delivery", check("""
SELECT a.alert_id, coalesce(d.discord_sent, a.discord_sent) AS discord_sent, coalesce(d.telegram_sent, a.telegram_sent) AS telegram_sent,
  coalesce(d.discord_error, a.discord_error) AS discord_error, coalesce(d.telegram_error, a.telegram_error) AS telegram_error
FROM alerts a LEFT JOIN delivery d USING (alert_id)""", "alerts", delivery=DELIVERY))
def _(spark, sf):
    return notify.apply_delivery(alerts(spark, sf), fx.derive(spark, sf, DELIVERY)).select(
        "alert_id", "discord_sent", "telegram_sent", "discord_error", "telegram_error")


# ---------------------------------------------------------------------------------- paged reads

@query("q1_alerts_page", check(f"""
SELECT alert_id, device_name, {sts('timestamp')} AS at FROM alerts WHERE classification = 'CRITICAL' AND device_name = 'rtr-2'
  AND timestamp >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 30 DAY ORDER BY alerts.timestamp DESC, alert_id DESC LIMIT 50 OFFSET 20""", "alerts"))
def _(spark, sf):
    page = read.alerts_page(alerts(spark, sf), fx.AS_OF, "CRITICAL", "rtr-2", "30d", 50, 20)
    return page.select("alert_id", "device_name", ts("timestamp", "at"))


@query("q2_alerts_by", check(" UNION ALL ".join(
    f"SELECT '{c}' AS by_column, alert_id FROM (SELECT * FROM alerts WHERE {c} = '{v}' ORDER BY alerts.timestamp DESC, alert_id DESC LIMIT {n}) x"
    for c, v, n in (("classification", "WARNING", 100), ("device_name", "rtr-3", 100), ("incident_id", "INC-40", 500))), "alerts"))
def _(spark, sf):
    out = None
    for c, v, n in (("classification", "WARNING", 100), ("device_name", "rtr-3", 100), ("incident_id", "INC-40", 500)):
        one = read.alerts_by(alerts(spark, sf), c, v, n).select(F.lit(c).alias("by_column"), "alert_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("q3_incidents_by_status", check(
    f"SELECT id, {sts('created_at')} AS created_at FROM incidents WHERE status = 'active' ORDER BY incidents.created_at DESC, id DESC LIMIT 100", "incidents"))
def _(spark, sf):
    return read.incidents_by_status(shared(spark, sf, "INCIDENTS"), "active").select("id", ts("created_at"))


@query("q4_ack_trail", check(
    f"SELECT operator_name, comment, {sts('created_at')} AS created_at FROM acks WHERE incident_id = 'INC-40' "
    "ORDER BY acks.created_at DESC, operator_name DESC LIMIT 100", "acks"))
def _(spark, sf):
    return read.ack_trail(shared(spark, sf, "ACKS"), "INC-40").select("operator_name", "comment", ts("created_at"))


@query("q4_handoffs", check(
    f"SELECT id, shift_name, {sts('created_at')} AS created_at FROM notes ORDER BY notes.created_at DESC, id DESC LIMIT 10", "notes"))
def _(spark, sf):
    return read.handoffs(shared(spark, sf, "HANDOFFS")).select("id", "shift_name", ts("created_at"))


# ---------------------------------------------------------------------------------- change sets

def stored_alerts(spark, sf) -> str:
    """The path of a new alert table."""
    path = os.path.join(shared_dir(spark), f"changes-{uuid.uuid4().hex}")
    sinks.write_alerts(alerts(spark, sf), path)
    return path


def changed(spark, path: str, changes, **how):
    """The table at ``path`` after the change rows were committed."""
    table.apply_changes(spark, path, changes, **how)
    return table.read(spark, path)


@query("r1_change_set", CHECKS["r1_resolve_by_recovery"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    a = table.read(spark, path)
    rec = a.where(text.is_recovery(F.col("mnemonic"), F.col("message")))
    return _resolved(changed(spark, path, resolve.recovery_changes(a, rec)))


@query("r2_change_set", CHECKS["r2_resolve_silent_faults"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    a = table.read(spark, path)
    ups = a.where((F.col("mnemonic") == "ADJCHANGE") & text.is_recovery(F.col("mnemonic"), F.col("message")))
    out = changed(spark, path, resolve.silent_fault_changes(a, ups, fx.dim(spark, "topo"), fx.dim(spark, "bgp_bundle")))
    return out.where("resolution_reason = 'bgp_up_inferred'").select("alert_id", ts("resolved_at"))


@query("r3_change_set", CHECKS["r3_resolve_noise"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    out = changed(spark, path, resolve.noise_changes(table.read(spark, path), fx.AS_OF))
    return out.groupBy("classification", "resolution_reason").agg(F.count("*").alias("n"), F.count("resolved_at").alias("resolved"))


@query("r4_change_set", CHECKS["r4_resolve_incident_alerts"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    done = _resolved_incidents(spark, sf)[1]
    return _resolved(changed(spark, path, resolve.incident_alert_changes(table.read(spark, path), done)))


@query("r9_change_set", CHECKS["r9_apply_acks"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    out = changed(spark, path, resolve.ack_changes(table.read(spark, path), shared(spark, sf, "ALERT_ACKS")))
    return out.where("acknowledged_at IS NOT NULL").select("alert_id", ts("acknowledged_at"))


@query("n12_change_set", CHECKS["n12_apply_delivery"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    status = fx.derive(spark, sf, DELIVERY)
    out = changed(spark, path, notify.delivery_changes(table.read(spark, path), status), null_keeps=True)
    return out.select("alert_id", "discord_sent", "telegram_sent", "discord_error", "telegram_error")


@query("p24_change_set", CHECKS["p24_apply_reclassification"])
def _(spark, sf):
    path = stored_alerts(spark, sf)
    a = table.read(spark, path)
    found = classify.classification_changes(a, classify.reclassify(a, fx.AS_OF))
    return changed(spark, path, found).groupBy("classification").agg(F.count("*").alias("n"))
