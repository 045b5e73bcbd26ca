"""Queries for duplicate suppression (D) and correlation (C)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import correlate, dedup, enrich, resolve
from ..session import materialize, shared_dir
from . import fixtures as fx
from .checks import CTES, check, ts as sts
from .registry import enriched, events, query, ts

S = 1_000_000
POS = "(CAST({0}.us AS HUGEINT) * 100000000 + {0}.seq)"


def throttle_ctes(name: str, window_s: int) -> dict[str, tuple[list[str], str]]:
    """CTEs that walk from kept row to kept row over ``{name}_src(k, us, seq, reset)``."""
    return {
        f"{name}_r": ([f"{name}_src"], f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, seq) AS rn FROM {name}_src"),
        f"{name}_at": ([f"{name}_r"], f"SELECT k, us, min(rn) AS rn FROM {name}_r GROUP BY k, us"),
        f"{name}_n": ([f"{name}_at"], f"""SELECT r.k, r.rn, r.seq, least(f.rn, min(CASE WHEN r.reset THEN r.rn END) OVER (
            PARTITION BY r.k ORDER BY r.rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS nxt
          FROM {name}_r r ASOF LEFT JOIN {name}_at f ON r.k = f.k AND r.us + {window_s * S} < f.us"""),
        f"{name}_kept": ([f"{name}_n"], f"""SELECT k, rn FROM {name}_n WHERE rn = 1 UNION ALL
          SELECT n.k, n.nxt FROM {name}_kept p JOIN {name}_n n ON n.k = p.k AND n.rn = p.rn WHERE n.nxt IS NOT NULL"""),
        f"{name}": ([f"{name}_kept"], f"""SELECT r.*, p.rn IS NOT NULL AS kept FROM {name}_r r
          LEFT JOIN {name}_kept p ON p.k = r.k AND p.rn = r.rn"""),
    }


DIRECTION = """CASE WHEN rule_id IN ('BGP_DOWN', 'BGP_MAXPFX') OR (mnemonic = 'ADJCHANGE' AND contains(lower(message), 'down')) THEN 'down'
  WHEN rule_id = 'BGP_UP' OR (mnemonic = 'ADJCHANGE' AND contains(lower(message), ' up')) THEN 'up' END"""
PEER = "PARTITION BY device_name, bgp_neighbor ORDER BY us, seq"

CTES.update({
    "dd": (["ev"], f"""SELECT seq, us, device_name, mnemonic, bundle_parent, bgp_neighbor, classification,
      coalesce(nullif(bgp_neighbor, ''), interface_name) AS disc, {DIRECTION} AS direction FROM ev"""),
    "d1_src": (["dd"], """SELECT concat(device_name, '|', bundle_parent) AS k, us, seq, false AS reset FROM dd
      WHERE bundle_parent <> ''"""),
    **throttle_ctes("d1", fixed.BUNDLE_WINDOW),
    "passed": (["d1"], "SELECT * FROM dd WHERE seq NOT IN (SELECT seq FROM d1 WHERE NOT kept)"),
    "d2": (["passed"], f"""SELECT *, CASE WHEN direction = 'down' AND p1 = 'up' AND p2 = 'down' THEN 'flapping'
        WHEN p1 IS NULL OR p1 <> direction THEN 'change' ELSE 'same' END AS flap
      FROM (SELECT *, CASE WHEN us - lag(us, 1) OVER ({PEER}) <= {fixed.FLAP_WINDOW * S} THEN lag(direction, 1) OVER ({PEER}) END AS p1,
          CASE WHEN us - lag(us, 2) OVER ({PEER}) <= {fixed.FLAP_WINDOW * S} THEN lag(direction, 2) OVER ({PEER}) END AS p2
        FROM passed WHERE mnemonic = 'ADJCHANGE' AND bgp_neighbor <> '' AND direction IS NOT NULL) x"""),
    "d3_src": (["d2"], """SELECT concat(p.device_name, '|', p.mnemonic, '|', p.disc) AS k, p.us, p.seq,
        coalesce(d2.flap = 'change', false) AS reset
      FROM passed p LEFT JOIN d2 ON d2.seq = p.seq WHERE coalesce(d2.flap, '') <> 'flapping'"""),
    **throttle_ctes("d3", fixed.DEDUP_WINDOW),
    "d4": (["d3"], """SELECT seq, CASE WHEN kept THEN 'new' ELSE 'suppressed_duplicate' END AS reason FROM d3
      UNION ALL SELECT seq, 'flapping' FROM d2 WHERE flap = 'flapping'
      UNION ALL SELECT seq, 'bundle_grouped' FROM d1 WHERE NOT kept"""),
})

_MASS = ", ".join(f"'{t}'" for t in fixed.MASS_EVENT_TYPES)
CTES.update({
    "c1": (["ev"], f"""SELECT *, concat(source_ip, '|', subj) AS sk, count(*) OVER (PARTITION BY source_ip, subj ORDER BY us
          RANGE BETWEEN {fixed.FLAP_COUNT_WINDOW * S} PRECEDING AND CURRENT ROW)
        - (count(*) OVER (PARTITION BY source_ip, subj, us) - row_number() OVER (PARTITION BY source_ip, subj, us ORDER BY seq)) AS flap_count
      FROM (SELECT *, coalesce(nullif(bgp_neighbor, ''), nullif(interface_name, ''), mnemonic) AS subj FROM ev) x"""),
    "c2": (["ev"], f"""SELECT a.seq, count(b.seq) AS others FROM ev a LEFT JOIN ev b ON b.source_ip = a.source_ip
        AND b.us BETWEEN a.us - {fixed.CORRELATION_WINDOW * S} AND a.us AND (b.us, b.seq) < (a.us, a.seq)
        AND b.event_type IN ({_MASS}) AND b.classification IN ('CRITICAL', 'WARNING')
      WHERE a.event_type IN ({_MASS}) GROUP BY a.seq"""),
    "kinds": (["ev"], f"""SELECT *, {POS.format('ev')} AS pos, CASE WHEN on_link AND regexp_matches(event_type, 'Down|Fault') THEN 'F'
        WHEN on_link AND regexp_matches(event_type, 'Up|Clear') THEN 'U' END AS kind
      FROM (SELECT *, interface_name <> '' AND bundle_parent <> '' AND member_bundle IS NOT NULL
        AND classification IN ('CRITICAL', 'WARNING') AS on_link FROM ev) ev"""),
    "probes": (["kinds", "topo"], """SELECT seq, us, pos, source_ip AS slot_ip, event_bundle AS slot_bundle, kind FROM kinds
        WHERE event_bundle IS NOT NULL
      UNION ALL SELECT k.seq, k.us, k.pos, t.ip, t.bundle, NULL FROM kinds k JOIN topo t ON t.ip = k.event_remote AND t.remote_ip = k.source_ip"""),
    "lk": (["probes"], f"""SELECT *, max(CASE WHEN opens THEN pos END) OVER (PARTITION BY slot_ip, slot_bundle ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS episode
      FROM (SELECT *, coalesce(kind = 'F', false) AND NOT live AS opens
        FROM (SELECT p.seq, p.us, p.pos, p.slot_ip, p.slot_bundle, p.kind, coalesce(arg_max(f.kind, f.pos) = 'F', false) AS live
          FROM probes p LEFT JOIN probes f ON f.slot_ip = p.slot_ip AND f.slot_bundle = p.slot_bundle AND f.kind IS NOT NULL
            AND f.pos < p.pos AND f.us >= p.us - {fixed.CORRELATION_WINDOW * S}
          GROUP BY ALL) a) b"""),
    "sym": (["lk"], """SELECT seq, min(us) AS us, min(pos) AS pos, bool_or(live) AS is_bh_symptom, bool_or(opens) AND NOT bool_or(live) AS is_bh_root,
        CASE WHEN bool_or(live) THEN arg_min(slot_ip, episode) FILTER (live) ELSE max(slot_ip) FILTER (opens) END AS slot_ip,
        CASE WHEN bool_or(live) THEN arg_min(slot_bundle, episode) FILTER (live) ELSE max(slot_bundle) FILTER (opens) END AS slot_bundle
      FROM lk GROUP BY seq HAVING bool_or(live) OR bool_or(opens)"""),
    "bh": (["sym"], f"""SELECT *, max(CASE WHEN opens THEN pos END) OVER (PARTITION BY slot_ip, slot_bundle ORDER BY pos) AS inc
      FROM (SELECT s.*, s.is_bh_root OR prev IS NULL OR us - prev_us > {fixed.INCIDENT_TTL * S} OR EXISTS (
            SELECT 1 FROM kinds k WHERE k.is_recovery AND k.source_ip = s.slot_ip AND k.pos >= s.prev AND k.pos < s.pos) AS opens
        FROM (SELECT *, lag(pos) OVER w AS prev, lag(us) OVER w AS prev_us FROM sym
          WINDOW w AS (PARTITION BY slot_ip, slot_bundle ORDER BY pos)) s) x"""),
    "mrows": (["sym", "c2"], f"""SELECT k.seq, k.us, k.pos, k.source_ip, k.is_recovery, coalesce(c2.others >= {fixed.MASS_THRESHOLD - 1}, false) AS is_mass,
        coalesce(c2.others >= {fixed.MASS_THRESHOLD - 1}, false) OR s.seq IS NULL AS joins,
        row_number() OVER (PARTITION BY k.source_ip ORDER BY k.pos) AS rn
      FROM kinds k LEFT JOIN c2 ON c2.seq = k.seq LEFT JOIN sym s ON s.seq = k.seq"""),
    # One row per device and step: the mass incident after the row, before its recovery ends it.
    "mstate": (["mrows"], f"""SELECT source_ip, rn, seq, CASE WHEN is_mass THEN pos END AS inc, us AS last_us, is_recovery AS ended,
        CASE WHEN joins AND is_mass THEN pos END AS shown FROM mrows WHERE rn = 1
      UNION ALL SELECT r.source_ip, r.rn, r.seq, CASE WHEN r.joins THEN coalesce(s.live, CASE WHEN r.is_mass THEN r.pos END) ELSE s.inc2 END,
        CASE WHEN r.joins THEN r.us ELSE s.last_us END, r.is_recovery,
        CASE WHEN r.joins THEN coalesce(s.live, CASE WHEN r.is_mass THEN r.pos END) END
      FROM (SELECT m.*, x.is_recovery AS cur_rec, CASE WHEN NOT m.ended THEN m.inc END AS inc2,
          CASE WHEN NOT m.ended AND n.us - m.last_us <= {fixed.INCIDENT_TTL * S} THEN m.inc END AS live
        FROM mstate m JOIN mrows n ON n.source_ip = m.source_ip AND n.rn = m.rn + 1
        JOIN mrows x ON x.source_ip = m.source_ip AND x.rn = m.rn) s
      JOIN mrows r ON r.source_ip = s.source_ip AND r.rn = s.rn + 1"""),
    "corr": (["c1", "bh", "mstate"], f"""
      SELECT seq, us, pos, source_ip, is_recovery, flap_count, flap_count >= {fixed.FLAP_THRESHOLD} AS is_flapping,
        CASE WHEN by_link THEN is_bh_root ELSE coalesce(mass_inc = pos, false) END AS is_root_cause,
        CASE WHEN by_link THEN is_bh_symptom ELSE mass_inc IS NOT NULL AND mass_inc <> pos END AS is_symptom,
        NOT by_link AND mass_inc IS NULL AND flap_count < {fixed.FLAP_THRESHOLD} AS is_independent,
        CASE WHEN by_link THEN 'link' WHEN mass_inc IS NOT NULL THEN 'mass' END AS inc_kind,
        CASE WHEN by_link THEN concat(slot_ip, ':', slot_bundle) WHEN mass_inc IS NOT NULL THEN source_ip END AS inc_key,
        CASE WHEN by_link THEN bh_inc ELSE mass_inc END AS inc, bh_inc, mass_inc, slot_ip, slot_bundle, is_bh_root
      FROM (SELECT c.seq, c.us, {POS.format('c')} AS pos, c.source_ip, c.is_recovery, c.flap_count, b.inc AS bh_inc, m.shown AS mass_inc,
          b.slot_ip, b.slot_bundle, coalesce(b.is_bh_root, false) AS is_bh_root, coalesce(b.is_bh_symptom, false) AS is_bh_symptom,
          coalesce(r.is_mass, false) AND NOT coalesce(b.is_bh_root, false) AS by_mass,
          NOT (r.is_mass AND NOT coalesce(b.is_bh_root, false)) AND b.seq IS NOT NULL AS by_link
        FROM c1 c LEFT JOIN bh b ON b.seq = c.seq LEFT JOIN mstate m ON m.seq = c.seq LEFT JOIN mrows r ON r.seq = c.seq) x"""),
    "opens": (["corr"], """SELECT kind, key, device_ip, inc, max(pos) AS last_pos, max(us) AS last_us, count(*) AS touches,
        bool_or(pos = inc AND is_root_cause AND inc_kind = kind) AS has_root,
        max(CASE WHEN kind = 'mass' THEN 1 WHEN pos = inc AND is_bh_root THEN 2 ELSE 0 END) AS open_order
      FROM (SELECT 'link' AS kind, concat(slot_ip, ':', slot_bundle) AS key, slot_ip AS device_ip, bh_inc AS inc, * FROM
          (SELECT pos, us, slot_ip, slot_bundle, bh_inc, is_root_cause, inc_kind, is_bh_root FROM corr) c WHERE bh_inc IS NOT NULL
        UNION ALL SELECT 'mass', source_ip, source_ip, mass_inc, pos, us, NULL, NULL, NULL, is_root_cause, inc_kind, is_bh_root
          FROM corr WHERE mass_inc IS NOT NULL) t
      GROUP BY kind, key, device_ip, inc"""),
    "ids": (["opens"], f"""SELECT *, concat('INC-', d, '-', lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS incident_id,
        CASE WHEN kill.us - last_us <= {fixed.INCIDENT_TTL * S} THEN kill.us END AS resolved_us,
        CASE WHEN kill.us - last_us <= {fixed.INCIDENT_TTL * S} THEN kill.seq END AS resolved_by
      FROM (SELECT o.*, row_number() OVER (PARTITION BY d ORDER BY inc, open_order) AS n,
          (SELECT {{'us': arg_min(k.us, k.pos), 'seq': arg_min(k.seq, k.pos)}} FROM kinds k
            WHERE k.is_recovery AND k.source_ip = o.device_ip AND k.pos >= o.last_pos) AS kill
        FROM (SELECT *, strftime(make_timestamp(CAST(inc // 100000000 AS BIGINT) - {fixed.LOCAL_OFFSET_HOURS * 3600 * S}), '%Y%m%d') AS d FROM opens) o) x"""),
})


def dedup_rows(spark, sf):
    return enriched(spark, sf).select(*dedup.COLUMNS)


@query("d1_bundle_group", check("SELECT seq, kept FROM d1", "d1", recursive=True))
def _(spark, sf):
    rows = materialize(dedup._narrow(dedup_rows(spark, sf)), "q")
    return dedup.bundle_group(rows).select("seq", "kept")


@query("d2_bgp_flap", check("SELECT seq, flap FROM d2", "d2", recursive=True))
def _(spark, sf):
    rows = materialize(dedup._narrow(dedup_rows(spark, sf)), "q")
    return dedup.bgp_flap(rows.where("bundle_parent = ''")).where("flap IS NOT NULL").select("seq", "flap")


@query("d3_window_dedup", check(
    "SELECT d3.seq, CASE WHEN kept THEN 'new' ELSE 'suppressed_duplicate' END AS reason FROM d3", "d3", recursive=True))
def _(spark, sf):
    rows = materialize(dedup._narrow(dedup_rows(spark, sf)), "q")
    grouped = dedup.bundle_group(rows).where("kept").drop("kept")
    passed = materialize(rows.where("bundle_parent = ''").unionByName(grouped), "q")
    flap = dedup.bgp_flap(passed)
    return dedup.window_dedup(flap).where("reason <> 'flapping'").select("seq", "reason")


@query("d4_should_notify", check(
    "SELECT seq, reason IN ('new', 'flapping') AS should_send, reason FROM d4", "d4", recursive=True))
def _(spark, sf):
    return dedup.should_notify(dedup_rows(spark, sf))


@query("d5_flap_state", check(f"""
SELECT concat(device_name, ':', bgp_neighbor) AS bgp_key, direction AS state, us, seq FROM (
  SELECT *, max(us) OVER (PARTITION BY device_name, bgp_neighbor) AS z FROM dd
  WHERE mnemonic = 'ADJCHANGE' AND bgp_neighbor <> '' AND direction IS NOT NULL) x WHERE us >= z - {fixed.FLAP_WINDOW * S}""", "dd"))
def _(spark, sf):
    return dedup.flap_state(dedup_rows(spark, sf)).select("bgp_key", "state", "us", "seq")


@query("d5_resume", check("""SELECT seq, flap FROM d2 WHERE seq >= (SELECT median(event_id) FROM events)""", "d2", recursive=True))
def _(spark, sf):
    rows = materialize(dedup._narrow(dedup_rows(spark, sf)), "q")
    cut = fx.table(spark, sf, "events").agg(F.median("event_id")).scalar()
    # The clock of a line may lose its fraction, so the stored part is everything up to the cut.
    before, after = rows.where(F.col("seq") < cut), rows.where(F.col("seq") >= cut)
    stored = dedup.export_flap_state(dedup.flap_state(before))
    return dedup.resume(after, stored).where("flap IS NOT NULL").select("seq", "flap")


@query("p15_bgp_state_history", check(f"""
SELECT d.seq, d.device_name, d.bgp_neighbor AS neighbor, coalesce(e.as_number, 0) AS as_number, e.vrf,
  CASE WHEN d4.reason = 'flapping' THEN 'FLAPPING' WHEN d.direction = 'down' THEN 'Down' ELSE 'Up' END AS state
FROM dd d JOIN ev e ON e.seq = d.seq JOIN d4 ON d4.seq = d.seq
WHERE d.mnemonic = 'ADJCHANGE' AND d.bgp_neighbor <> '' AND d.direction IS NOT NULL""", "d4", recursive=True))
def _(spark, sf):
    rows = materialize(enriched(spark, sf), "q")
    decided = rows.join(dedup.should_notify(rows), "seq")
    return enrich.bgp_state_history(decided).select("seq", "device_name", "neighbor", "as_number", "vrf", "state")


@query("c1_flap_count", check(
    f"SELECT seq, flap_count, flap_count >= {fixed.FLAP_THRESHOLD} AS is_flapping FROM c1", "c1"))
def _(spark, sf):
    rows = enriched(spark, sf).select("seq", "us", "source_ip", "mnemonic", "interface_name", "bgp_neighbor")
    return correlate.flap_count(rows).select("seq", "flap_count", "is_flapping")


@query("c2_mass_bgp", check(
    f"SELECT seq, others, others >= {fixed.MASS_THRESHOLD - 1} AS is_mass FROM c2", "c2"))
def _(spark, sf):
    rows = enriched(spark, sf).select("seq", "us", "source_ip", "event_type", "classification")
    return correlate.mass_bgp(rows).select("seq", "others", "is_mass")


def link_events(spark, sf):
    return materialize(events(spark, sf).select(*correlate.COLUMNS), "q")


@query("c3_backhaul_episodes", check("""
SELECT slot_ip, slot_bundle, min(us) AS start_us, max(us) AS last_us, count(*) AS failures
FROM (SELECT *, CASE WHEN opens THEN pos ELSE episode END AS e FROM lk WHERE kind = 'F') x GROUP BY slot_ip, slot_bundle, e""", "lk"))
def _(spark, sf):
    return correlate.backhaul_episodes(link_events(spark, sf), fx.dim(spark, "topo"))


@query("c4_symptoms", check("SELECT seq, is_bh_symptom, is_bh_root, slot_ip, slot_bundle FROM sym", "sym"))
def _(spark, sf):
    return correlate.symptoms(link_events(spark, sf), fx.dim(spark, "topo"))


@query("c5_backhaul_incidents", check(
    "SELECT seq, slot_ip, slot_bundle, opens AS opens_incident, CAST(inc % 100000000 AS BIGINT) AS inc_seq FROM bh", "bh"))
def _(spark, sf):
    ev, topo = link_events(spark, sf), fx.dim(spark, "topo")
    touches = materialize(correlate.symptoms(ev, topo).join(ev.select("seq", "us"), "seq"), "q")
    out = correlate.backhaul_incidents(touches, ev.where("is_recovery").select("seq", "us", "source_ip"), topo)
    return out.select("seq", "slot_ip", "slot_bundle", "opens_incident", F.col("inc.seq").alias("inc_seq"))


def correlated(spark, sf):
    return correlate.correlate(events(spark, sf), fx.dim(spark, "topo"))


@query("c6_mass_incidents", check(
    "SELECT seq, CAST(shown % 100000000 AS BIGINT) AS inc_seq FROM mstate WHERE shown IS NOT NULL", "mstate", recursive=True))
def _(spark, sf):
    return correlated(spark, sf).where("mass_inc IS NOT NULL").select("seq", F.col("mass_inc.seq").alias("inc_seq"))


@query("c7_correlate", check("""
SELECT seq, is_root_cause, is_symptom, is_independent, is_flapping, flap_count, coalesce(inc_kind, '') AS inc_kind,
  coalesce(inc_key, '') AS inc_key, coalesce(CAST(inc % 100000000 AS BIGINT), -1) AS inc_seq FROM corr""", "corr", recursive=True))
def _(spark, sf):
    return correlated(spark, sf).select(
        "seq", "is_root_cause", "is_symptom", "is_independent", "is_flapping", "flap_count",
        F.coalesce("inc_kind", F.lit("")).alias("inc_kind"), F.coalesce("inc_key", F.lit("")).alias("inc_key"),
        F.coalesce("inc.seq", F.lit(-1)).alias("inc_seq"))


CORR_SQL = """SELECT seq, is_root_cause, is_symptom, is_independent, is_flapping, flap_count, coalesce(inc_kind, '') AS inc_kind,
  coalesce(inc_key, '') AS inc_key, coalesce(CAST(inc % 100000000 AS BIGINT), -1) AS inc_seq FROM corr"""


def stream_correlated(spark, sf):
    """The events written by day as files, then correlated as a stream in three micro-batches."""
    from ..streaming.correlate import run_correlation

    src, out, state = (os.path.join(shared_dir(spark), f"correlate-{x}-{uuid.uuid4().hex}") for x in ("in", "out", "offsets"))
    ev = materialize(events(spark, sf).select(*correlate.COLUMNS), "q")
    span = ev.agg(F.min("us").alias("a"), F.max("us").alias("z")).first()
    third = (span["z"] - span["a"]) // 3 + 1
    for i in range(3):
        part = ev.where((F.col("us") >= span["a"] + i * third) & (F.col("us") < span["a"] + (i + 1) * third))
        part.coalesce(1).write.mode("append").parquet(src)
    return run_correlation(spark, src, ev.schema, fx.dim(spark, "topo"), out, state, partitions=4)


@query("c7_correlate_stream", check(CORR_SQL, "corr", recursive=True))
def _(spark, sf):
    return stream_correlated(spark, sf).where("what = 'event'").select(
        "seq", "is_root_cause", "is_symptom", "is_independent", "is_flapping", "flap_count",
        F.coalesce("inc_kind", F.lit("")).alias("inc_kind"), F.coalesce("inc_key", F.lit("")).alias("inc_key"),
        F.coalesce("inc.seq", F.lit(-1)).alias("inc_seq"))


@query("c11_resolve_stream", check(f"""
SELECT kind, key, CAST(inc % 100000000 AS BIGINT) AS seq, CASE WHEN resolved_us IS NOT NULL THEN 'resolved' ELSE 'expired' END AS what,
  coalesce(CAST(resolved_us AS BIGINT), -1) AS resolved_us, coalesce(CAST(resolved_by AS BIGINT), -1) AS resolved_by FROM ids""", "ids", recursive=True))
def _(spark, sf):
    return stream_correlated(spark, sf).where("what <> 'event'").select(
        F.col("inc_kind").alias("kind"), F.col("inc_key").alias("key"), F.col("inc.seq").alias("seq"), "what",
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("resolved_us", "resolved_by")])


@query("c8_incident_ids", check("""
SELECT incident_id, kind, key, CAST(inc % 100000000 AS BIGINT) AS seq FROM ids""", "ids", recursive=True))
def _(spark, sf):
    opens = materialize(correlate.incident_openings(correlated(spark, sf)), "q")
    return correlate.incident_ids(opens).select("incident_id", "kind", "key", "seq")


@query("c9_expire_incidents", check(f"""
SELECT kind, key, CAST(inc % 100000000 AS BIGINT) AS seq,
  CASE WHEN resolved_us IS NOT NULL THEN 'resolved' WHEN (SELECT max(us) FROM ev) - last_us > {fixed.INCIDENT_TTL * S}
    THEN 'expired' ELSE 'live' END AS fate FROM ids""", "ids", recursive=True))
def _(spark, sf):
    ev = materialize(events(spark, sf), "q")
    corr = materialize(correlate.correlate(ev, fx.dim(spark, "topo"), stored=True), "q")
    opens = correlate.resolve_on_recovery(
        correlate.incident_openings(corr), ev.where("is_recovery").select("seq", "us", "source_ip"))
    newest = ev.agg(F.max("us")).scalar()
    return correlate.expire_incidents(opens, newest).select("kind", "key", "seq", "fate")


def incident_table(spark, sf):
    """(events with incident ids, openings with ids and resolution), both written once."""
    ev = materialize(events(spark, sf), "q")
    corr = materialize(correlate.correlate(ev, fx.dim(spark, "topo"), stored=True), "q")
    return ev, *correlate.number_incidents(corr, ev.where("is_recovery").select("seq", "us", "source_ip"))


@query("c10_build_incidents", check(f"""
SELECT i.incident_id AS id, concat(r.device_name, ' ', r.mnemonic) AS title, r.message AS root_cause,
  concat('["', r.device_name, '"]') AS affected_devices,
  CASE WHEN r.client_name <> '' THEN concat('["', r.client_name, '"]') ELSE '[]' END AS affected_clients,
  a.n AS alert_count, a.s AS symptom_count, CASE WHEN i.resolved_us IS NULL THEN 'active' ELSE 'resolved' END AS status,
  {sts('make_timestamp(r.us)')} AS created_at, {sts('make_timestamp(CAST(i.resolved_us AS BIGINT))')} AS resolved_at
FROM ids i JOIN ev r ON r.seq = CAST(i.inc % 100000000 AS BIGINT)
JOIN (SELECT inc_kind, inc_key, inc, count(*) AS n, count(*) FILTER (is_symptom) AS s FROM corr WHERE inc IS NOT NULL GROUP BY ALL) a
  ON a.inc = i.inc AND a.inc_kind = i.kind AND a.inc_key = i.key
WHERE i.has_root""", "ids", recursive=True))
def _(spark, sf):
    ev, shown, opens = incident_table(spark, sf)
    rows = shown.join(ev.select("seq", "device_name", "client_name", "mnemonic", "message"), "seq")
    out = resolve.build_incidents(rows, opens)
    return out.withColumns({"created_at": ts("created_at"), "resolved_at": ts("resolved_at")})


@query("c11_resolve_on_recovery", check("""
SELECT incident_id, coalesce(CAST(resolved_us AS BIGINT), -1) AS resolved_us, coalesce(CAST(resolved_by AS BIGINT), -1) AS resolved_by
FROM ids""", "ids", recursive=True))
def _(spark, sf):
    _, _, opens = incident_table(spark, sf)
    return opens.select("incident_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("resolved_us", "resolved_by")])
