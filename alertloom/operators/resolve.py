"""Incident table, resolution of alerts and incident cards.

Alert rows: ``alert_id, timestamp, source_ip, device_name, mnemonic, message, classification,
interface_name, bgp_neighbor, as_number, incident_id, resolved_at, resolution_reason,
acknowledged_at ...``. Updates return the whole new table; the writer replaces touched dates.

Recoveries and alerts meet per key on one timeline: each alert looks up the next recovery, so no
pair of rows is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text
from ..functions.times import from_us, ntz, to_us
from . import timeline

LOOKBACK_US = fixed.RESOLVE_LOOKBACK * timeline.SECOND


def build_incidents(events: DataFrame, openings: DataFrame) -> DataFrame:
    """One incident row per opening that has a root event.

    ``events``: correlated rows with ``incident_id, is_root_cause, is_symptom, device_name,
    client_name, mnemonic, message, us, seq``. ``openings``: ``incident_id, has_root`` and, when
    resolved, ``resolved_us``. An incident that a symptom opened has no root and gets no row.
    """
    root = F.struct("us", "seq")
    rows = events.where(F.col("incident_id").isNotNull() & (F.col("is_root_cause") | F.col("is_symptom")))
    first = F.when(F.col("is_root_cause"), F.struct(root.alias("p"), "device_name", "mnemonic", "message", "client_name"))
    grouped = rows.groupBy("incident_id").agg(
        F.min(first).alias("r"), F.count("*").alias("alert_count"), F.count_if("is_symptom").alias("symptom_count"))
    resolved = openings.where("has_root").select("incident_id", "resolved_us")
    return grouped.join(resolved, "incident_id").select(
        F.col("incident_id").alias("id"),
        F.concat_ws(" ", "r.device_name", "r.mnemonic").alias("title"),
        F.col("r.message").alias("root_cause"),
        F.to_json(F.array("r.device_name")).alias("affected_devices"),
        F.when(F.col("r.client_name") != "", F.to_json(F.array("r.client_name"))).otherwise("[]").alias("affected_clients"),
        "alert_count", "symptom_count",
        F.when(F.col("resolved_us").isNull(), "active").otherwise("resolved").alias("status"),
        from_us(F.col("r.p.us")).alias("created_at"), from_us(F.col("resolved_us")).alias("resolved_at"))


def _next_event(alerts: DataFrame, causes: DataFrame, keys: list[str], width: int = timeline.CHUNK_US) -> DataFrame:
    """Per alert key row the next cause (us, seq) at or after it within the look-back, as ``_next``."""
    a = alerts.select(*keys, "us", "seq", F.lit(0).alias("phase"))
    c = causes.select(*keys, "us", "seq", F.lit(1).alias("phase"))
    rows = a.unionByName(c).withColumn("chunk", timeline.chunk("us", width))
    nxt = timeline.running_max(
        rows, keys, {"_next": F.when(F.col("phase") == 1, F.struct("us", "seq"))},
        ["us", "seq", "phase"], inclusive=False, reverse=True,
    ).where("phase = 0")
    return nxt.where(F.col("_next.us") - F.col("us") <= LOOKBACK_US)


def _resolve(alerts: DataFrame, found: DataFrame, reason: str) -> DataFrame:
    """``found``: alert_id, at. Sets resolved_at and the reason of rows not resolved before."""
    hit = found.groupBy("alert_id").agg(F.min("at").alias("_at"))
    now = F.col("resolved_at").isNull() & F.col("_at").isNotNull()
    return (
        alerts.join(hit, "alert_id", "left")
        .withColumn("resolution_reason", F.when(now, reason).otherwise(F.col("resolution_reason")))
        .withColumn("resolved_at", F.coalesce("resolved_at", "_at"))
        .drop("_at")
    )


def _match_keys(iface: Column, neighbor: Column, asn: Column, mnemonic: Column, alone: Column) -> Column:
    """(kind, value) pairs under which an alert and a recovery can meet; NULL ones drop out."""
    adj = mnemonic == "ADJCHANGE"

    def key(kind: str, cond: Column, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")))

    return F.array_compact(F.array(
        key("interface", iface != "", iface), key("neighbor", adj & (neighbor != ""), neighbor),
        key("as", adj & (asn != 0), asn), key("mnemonic", alone, mnemonic)))


def _event_date(us: Column) -> Column:
    return F.to_date(from_us(us)).alias("event_date")


def _changes(met: DataFrame, reason: str) -> DataFrame:
    """Change rows (``event_date, alert_id, resolved_at, resolution_reason``) of alerts that met their next event."""
    return met.groupBy(_event_date(F.col("us")), F.col("seq").alias("alert_id")).agg(
        F.min(from_us(F.col("_next.us"))).alias("resolved_at")).withColumn("resolution_reason", F.lit(reason))


def recovery_changes(alerts: DataFrame, recoveries: DataFrame, width: int = timeline.CHUNK_US) -> DataFrame:
    """R1 as change rows, for ``table.apply_changes``: open alerts only, no row of the table is joined back.

    Hand in the alerts of the recoveries' dates and the day before (``within`` prunes the folders).
    """
    return _changes(_recovery_meetings(alerts, recoveries, width), "recovery_event")


def resolve_by_recovery(alerts: DataFrame, recoveries: DataFrame, width: int = timeline.CHUNK_US) -> DataFrame:
    """CRITICAL rows are resolved by the first recovery of their device, at most 24 h later,
    with the same interface, or (ADJCHANGE) the same neighbor or AS, or, for an ACTIVE recovery
    without any key, the same mnemonic. A stored recovery row resolves itself too.

    ``recoveries`` are rows with the alert columns; AS counts only when the recovery names a neighbor.
    """
    met = _recovery_meetings(alerts, recoveries, width)
    found = met.select(F.col("seq").alias("alert_id"), from_us(F.col("_next.us")).alias("at"))
    return _resolve(alerts, found, "recovery_event")


def _recovery_meetings(alerts: DataFrame, recoveries: DataFrame, width: int) -> DataFrame:
    asn = F.coalesce("as_number", F.lit(0))
    open_rows = alerts.where((F.col("classification") == "CRITICAL") & F.col("resolved_at").isNull())
    akeys = _match_keys(F.col("interface_name"), F.col("bgp_neighbor"), asn, F.col("mnemonic"),
                        F.col("mnemonic").isin(fixed.RECOVERY_ALWAYS))
    iface = F.coalesce(text.blank_to_null(F.col("interface_name")),
                       text.interface_in_message(F.col("message")), F.lit(""))
    named = (F.col("bgp_neighbor") != "") & (F.col("mnemonic") == "ADJCHANGE")
    alone = (iface == "") & ~named & F.col("mnemonic").isin(fixed.RECOVERY_ALWAYS)
    rkeys = _match_keys(iface, F.col("bgp_neighbor"), F.when(named, asn).otherwise(F.lit(0)), F.col("mnemonic"), alone)
    at = to_us(F.col("timestamp")).alias("us")
    seq = F.col("alert_id").alias("seq")
    a = open_rows.select("device_name", F.explode(akeys).alias("k"), at, seq).select(
        "device_name", "k.kind", "k.value", "us", "seq")
    c = recoveries.select("device_name", F.explode(rkeys).alias("k"), at, seq).select(
        "device_name", "k.kind", "k.value", "us", "seq")
    return _next_event(a, c, ["device_name", "kind", "value"], width)


def resolve_silent_faults(alerts: DataFrame, bgp_ups: DataFrame, topology: DataFrame, bgp_bundle: DataFrame,
                          width: int = timeline.CHUNK_US) -> DataFrame:
    """R2: a BGP Up on a mapped bundle resolves hardware faults on the bundle's members, same
    device, at most 24 h back.

    ``bgp_ups``: non-flapping ADJCHANGE recoveries with the alert columns.
    """
    met = _silent_meetings(alerts, bgp_ups, topology, bgp_bundle, width)
    found = met.select(F.col("seq").alias("alert_id"), from_us(F.col("_next.us")).alias("at"))
    return _resolve(alerts, found, "bgp_up_inferred")


def silent_fault_changes(alerts: DataFrame, bgp_ups: DataFrame, topology: DataFrame, bgp_bundle: DataFrame,
                         width: int = timeline.CHUNK_US) -> DataFrame:
    """R2 as change rows (see :func:`recovery_changes`)."""
    return _changes(_silent_meetings(alerts, bgp_ups, topology, bgp_bundle, width), "bgp_up_inferred")


def _silent_meetings(alerts: DataFrame, bgp_ups: DataFrame, topology: DataFrame, bgp_bundle: DataFrame, width: int) -> DataFrame:
    members = topology.select(F.col("ip").alias("source_ip"), "bundle", F.explode("members").alias("interface_name"))
    peers = bgp_bundle.select(F.col("ip").alias("source_ip"), F.col("neighbor").alias("bgp_neighbor"), "bundle")
    links = topology.select(F.col("ip").alias("source_ip"), "bundle").distinct()
    at, seq = to_us(F.col("timestamp")).alias("us"), F.col("alert_id").alias("seq")
    faults = alerts.where(F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS) & F.col("resolved_at").isNull())
    # Faults are matched by device name; the members are those of the address the Up came from.
    a = faults.select("device_name", "interface_name", at, seq)
    c = (
        bgp_ups.select("device_name", "source_ip", "bgp_neighbor", at, seq)
        .join(peers, ["source_ip", "bgp_neighbor"]).join(links, ["source_ip", "bundle"], "left_semi")
        .join(members, ["source_ip", "bundle"]).select("device_name", "interface_name", "us", "seq")
    )
    return _next_event(a, c, ["device_name", "interface_name"], width)


def resolve_noise(alerts: DataFrame, as_of, enabled: bool = True) -> DataFrame:
    """With the toggle on, all unresolved hardware rows become NOISE and resolved."""
    if not enabled:
        return alerts
    hit = F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS) & F.col("resolved_at").isNull()
    return alerts.withColumns({
        "classification": F.when(hit, "NOISE").otherwise(F.col("classification")),
        "resolution_reason": F.when(hit, "noise_toggle_enabled").otherwise(F.col("resolution_reason")),
        "resolved_at": F.when(hit, ntz(as_of)).otherwise(F.col("resolved_at")),
    })


def noise_changes(alerts: DataFrame, as_of) -> DataFrame:
    """R3 as change rows: the unresolved hardware rows, read by two columns."""
    hit = F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS) & F.col("resolved_at").isNull()
    return alerts.where(hit).select(
        F.to_date("timestamp").alias("event_date"), "alert_id", F.lit("NOISE").alias("classification"),
        F.lit("noise_toggle_enabled").alias("resolution_reason"), ntz(as_of).alias("resolved_at"))


def resolve_incidents(incidents: DataFrame, resolved: DataFrame) -> DataFrame:
    """R4, incident side. ``resolved``: id, at."""
    hit = resolved.select("id", F.col("at").alias("_at"))
    return incidents.join(hit, "id", "left").withColumns({
        "status": F.when(F.col("_at").isNotNull(), "resolved").otherwise(F.col("status")),
        "resolved_at": F.coalesce("_at", "resolved_at"),
    }).drop("_at")


def resolve_incident_alerts(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """R4, alert side: unresolved alerts of a resolved incident."""
    hit = resolved.select(F.col("id").alias("incident_id"), F.col("at").alias("_at"))
    now = F.col("resolved_at").isNull() & F.col("_at").isNotNull()
    return (
        alerts.join(hit, "incident_id", "left")
        .withColumn("resolution_reason", F.when(now, "incident_resolved").otherwise(F.col("resolution_reason")))
        .withColumn("resolved_at", F.coalesce("resolved_at", "_at"))
        .drop("_at")
    )


def incident_alert_changes(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """R4 as change rows: the unresolved alerts of the resolved incidents, ``resolved`` (id, at)."""
    hit = resolved.select(F.col("id").alias("incident_id"), F.col("at").alias("resolved_at"))
    return alerts.where("resolved_at IS NULL").select(F.to_date("timestamp").alias("event_date"), "alert_id", "incident_id").join(
        hit.where("resolved_at IS NOT NULL"), "incident_id").select(
        "event_date", "alert_id", "resolved_at", F.lit("incident_resolved").alias("resolution_reason"))


def prune_recovered(cards: DataFrame, alerts: DataFrame, from_storage: bool = False) -> DataFrame:
    """Cards without a later recovery on their device with the same interface, neighbor, or
    (same mnemonic) interface found in text.

    A card is pruned when the latest recovery under one of its keys is later than its start, so the
    alerts are reduced to one row per key before they meet the cards. ``from_storage`` also reads
    the recovery's interface from its text for the first comparison and looks only at the
    mnemonics that storage is asked for.
    """
    rows = alerts
    if from_storage:
        rows = rows.where(F.col("mnemonic").isin(fixed.RECOVERY_UP + fixed.RECOVERY_ALWAYS))
    rows = rows.where(text.is_recovery(F.col("mnemonic"), F.col("message")))
    in_text = F.coalesce(text.interface_in_message(F.col("message")), F.lit(""))
    own = F.col("interface_name")
    first = F.when(own != "", own).otherwise(in_text) if from_storage else own
    second = first if from_storage else in_text

    def keys(interface: Column, neighbor: Column, text_interface: Column) -> Column:
        def key(kind, value):
            return F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value")))
        same = F.when(text_interface != "", F.concat_ws("|", "mnemonic", text_interface)).otherwise(F.lit(""))
        return F.explode(F.array_compact(F.array(
            key("interface", interface), key("neighbor", neighbor), key("text", same))))

    latest = (
        rows.select("device_name", keys(first, F.col("bgp_neighbor"), second).alias("k"), "timestamp")
        .groupBy("device_name", "k").agg(F.max("timestamp").alias("_latest"))
    )
    card_text = F.coalesce(text.blank_to_null(own), text.interface_in_message(F.col("message")), F.lit(""))
    done = (
        cards.select("card_id", "device_name", "started_at", keys(own, F.col("bgp_neighbor"), card_text).alias("k"))
        .join(latest, ["device_name", "k"]).where("_latest > started_at").select("card_id").distinct()
    )
    return cards.join(done, "card_id", "left_anti")


def _state_key() -> Column:
    return text.recovery_state_key(
        F.col("device_name"), F.col("mnemonic"), F.col("interface_name"), F.col("bgp_neighbor"),
        F.coalesce("as_number", F.lit(0)), F.col("message"))


def active_alerts(alerts: DataFrame, hardware_noise: bool = True, page: int | None = None) -> DataFrame:
    """The unresolved CRITICAL rows whose fault has no newer recovery; the newest ``page`` of them if given.

    Per state key the newest event decides; an event that is a recovery ends the key. All faults
    and all recoveries since the oldest of them are looked at.
    """
    unresolved = alerts.where((F.col("classification") == "CRITICAL") & F.col("resolved_at").isNull())
    if hardware_noise:
        unresolved = unresolved.where(~F.col("mnemonic").isin(fixed.HARDWARE_MNEMONICS))
    recov = alerts.where(F.col("mnemonic").isin(fixed.RECOVERY_UP + fixed.RECOVERY_ALWAYS))
    floor = unresolved.agg(F.min("timestamp"))
    recov = recov.where(F.col("timestamp") >= floor.scalar())
    is_rec = text.is_recovery(F.col("mnemonic"), F.col("message"))
    crit = unresolved.withColumns({"_key": _state_key(), "_rec": is_rec})
    # At one instant a CRITICAL row stands before a recovery row, as the rows are merged in that order.
    states = crit.select("_key", "timestamp", F.lit(1).alias("_first"), "alert_id", "_rec").unionByName(
        recov.where(is_rec).select(_state_key().alias("_key"), "timestamp", F.lit(0).alias("_first"), "alert_id",
                                   F.lit(True).alias("_rec")))
    latest = states.groupBy("_key").agg(
        F.max_by("_rec", F.struct("timestamp", "_first", "alert_id")).alias("_ended"))
    out = crit.where(~F.col("_rec")).join(latest.where(~F.col("_ended")), "_key").drop("_key", "_rec", "_ended")
    return out if page is None else out.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(page)


def incident_cards(rows: DataFrame, mode: str = "rebuilt", message_length: int | None = None) -> DataFrame:
    """One card per group key.

    ``rebuilt``: the newest row is the card, it gives started_at and last_alert. ``live``: the first
    row is the card and started_at, the newest gives last_alert. ``message_length`` cuts the message.
    """
    message = F.col("c.message") if message_length is None else F.substring("c.message", 1, message_length)
    key = text.incident_group_key(
        F.col("device_name"), F.col("mnemonic"), F.col("interface_name"), F.col("bgp_neighbor"),
        F.coalesce("as_number", F.lit(0)), F.col("message"))
    order = F.struct("timestamp", "alert_id")
    face = F.struct("alert_id", "device_name", "mnemonic", "message", "classification", "interface_name",
                    "client_name", "as_name", "bgp_neighbor", "as_number", "acknowledged_at", "timestamp")
    pick = F.max_by if mode == "rebuilt" else F.min_by
    grouped = rows.groupBy(key.alias("group_key")).agg(
        pick(face, order).alias("c"), F.count("*").alias("alert_count"), F.max("timestamp").alias("last_alert"))
    title = text.incident_title(F.col("c.mnemonic"), F.col("c.device_name"), F.col("c.message"),
                                F.col("c.interface_name"), F.col("c.as_name"))
    return grouped.select(
        F.concat(F.lit("ALERT-"), F.col("c.alert_id").cast("string")).alias("card_id"), "group_key",
        title.alias("title"), F.col("c.classification").alias("severity"), "c.device_name", "c.mnemonic",
        message.alias("message"), F.lit("active").alias("status"), "alert_count",
        F.col("c.timestamp").alias("started_at"), "last_alert", "c.interface_name", "c.client_name", "c.as_name",
        "c.bgp_neighbor", "c.as_number", "c.acknowledged_at")


def restore_acks(cards: DataFrame, acks: DataFrame) -> DataFrame:
    """acknowledged_at from the alert row, overridden by the newest ack of the card."""
    newest = acks.groupBy(F.col("incident_id").alias("card_id")).agg(
        F.max(F.struct("created_at", "operator_name", "comment")).alias("a"))
    return cards.join(newest, "card_id", "left").withColumns({
        "acknowledged_at": F.coalesce("a.created_at", "acknowledged_at"),
        "acknowledged_by": F.col("a.operator_name"),
        "ack_comment": F.col("a.comment"),
    }).withColumn("acknowledged", F.col("acknowledged_at").isNotNull()).drop("a")


def ack_changes(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """R9 as change rows: only alerts that an ack names, by number or by incident."""
    rows = alerts.select("timestamp", "alert_id", "incident_id", "acknowledged_at")
    single, whole = _ack_times(acks)
    named = rows.join(single, "alert_id").select("timestamp", "alert_id", F.col("_own").alias("at"), F.lit(0).alias("rank"))
    of_incident = rows.where("acknowledged_at IS NULL").join(whole, "incident_id").select(
        "timestamp", "alert_id", F.col("_inc").alias("at"), F.lit(1).alias("rank"))
    return named.unionByName(of_incident).groupBy(F.to_date("timestamp").alias("event_date"), "alert_id").agg(
        F.min(F.struct("rank", "at")).alias("m")).select("event_date", "alert_id", F.col("m.at").alias("acknowledged_at"))


def _ack_times(acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``alert_id, _own``: latest ack of a row, ``incident_id, _inc``: first ack of an incident)."""
    number = F.regexp_replace("incident_id", "ALERT-", "")
    single = acks.where(number.rlike(r"^\d+$")).groupBy(number.cast("bigint").alias("alert_id")).agg(
        F.max("created_at").alias("_own"))
    whole = acks.where(F.col("incident_id").startswith("INC-")).groupBy("incident_id").agg(
        F.min("created_at").alias("_inc"))
    return single, whole


def apply_acks(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """An ack of ``ALERT-n`` (or ``n``) sets that row; an ack of ``INC-...`` sets its rows that
    were not acknowledged. Among several acks of a row the latest ``ALERT`` one stands; of an
    incident the first one does."""
    single, whole = _ack_times(acks)
    return (
        alerts.join(single, "alert_id", "left").join(whole, "incident_id", "left")
        .withColumn("acknowledged_at", F.coalesce("_own", "acknowledged_at", "_inc"))
        .drop("_own", "_inc")
    )
