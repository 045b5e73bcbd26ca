"""Who would be notified and what is pending, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text
from ..functions.times import ntz, to_us
from ..session import materialize
from . import timeline


def severity_rank(classification: Column) -> Column:
    pairs = list(fixed.SEVERITY_RANK.items())
    out = F.when(classification == pairs[0][0], pairs[0][1])
    for name, rank in pairs[1:]:
        out = out.when(classification == name, rank)
    return out.otherwise(0)


def meets_threshold(classification: Column, floor: str = "CRITICAL") -> Column:
    """At or above the configured floor; an unknown floor means CRITICAL."""
    rank = fixed.SEVERITY_RANK.get(floor, fixed.SEVERITY_RANK["CRITICAL"])
    return severity_rank(classification) >= rank


def under_maintenance(df: DataFrame, windows: DataFrame, offset_hours: int = 0,
                      ts: str = "timestamp") -> DataFrame:
    """Adds ``in_maintenance``: the event time lies in a window of its device, ends inclusive.

    Windows (device_name, start_time, end_time) hold UTC bounds; ``offset_hours`` converts them to
    local face values. Overlapping windows of a device are merged first and each is listed under the
    hours it covers, so an event meets the few windows of its own hour, never all of its device.
    """
    shift = F.expr(f"INTERVAL '{offset_hours}' HOUR")
    w = windows.select(
        "device_name", (to_us(F.col("start_time") + shift)).alias("a"), (to_us(F.col("end_time") + shift)).alias("z"))
    w = w.where("a <= z")
    hours = w.select(
        "device_name", "a", "z",
        F.explode(F.sequence(timeline.chunk("a"), timeline.chunk("z"))).alias("_hour"))
    # What a window covers of one hour, merged: the event's hour then joins one row.
    lo = F.greatest(F.col("a"), F.col("_hour") * timeline.CHUNK_US)
    hi = F.least(F.col("z"), (F.col("_hour") + 1) * timeline.CHUNK_US - 1)
    by_hour = Window.partitionBy("device_name", "_hour").orderBy("lo", "hi")
    seen = F.max("hi").over(by_hour.rowsBetween(Window.unboundedPreceding, -1))
    parts = hours.select("device_name", "_hour", lo.alias("lo"), hi.alias("hi")).withColumn(
        "isle", F.when(seen.isNull() | (F.col("lo") > seen + 1), 1).otherwise(0))
    isles = parts.withColumn("isle", F.sum("isle").over(by_hour)).groupBy("device_name", "_hour", "isle").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cover = isles.groupBy("device_name", "_hour").agg(F.collect_list(F.struct("lo", "hi")).alias("_cover"))
    at = to_us(F.col(ts))
    return (
        df.withColumn("_us", at).withColumn("_hour", timeline.chunk("_us"))
        .join(cover, ["device_name", "_hour"], "left")
        .withColumn("in_maintenance", F.coalesce(
            F.exists("_cover", lambda c: (c["lo"] <= F.col("_us")) & (F.col("_us") <= c["hi"])), F.lit(False)))
        .drop("_us", "_hour", "_cover")
    )


def active_windows(windows: DataFrame, as_of) -> DataFrame:
    """Windows that have not ended, by start."""
    return windows.where(F.col("end_time") >= ntz(as_of)).orderBy("start_time", "id")


def ack_suppressed(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds ``ack_muted``: the alert's incident, or the card of its group key, was acknowledged
    at or before the event.

    ``cards``: card_id, the group key columns and acknowledged_at. Rows with an incident id look
    only at that card; the others only at cards that are no ``INC-`` cards.
    """
    acked = cards.where(F.col("acknowledged_at").isNotNull())
    own = acked.groupBy(F.col("card_id").alias("incident_id")).agg(F.min("acknowledged_at").alias("_by_id"))
    by_key = (
        acked.where(~F.col("card_id").startswith("INC-"))
        .groupBy(F.col("group_key")).agg(F.min("acknowledged_at").alias("_by_key"))
    )
    has_id = F.coalesce(F.col("incident_id"), F.lit("")) != ""
    muted = F.when(has_id, F.col("_by_id") <= F.col("timestamp")).otherwise(F.col("_by_key") <= F.col("timestamp"))
    return (
        df.join(own, "incident_id", "left").join(by_key, "group_key", "left")
        .withColumn("ack_muted", F.coalesce(muted, F.lit(False))).drop("_by_id", "_by_key")
    )


def will_notify(df: DataFrame, floor: str = "CRITICAL", maxpfx_enabled: bool = True) -> DataFrame:
    """Adds ``maxpfx_muted``, ``notification_sent`` (the stored flag, before maintenance and
    acks) and ``will_notify``. Needs should_send, suppress_notification, in_maintenance, ack_muted."""
    muted = (F.col("mnemonic") == "MAXPFX") & F.lit(not maxpfx_enabled)
    sent = (
        F.col("should_send") & meets_threshold(F.col("classification"), floor)
        & ~F.col("suppress_notification") & ~F.col("maxpfx_muted")
    )
    return (
        df.withColumn("maxpfx_muted", muted).withColumn("notification_sent", sent)
        .withColumn("will_notify", F.col("notification_sent") & ~F.col("in_maintenance") & ~F.col("ack_muted"))
    )


def route(df: DataFrame) -> DataFrame:
    """Adds ``to_store``, ``to_tracker``, ``to_broadcast``."""
    store = F.col("should_send") | F.col("is_recovery")
    return df.withColumns({
        "to_store": store,
        "to_tracker": (store | (F.col("classification") == "CRITICAL")) & ~F.col("maxpfx_muted"),
        "to_broadcast": F.col("should_send") & ~F.col("maxpfx_muted"),
    })


def _peer() -> Column:
    label = text.sanitise(F.col("bgp_neighbor"))
    asn = F.col("as_number").cast("string")
    suffix = F.when(
        F.col("as_number").isNotNull() & (F.col("as_name") != ""),
        F.concat(F.lit(" (AS"), asn, F.lit(" "), text.sanitise(F.col("as_name")), F.lit(")")),
    ).when(F.col("as_number").isNotNull(), F.concat(F.lit(" (AS"), asn, F.lit(")"))).otherwise(F.lit(""))
    return F.when(F.col("bgp_neighbor") != "", F.concat(label, suffix))


def _iface() -> Column:
    name = text.sanitise(F.col("interface_name"))
    more = F.when(F.col("interface_description") != "",
                  F.concat(F.lit(" — "), text.sanitise(F.col("interface_description")))).otherwise(F.lit(""))
    return F.when(F.col("interface_name") != "", F.concat(name, more))


def _fields(pairs: list[tuple[str, Column, bool]]) -> Column:
    """Array of (name, value, inline) without the empty ones."""
    made = [F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(i).alias("inline")) for n, v, i in pairs]
    return F.filter(F.array(*made), lambda f: f["value"].isNotNull() & (f["value"] != ""))


def _log_fields() -> list[tuple[str, Column, bool]]:
    def plain(name: str, inline: bool = True):
        return text.sanitise(F.col(name)), inline

    return [
        ("Device", *plain("device_name")), ("Location", *plain("device_location")), ("Event", *plain("event_type")),
        ("BGP Peer", text.sanitise(_peer()), False), ("Interface", text.sanitise(_iface()), False),
        ("VRF", *plain("vrf")), ("Client", *plain("client_name")),
    ]


def _lookup(values: dict, default) -> Column:
    cls = F.col("classification")
    out = None
    for k, v in values.items():
        out = F.when(cls == k, v) if out is None else out.when(cls == k, v)
    return out.otherwise(default)


def _line(label: str, value: Column, quote: str = "") -> Column:
    """``*Label:* value`` or NULL when there is no value."""
    return F.when(value.isNotNull() & (value != ""),
                  F.concat(F.lit(f"*{label}:* {quote}"), value, F.lit(quote)))


def _text(lines: list[Column | str]) -> Column:
    rows = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return text.sanitise(F.array_join(F.array_compact(rows), "\n"), fixed.MAX_TEXT_LEN)


def _stamp(zone: str) -> Column:
    return F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(f" {zone}"))


def _iso(offset: str) -> Column:
    micro = F.extract(F.lit("SECOND"), F.col("timestamp")) % 1 != 0
    return F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micro, F.date_format("timestamp", ".SSSSSS")).otherwise(""), F.lit(offset))


def _link(base_url: str, dashboard: str, offset_hours: int) -> Column:
    ms = F.call_function("div", to_us(F.col("timestamp")), F.lit(1000).cast("bigint")) - offset_hours * 3_600_000
    return F.concat(F.lit(f"{base_url}/d/{dashboard}/log-dashboard?orgId=1&from="), (ms - 300_000).cast("string"),
                    F.lit("&to="), (ms + 300_000).cast("string"), F.lit("&var-device="), F.col("device_name"))


def _embed(title: Column, description: Column, color: Column, fields: Column, footer: str, offset: str) -> Column:
    return F.to_json(F.struct(F.array(F.struct(
        title.alias("title"), description.alias("description"), color.alias("color"), fields.alias("fields"),
        F.struct(F.lit(footer).alias("text")).alias("footer"), _iso(offset).alias("timestamp"),
    )).alias("embeds")))


def notification_outbox(df: DataFrame, kind: str = "alert", base_url: str = "http://localhost:3000",
                        dashboard: str = "logs", footer: str = "alertloom",
                        offset_hours: int = fixed.LOCAL_OFFSET_HOURS) -> DataFrame:
    """``seq, kind, title, payload, text`` per row, for an ``alert``, ``resolution`` or
    ``escalation``. Empty fields are left out.

    Needs the enriched columns and ``timestamp``; ``incident_id`` and ``related_count`` for alerts
    with an incident, ``incident_id`` for resolutions, ``elapsed_minutes`` for escalations.
    """
    sign = "+" if offset_hours >= 0 else "-"
    offset = f"{sign}{abs(offset_hours):02d}:00"
    zone = f"UTC{offset}"
    device, event = text.sanitise(F.col("device_name")), text.sanitise(F.col("event_type"))
    mnemonic = text.sanitise(F.col("mnemonic"))
    view = F.concat(F.lit("[View in Grafana]("), _link(base_url, dashboard, offset_hours), F.lit(")"))
    detail = [
        _line("Location", text.sanitise(F.col("device_location"))),
        _line("Peer", _peer(), "`"), _line("Interface", _iface(), "`"),
    ]
    if kind == "alert":
        emoji = _lookup(fixed.SEVERITY_EMOJI, "⚪")
        title = F.concat_ws(" ", emoji, F.col("classification"), F.lit("—"), event)
        inc = text.sanitise(F.coalesce(F.col("incident_id"), F.lit("")))
        related = F.when(inc != "", F.coalesce(F.col("related_count"), F.lit(0)).cast("string"))
        fields = _fields(_log_fields() + [("Incident", inc, True), ("Related Events", related, True)])
        body = F.concat(view, F.lit("\n`"), mnemonic, F.lit("` on **"), device, F.lit("**"))
        payload = _embed(title, body, _lookup(fixed.SEVERITY_COLOR, 0x444466), fields, footer, offset)
        message = _text([
            F.concat(F.lit("*"), title, F.lit("*")), "", F.concat(F.lit("*Device:* "), device), *detail,
            _line("VRF", text.sanitise(F.col("vrf"))), _line("Client", text.sanitise(F.col("client_name"))),
            _line("Incident", inc, "`"), _line("Related Events", related), "",
            F.concat(F.lit("_"), _stamp(zone), F.lit("_"))])
    elif kind == "resolution":
        title = F.concat(F.lit("✅ RESOLVED — "), device)
        inc = text.sanitise(F.col("incident_id"))
        body = F.concat(F.lit("Incident `"), inc, F.lit("` resolved by **"), event, F.lit("**\n"), view)
        fields = _fields(_log_fields() + [("Incident", inc, True)])
        payload = _embed(title, body, F.lit(fixed.RESOLUTION_COLOR), fields, f"{footer} — Resolution", offset)
        location, peer, iface = detail
        message = _text([
            F.concat(F.lit("*"), title, F.lit("*")), F.concat(F.lit("Incident `"), "incident_id", F.lit("` resolved")),
            "", F.concat(F.lit("*Event:* "), event), location, iface, peer, "",
            F.concat(F.lit("_"), _stamp(zone), F.lit("_"))])
    elif kind == "escalation":
        title = F.concat(F.lit("🚨 ESCALATION — "), device)
        minutes = F.col("elapsed_minutes").cast("string")
        subject = F.coalesce(text.blank_to_null(text.sanitise(F.col("interface_name"))),
                             text.blank_to_null(text.sanitise(F.col("bgp_neighbor"))))
        on = F.when(subject.isNotNull(), F.concat(F.lit(" on `"), subject, F.lit("`"))).otherwise(F.lit(""))
        body = F.concat(F.lit("`"), mnemonic, F.lit("`"), on, F.lit("\n**Unacknowledged for "), minutes,
                        F.lit(" minutes** — CRITICAL alert requires attention"))
        fields = _fields([
            ("Device", device, True), ("Location", text.sanitise(F.col("device_location")), True),
            ("Status", F.concat(F.lit("UNACKNOWLEDGED FOR >"), minutes, F.lit(" MIN")), True),
            ("Original Alert", _stamp(zone), False), ("Interface / Peer", subject, False)])
        payload = _embed(title, body, F.lit(fixed.ESCALATION_COLOR), fields, f"{footer} — Escalation", offset)
        location, peer, iface = detail
        message = _text([
            F.concat(F.lit("*⚠️ ESCALATION — "), device, F.lit("*")), F.concat(F.lit("*"), mnemonic, F.lit("*")), "",
            F.concat(F.lit("*Unacknowledged for "), minutes, F.lit(" minutes*")),
            "CRITICAL alert requires immediate attention", "", iface, peer, location, "",
            F.concat(F.lit("*Original Alert:* _"), _stamp(zone), F.lit("_"))])
    else:
        raise ValueError(f"unknown outbox kind {kind!r}")
    return df.select("seq", F.lit(kind).alias("kind"), title.alias("title"), payload.alias("payload"),
                     message.alias("text"))


def escalation_events(tracked: DataFrame, recoveries: DataFrame, resolved_devices: DataFrame | None = None,
                      acks: DataFrame | None = None) -> DataFrame:
    """One timeline of what starts (``track``) and stops an escalation.

    ``tracked`` / ``recoveries``: seq, us, device_name, mnemonic, bgp_neighbor, interface_name.
    ``resolved_devices``: us, device_name (an incident of the device was resolved).
    ``acks``: us, device_name, mnemonic (acknowledged, or escalated already).
    Scope says how far an event reaches: ``key``, ``mnemonic`` or ``device``.
    """
    disc = F.coalesce(text.blank_to_null(F.col("bgp_neighbor")), F.col("interface_name"), F.lit(""))

    def rows(df, what, scope, mnemonic, d, seq, phase):
        return df.select(
            F.col("device_name"), mnemonic.alias("mnemonic"), d.alias("disc"), "us", seq.alias("seq"),
            F.lit(what).alias("what"), F.lit(scope).alias("scope"), F.lit(phase).alias("phase"))

    any_ = F.lit(None).cast("string")
    late = F.lit(2 ** 62).cast("bigint")
    out = rows(tracked, "track", "key", F.col("mnemonic"), disc, F.col("seq"), 0).unionByName(
        rows(recoveries, "recover", "key", F.col("mnemonic"), disc, F.col("seq"), 1))
    if resolved_devices is not None:
        seq = F.col("seq") if "seq" in resolved_devices.columns else late
        out = out.unionByName(rows(resolved_devices, "clear", "device", any_, any_, seq, 2))
    if acks is not None:
        out = out.unionByName(rows(acks, "ack", "mnemonic", F.col("mnemonic"), any_, late, 3))
    return out


def escalations(tracked: DataFrame, recoveries: DataFrame, as_of_us: int,
                resolved_devices: DataFrame | None = None, acks: DataFrame | None = None,
                delay_s: int = fixed.ESCALATION_DELAY, maxpfx_enabled: bool = True,
                width: int = timeline.CHUNK_US) -> DataFrame:
    """What becomes of each tracked alert by ``as_of_us``.

    The clock of a key (device, mnemonic, neighbor or interface) runs from an alert until the next
    event that reaches the key: another alert (which restarts it and drops an ack), a recovery, an
    incident resolution of the device, or an ack of (device, mnemonic). ``pending``: nothing ended
    the alert and its delay is over at ``as_of_us``. ``escalated_us``: when it was sent on. Sending
    one alert marks all keys of its (device, mnemonic) that are tracked then, so within such a group
    the next one to be sent is the first alert tracked after that moment.
    """
    delay = delay_s * timeline.SECOND
    events = escalation_events(tracked, recoveries, resolved_devices, acks)
    events = events.where(F.col("us") <= as_of_us)
    pos = F.struct("us", "seq", "phase", "what")
    order = ["us", "seq", "phase"]
    starts = events.where("what = 'track'")

    def next_of(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        both = starts.select("device_name", "mnemonic", "disc", "us", "seq", "phase", "what").unionByName(
            rows.select("device_name", "mnemonic", "disc", "us", "seq", "phase", "what"))
        both = both.withColumn("chunk", timeline.chunk("us", width))
        cause = F.when(F.col("what") != "track", pos)
        return timeline.running_max(both, keys, {name: cause}, order, False, reverse=True).where(
            "what = 'track'").select("seq", name)

    same_key = ["device_name", "mnemonic", "disc"]
    key_rows = events.where("scope = 'key'").withColumn("chunk", timeline.chunk("us", width))
    out = timeline.running_max(key_rows, same_key, {"n_key": pos}, order, False, reverse=True).where(
        "what = 'track'").drop("chunk", "phase", "scope", "what")
    ends = ["n_key"]
    if resolved_devices is not None:
        out = out.join(next_of(events.where("scope = 'device'"), ["device_name"], "n_dev"), "seq", "left")
        ends.append("n_dev")
    if acks is not None:
        out = out.join(next_of(events.where("scope = 'mnemonic'"), ["device_name", "mnemonic"], "n_ack"), "seq", "left")
        ends.append("n_ack")
    end = F.least(*[F.col(c) for c in ends]) if len(ends) > 1 else F.col(ends[0])
    out = out.withColumn("end", end)
    due = F.col("us") + F.lit(delay)
    ran_out = F.coalesce(due < F.col("end.us"), due <= as_of_us)
    muted = (F.col("mnemonic") == "MAXPFX") & F.lit(not maxpfx_enabled)
    out = materialize(out.select(
        "seq", "device_name", "mnemonic", "disc", "us", due.alias("due_us"),
        F.col("end.us").alias("ended_us"), F.col("end.what").alias("ended_by"),
        (F.col("end").isNull() & (due <= as_of_us)).alias("pending"),
        F.call_function("div", F.lit(as_of_us) - F.col("us"), F.lit(60 * timeline.SECOND)).alias("elapsed_minutes"),
        (ran_out & ~muted).alias("ran_out"),
    ), "escalations")
    group = ["device_name", "mnemonic", "us"]
    moments = out.where("ran_out").groupBy(*group).agg(F.min("seq").alias("seq"))
    sent = timeline.throttle(moments, ["device_name", "mnemonic"], delay, width=width).where("kept").select(
        *group, F.lit(True).alias("_sent"))
    return out.join(sent, group, "left").withColumn(
        "escalated_us", F.when(F.col("ran_out") & F.col("_sent"), F.col("due_us"))).drop("ran_out", "_sent")


def open_escalations(alerts: DataFrame, as_of, delay_s: int = fixed.ESCALATION_DELAY,
                     limit: int | None = None) -> DataFrame:
    """What is tracked after a restart: per key the newest of the CRITICAL rows (or of the oldest
    ``limit`` of them) of the last two delays that are neither resolved nor acknowledged, with minutes elapsed."""
    rows = alerts.where(
        (F.col("classification") == "CRITICAL") & F.col("resolved_at").isNull() & F.col("acknowledged_at").isNull()
        & (F.col("timestamp") >= ntz(as_of) - F.expr(f"INTERVAL '{2 * delay_s}' SECOND"))
        & (F.col("timestamp") <= ntz(as_of)))
    if limit is not None:
        rows = rows.orderBy("timestamp", "alert_id").limit(limit)
    rows = rows.where(F.coalesce(F.col("raw"), F.lit("")) != "")
    disc = F.coalesce(text.blank_to_null(F.col("bgp_neighbor")), F.col("interface_name"), F.lit(""))
    kept = rows.groupBy("device_name", "mnemonic", disc.alias("disc")).agg(
        F.max(F.struct("timestamp", "alert_id")).alias("r"))
    elapsed = F.timestamp_diff("SECOND", F.col("r.timestamp"), ntz(as_of))
    return kept.select(
        "device_name", "mnemonic", "disc", "r.alert_id", F.col("r.timestamp").alias("tracked_at"),
        (F.col("r.timestamp") + F.expr(f"INTERVAL '{delay_s}' SECOND") <= ntz(as_of)).alias("pending"),
        F.call_function("div", elapsed, F.lit(60).cast("bigint")).alias("elapsed_minutes"))


def failed_notifications(alerts: DataFrame, n: int = 100) -> DataFrame:
    """Newest attempted notifications with a channel that did not deliver."""
    failed = F.col("notification_sent") & (~F.col("discord_sent") | ~F.col("telegram_sent"))
    return alerts.where(failed).orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(n)


def delivery_changes(alerts: DataFrame, status: DataFrame, error_length: int | None = None) -> DataFrame:
    """N12 as change rows for ``table.apply_changes`` with ``null_keeps``: only alerts with a status."""
    errors = [(F.col(c) if error_length is None else F.substring(c, 1, error_length)).alias(c) for c in ("discord_error", "telegram_error")]
    new = status.select("alert_id", "discord_sent", "telegram_sent", *errors)
    return alerts.select(F.to_date("timestamp").alias("event_date"), "alert_id").join(new, "alert_id")


def apply_delivery(alerts: DataFrame, status: DataFrame, error_length: int | None = None) -> DataFrame:
    """Partial update of the channel flags and errors; NULL keeps the old value, errors are cut
    to ``error_length`` characters if that is given. ``status`` has one row per alert_id."""
    flags, errors = ["discord_sent", "telegram_sent"], ["discord_error", "telegram_error"]
    new = status.select("alert_id", *[F.col(c).alias(f"_{c}") for c in flags],
                        *[(F.col(c) if error_length is None else F.substring(c, 1, error_length)).alias(f"_{c}") for c in errors])
    return (
        alerts.join(new, "alert_id", "left")
        .withColumns({c: F.coalesce(f"_{c}", c) for c in flags + errors})
        .drop(*[f"_{c}" for c in flags + errors])
    )
