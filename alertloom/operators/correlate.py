"""Correlation of link failures and mass events into incidents.

Everything is expressed over positions ``p = struct(us, seq)`` on per-link and per-device
timelines, cut into chunks (see :mod:`timeline`). Nothing folds row by row:

* a link failure is live when the last failure or clear of that link, at most 60 s back, is a
  failure: a look-back window;
* an incident of a link lives until a recovery on its device or 24 h without a new event, and both
  are visible in the previous row of the link's timeline;
* a mass incident starts with the first mass event after the last break (a recovery, or 24 h
  without an event that could join it).

Input columns: ``seq, us, source_ip, device_name, mnemonic, event_type, classification,
interface_name, bundle_parent, bgp_neighbor, member_bundle, event_bundle, event_remote,
is_recovery`` (see ``enrich.event_bundle`` and ``enrich.with_recovery``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import blank_to_null
from ..session import materialize
from . import timeline
from .timeline import CHUNK_US, SECOND

COLUMNS = ["seq", "us", "source_ip", "device_name", "mnemonic", "event_type", "classification",
           "interface_name", "bundle_parent", "bgp_neighbor", "member_bundle", "event_bundle",
           "event_remote", "is_recovery"]
TTL_US = fixed.INCIDENT_TTL * SECOND
SLOT = ["slot_ip", "slot_bundle"]


def _pos() -> Column:
    return F.struct(F.col("us"), F.col("seq"))


def _alertable() -> Column:
    return F.col("classification").isin("CRITICAL", "WARNING")


def _is_mass_type() -> Column:
    return F.col("event_type").isin(fixed.MASS_EVENT_TYPES)


def fault_kind() -> Column:
    """``F`` for an event that fails its backhaul link, ``U`` for one that clears it, else NULL."""
    on_link = (
        (F.col("interface_name") != "") & (F.col("bundle_parent") != "")
        & F.col("member_bundle").isNotNull() & _alertable()
    )
    kind = F.col("event_type")
    return F.when(on_link & (kind.contains("Down") | kind.contains("Fault")), "F").when(
        on_link & (kind.contains("Up") | kind.contains("Clear")), "U"
    )


def flap_count(df: DataFrame, window_s: int = fixed.FLAP_COUNT_WINDOW, width: int = CHUNK_US) -> DataFrame:
    """Adds ``flap_count`` and ``is_flapping``: events of the same subject in the last 300 s."""
    subject = F.coalesce(
        blank_to_null(F.col("bgp_neighbor")), blank_to_null(F.col("interface_name")), F.col("mnemonic")
    )
    return (
        timeline.count_recent(df.withColumn("_subject", subject), ["source_ip", "_subject"],
                              window_s * SECOND, "flap_count", width=width)
        .withColumn("is_flapping", F.col("flap_count") >= fixed.FLAP_THRESHOLD)
        .drop("_subject")
    )


def mass_bgp(df: DataFrame, window_s: int = fixed.CORRELATION_WINDOW, threshold: int = fixed.MASS_THRESHOLD,
             width: int = CHUNK_US) -> DataFrame:
    """BGP down and max-prefix rows with ``others`` (earlier ones in 60 s) and ``is_mass``."""
    rows = df.where(_is_mass_type())
    counted = timeline.count_recent(rows, ["source_ip"], window_s * SECOND, "_n", _alertable(), width=width)
    others = F.col("_n") - F.when(_alertable(), 1).otherwise(0)
    return counted.withColumn("others", others).drop("_n").withColumn(
        "is_mass", F.col("others") >= threshold - 1
    )


def _probe_map(topology: DataFrame) -> DataFrame:
    """Per (ip, bundle) the failure slots an event on it can be a symptom of.

    The own link, and every link of the far device that comes back to this device.
    """
    near = topology.select(F.col("ip").alias("source_ip"), F.col("bundle").alias("event_bundle"), "remote_ip")
    far = topology.select(F.col("ip").alias("slot_ip"), F.col("bundle").alias("slot_bundle"),
                          F.col("remote_ip").alias("back_to"))
    return near.join(
        far, (near.remote_ip == far.slot_ip) & (near.source_ip == far.back_to)
    ).select("source_ip", "event_bundle", *SLOT)


def link_timeline(df: DataFrame, topology: DataFrame, window_s: int = fixed.CORRELATION_WINDOW,
                  width: int = CHUNK_US) -> DataFrame:
    """One row per event and failure slot it can see, with the slot's state just before it.

    ``live``: a failure is active; ``opens``: this event starts an episode; ``episode``: position of
    the event that started the current one.
    """
    window_us = window_s * SECOND
    link = df.where(F.col("event_bundle").isNotNull()).select(
        "seq", "us", "source_ip", "event_bundle", fault_kind().alias("kind")
    )
    own = link.withColumns({"slot_ip": F.col("source_ip"), "slot_bundle": F.col("event_bundle")})
    far = link.join(_probe_map(topology), ["source_ip", "event_bundle"]).withColumn(
        "kind", F.lit(None).cast("string")
    ).where(~((F.col("slot_ip") == F.col("source_ip")) & (F.col("slot_bundle") == F.col("event_bundle"))))
    rows = timeline.with_halo(own.unionByName(far.select(*own.columns)), window_us, width=width)
    w = (
        Window.partitionBy(*SLOT, "chunk").orderBy("us", "seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.last(F.when(F.col("kind").isNotNull(), F.struct("us", "kind")), ignorenulls=True).over(w)
    live = F.coalesce(
        (F.col("_f.kind") == "F") & (F.col("us") - F.col("_f.us") <= window_us), F.lit(False)
    )
    state = (
        rows.withColumn("_f", before)
        .withColumn("live", live)
        .withColumn("opens", F.coalesce((F.col("kind") == "F") & ~F.col("live"), F.lit(False)))
        .where(~F.col("halo"))
        .drop("_f", "halo")
    )
    return timeline.running_max(
        state, SLOT, {"episode": F.when(F.col("opens"), _pos())}, ["us", "seq"], inclusive=False
    )


def backhaul_episodes(df: DataFrame, topology: DataFrame, window_s: int = fixed.CORRELATION_WINDOW,
                      width: int = CHUNK_US) -> DataFrame:
    """C3 as a table: ``slot_ip, slot_bundle, start_us, last_us, failures`` per failure episode."""
    rows = link_timeline(df, topology, window_s, width).where(F.col("kind") == "F")
    start = F.when(F.col("opens"), _pos()).otherwise(F.col("episode"))
    return rows.groupBy(*SLOT, start.alias("start")).agg(
        F.max("us").alias("last_us"), F.count("*").alias("failures")
    ).select(*SLOT, F.col("start.us").alias("start_us"), "last_us", "failures")


def symptoms(df: DataFrame, topology: DataFrame, window_s: int = fixed.CORRELATION_WINDOW,
             width: int = CHUNK_US) -> DataFrame:
    """C4: per on-link event the slot it is a symptom of (earliest live episode) and ``is_root``.

    An event that starts an episode and is no symptom is a root.
    """
    rows = link_timeline(df, topology, window_s, width)
    seen = F.when(F.col("live"), F.struct("episode", *SLOT))
    return (
        rows.groupBy("seq")
        .agg(F.min(seen).alias("m"), F.max("opens").alias("o"),
             F.max(F.when(F.col("opens"), F.struct(*SLOT))).alias("own"))
        .where("m IS NOT NULL OR o")
        .select("seq", F.col("m").isNotNull().alias("is_bh_symptom"),
                (F.col("m").isNull() & F.col("o")).alias("is_bh_root"),
                F.coalesce("m.slot_ip", "own.slot_ip").alias("slot_ip"),
                F.coalesce("m.slot_bundle", "own.slot_bundle").alias("slot_bundle"))
    )


def backhaul_incidents(touches: DataFrame, recoveries: DataFrame, topology: DataFrame,
                       width: int = CHUNK_US) -> DataFrame:
    """Per touch of a link incident its opening position, ``inc = struct(us, seq)``.

    ``touches``: seq, us, slot_ip, slot_bundle, is_bh_root. ``recoveries``: seq, us, source_ip; a
    recovery ends every incident of its device, after the touch of the same event. A touch opens a
    new incident when it is a root, or when the row before it on the link is a recovery, is absent,
    or lies more than 24 h back.
    """
    slots = topology.select(F.col("ip").alias("slot_ip"), F.col("bundle").alias("slot_bundle")).distinct()
    kills = recoveries.withColumnRenamed("source_ip", "slot_ip").join(slots, "slot_ip").select(
        "seq", "us", *SLOT, F.lit(False).alias("is_bh_root"), F.lit(1).alias("phase")
    )
    rows = touches.select("seq", "us", *SLOT, "is_bh_root", F.lit(0).alias("phase")).unionByName(kills)
    rows = rows.withColumn("chunk", timeline.chunk("us", width))
    here = Window.partitionBy(*SLOT, "chunk").orderBy("us", "seq", "phase")
    row = F.struct("us", "seq", "phase")

    def opening(prev: Column) -> Column:
        fresh = prev.isNull() | (prev["phase"] == 1) | (F.col("us") - prev["us"] > TTL_US)
        return (F.col("phase") == 0) & (F.col("is_bh_root") | fresh)

    rows = rows.withColumn("prev", F.lag(row).over(here))
    local_open = F.when(F.col("prev").isNotNull() & opening(F.col("prev")), _pos())
    totals = rows.groupBy(*SLOT, "chunk").agg(
        F.max(row).alias("tail"),
        F.max(local_open).alias("open"),
        F.min(F.when(F.col("prev").isNull(), F.struct("us", "seq", "phase", "is_bh_root"))).alias("head"),
    )
    by_slot = Window.partitionBy(*SLOT).orderBy("chunk")
    totals = totals.withColumn("prev_in", F.lag("tail").over(by_slot))
    head_opens = (F.col("head.phase") == 0) & (
        F.col("head.is_bh_root") | F.col("prev_in").isNull() | (F.col("prev_in.phase") == 1)
        | (F.col("head.us") - F.col("prev_in.us") > TTL_US)
    )
    last_open = F.coalesce("open", F.when(head_opens, F.struct("head.us", "head.seq")))
    carry = totals.select(
        *SLOT, "chunk", "prev_in",
        F.max(last_open).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("open_in"),
    )
    return (
        rows.join(carry, [*SLOT, "chunk"], "left")
        .withColumn("prev", F.coalesce("prev", "prev_in"))
        .withColumn("opens_incident", F.coalesce(opening(F.col("prev")), F.lit(False)))
        .withColumn("inc", F.coalesce(
            F.max(F.when(F.col("opens_incident"), _pos())).over(
                here.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            F.col("open_in")))
        .where("phase = 0")
        .select("seq", "us", *SLOT, "opens_incident", "inc")
    )


def mass_incidents(rows: DataFrame, width: int = CHUNK_US) -> DataFrame:
    """Adds ``mass_inc`` (opening position of the device's mass incident, or NULL) and
    ``opens_mass``.

    ``rows`` are all events with ``is_mass``, ``joins`` (the event may join a mass incident: it is
    a mass event or carries no backhaul label) and ``is_recovery``. A chunk is at most 24 h wide, so
    the 24 h silence that ends an incident can only end at the first joining row of a chunk.
    """
    if width > TTL_US:
        raise ValueError("chunks must not be wider than the incident lifetime")
    rows = rows.withColumn("chunk", timeline.chunk("us", width))
    here = Window.partitionBy("source_ip", "chunk").orderBy("us", "seq")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    mass_pos = F.when(F.col("is_mass"), _pos())
    rows = rows.withColumns({
        "_kill": F.max(F.when(F.col("is_recovery"), _pos())).over(before),
        "_mass": F.max(mass_pos).over(before),
    })
    # First mass event of the chunk, or the first one after a recovery inside the chunk.
    first = F.col("is_mass") & (
        F.col("_mass").isNull() | F.coalesce(F.col("_mass") <= F.col("_kill"), F.lit(False))
    )
    rows = rows.withColumn("_first", F.when(first, _pos()))
    rows = rows.withColumn("_open", F.max("_first").over(before))

    totals = rows.groupBy("source_ip", "chunk").agg(
        F.min(F.when(F.col("joins"), F.col("us"))).alias("first_us"),
        F.max(F.when(F.col("joins"), F.col("us"))).alias("last_us"),
        F.max(F.when(F.col("is_recovery"), _pos())).alias("kill"),
        F.max("_first").alias("open"),
    )
    by_ip = Window.partitionBy("source_ip").orderBy("chunk")
    gap = F.coalesce(
        F.col("first_us") - F.max("last_us").over(by_ip.rowsBetween(Window.unboundedPreceding, -1)) > TTL_US,
        F.lit(False),
    )
    after_kill = F.when(F.col("kill").isNull() | (F.col("open") > F.col("kill")), F.col("open"))
    totals = totals.withColumn("gap", gap).withColumn("open", after_kill)
    totals = totals.withColumn(
        "segment", F.sum(F.when(F.col("kill").isNotNull() | F.col("gap"), 1).otherwise(0)).over(by_ip)
    )
    live = F.first("open", ignorenulls=True).over(
        Window.partitionBy("source_ip", "segment").orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carry = totals.withColumn("live_end", live).select(
        "source_ip", "chunk",
        F.when(~F.col("gap"), F.lag("live_end").over(by_ip)).alias("live_in"),
    )
    live_before = F.when(
        F.col("_kill").isNull() & F.col("live_in").isNotNull(), F.col("live_in")
    ).when(F.col("_kill").isNull() | (F.col("_open") > F.col("_kill")), F.col("_open"))
    return (
        rows.join(carry, ["source_ip", "chunk"], "left")
        .withColumn("_live", live_before)
        .withColumn("opens_mass", F.col("is_mass") & F.col("_live").isNull())
        .withColumn("mass_inc", F.when(F.col("joins"), F.coalesce("_live", mass_pos)))
        .drop("_kill", "_mass", "_first", "_open", "_live", "live_in", "chunk")
    )


def correlate(df: DataFrame, topology: DataFrame, width: int = CHUNK_US, stored: bool = False) -> DataFrame:
    """``seq, us, source_ip, is_root_cause, is_symptom, is_independent, is_flapping,
    flap_count, suppress_notification, inc_kind, inc_key, inc`` per event.

    ``inc`` is the opening position of the event's incident, ``inc_kind`` is ``link`` or ``mass``
    and ``inc_key`` the link or device; ``bh_inc`` stays set when a mass result hides a link symptom.
    The input is read several times: pass ``stored=True`` when it is a table already, else it is
    written once.
    """
    ev = df.select(*COLUMNS) if stored else materialize(df.select(*COLUMNS), "correlate-input")
    link = materialize(symptoms(ev, topology, width=width), "correlate-link")
    mass = mass_bgp(ev, width=width).where("is_mass").select("seq", "is_mass")
    no = F.lit(False)
    tagged = (
        flap_count(ev, width=width)
        .select("seq", "us", "source_ip", "is_recovery", "flap_count", "is_flapping")
        .join(link, "seq", "left").join(mass, "seq", "left")
        .withColumns({c: F.coalesce(F.col(c), no) for c in ("is_bh_symptom", "is_bh_root", "is_mass")})
        .withColumn("joins", F.col("is_mass") | ~(F.col("is_bh_symptom") | F.col("is_bh_root")))
    )
    tagged = materialize(tagged, "correlate-tagged")
    bh = backhaul_incidents(
        tagged.where(_touches_link()), tagged.where("is_recovery").select("seq", "us", "source_ip"),
        topology, width,
    ).select("seq", F.col("inc").alias("bh_inc"), F.col("opens_incident").alias("opens_link"))
    rows = mass_incidents(tagged, width).join(bh, "seq", "left")
    by_mass = F.col("is_mass") & ~F.col("is_bh_root")
    by_link = ~by_mass & (F.col("is_bh_symptom") | F.col("is_bh_root"))
    in_mass = ~by_link & F.col("mass_inc").isNotNull()
    root = F.when(by_link, F.col("is_bh_root")).otherwise(F.col("opens_mass"))
    symptom = F.when(by_link, F.col("is_bh_symptom")).otherwise(in_mass & ~F.col("opens_mass"))
    return rows.select(
        "seq", "us", "source_ip",
        root.alias("is_root_cause"),
        symptom.alias("is_symptom"),
        (~by_link & ~in_mass & ~F.col("is_flapping")).alias("is_independent"),
        "is_flapping", "flap_count",
        symptom.alias("suppress_notification"),
        F.when(by_link, "link").when(in_mass, "mass").alias("inc_kind"),
        F.when(by_link, F.concat_ws(":", *SLOT)).when(in_mass, F.col("source_ip")).alias("inc_key"),
        F.when(by_link, F.col("bh_inc")).when(in_mass, F.col("mass_inc")).alias("inc"),
        "bh_inc", F.concat_ws(":", *SLOT).alias("bh_key"), "slot_ip",
        F.coalesce("opens_link", no).alias("opens_link"), "opens_mass", "mass_inc", "is_bh_root",
        "is_recovery",
    )


def _touches_link() -> Column:
    """A link incident's own events: symptoms, and roots (a root is never also a symptom)."""
    return F.col("is_bh_symptom") | F.col("is_bh_root")


def incident_openings(corr: DataFrame) -> DataFrame:
    """One row per opened incident: ``kind, key, device_ip, us, seq`` (its opening), the position of
    its last event, ``touches``, ``has_root`` and ``open_order``.

    ``open_order`` is the order in which one event opens several: looking for a root cause first,
    then the mass incident, then its own link failure.
    """
    opened = F.col("seq") == F.col("inc.seq")
    link = corr.where("bh_inc IS NOT NULL").select(
        F.lit("link").alias("kind"), F.col("bh_key").alias("key"), F.col("slot_ip").alias("device_ip"),
        F.col("bh_inc").alias("inc"), "us", "seq", "is_bh_root", "is_root_cause", "inc_kind")
    mass = corr.where("mass_inc IS NOT NULL").select(
        F.lit("mass").alias("kind"), F.col("source_ip").alias("key"), F.col("source_ip").alias("device_ip"),
        F.col("mass_inc").alias("inc"), "us", "seq", "is_bh_root", "is_root_cause", "inc_kind")
    own = opened & F.col("is_root_cause") & (F.col("inc_kind") == F.col("kind"))
    order = F.when(F.col("kind") == "mass", 1).when(opened & F.col("is_bh_root"), 2).otherwise(0)
    return (
        link.unionByName(mass).groupBy("kind", "key", "device_ip", "inc")
        .agg(F.max(F.struct("us", "seq")).alias("z"), F.count("*").alias("touches"),
             F.max(own).alias("has_root"), F.max(order).alias("open_order"))
        .select("kind", "key", "device_ip", F.col("inc.us").alias("us"), F.col("inc.seq").alias("seq"),
                F.col("z.us").alias("last_us"), F.col("z.seq").alias("last_seq"), "touches", "has_root",
                "open_order")
    )


def incident_ids(opens: DataFrame, stored: DataFrame | None = None,
                 offset_hours: int = fixed.LOCAL_OFFSET_HOURS, width: int = CHUNK_US) -> DataFrame:
    """Adds ``incident_id`` = ``INC-YYYYMMDD-NNN`` numbered per UTC date in opening order.

    ``opens`` has us, seq, kind; ``stored(incident_id)`` gives the highest number already used per
    date. Numbering is local to a chunk of the day plus the counts of earlier chunks, so a busy day
    is not numbered in one task.
    """
    utc = F.col("us") - F.lit(offset_hours * 3600 * SECOND)
    rows = opens.withColumns({
        "_utc": utc,
        "_day": _utc_day(utc),
        "_chunk": timeline.chunk(utc, width),
    })
    local = F.row_number().over(Window.partitionBy("_day", "_chunk").orderBy("us", "seq", "open_order"))
    counts = rows.groupBy("_day", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_day").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("_day", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_local", local).join(carry, ["_day", "_chunk"])
    number = F.col("_local") + F.col("_base")
    if stored is not None:
        used = max_stored_ids(stored)
        numbered = numbered.join(used, "_day", "left")
        number = number + F.coalesce("_used", F.lit(0))
    digits = number.cast("string")
    return numbered.withColumn(
        "incident_id",
        F.concat(F.lit("INC-"), "_day", F.lit("-"),
                 F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)),
    ).select(*opens.columns, "incident_id")


def max_stored_ids(stored: DataFrame) -> DataFrame:
    """Highest number in use per date among stored ``incident_id`` values."""
    ids = stored.where(F.col("incident_id").rlike(r"^INC-\d{8}-\d+$"))
    return ids.groupBy(F.substring("incident_id", 5, 8).alias("_day")).agg(
        F.max(F.substring("incident_id", 14, 18).try_cast("bigint")).alias("_used")
    )


def _utc_day(utc: Column) -> Column:
    days = F.call_function("div", utc - F.pmod(utc, F.lit(86_400 * SECOND)), F.lit(86_400 * SECOND))
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyyMMdd")


def resolve_on_recovery(opens: DataFrame, recoveries: DataFrame, width: int = CHUNK_US) -> DataFrame:
    """C11: adds ``resolved_us, resolved_by`` (NULL while open): the first recovery on the incident's
    device at or after its last event, if it comes within 24 h (C9: later it is no longer live)."""
    inc = opens.select("device_ip", "kind", "key", F.col("seq").alias("open_seq"), F.col("us").alias("open_us"),
                       F.col("last_us").alias("us"), F.lit(0).alias("phase"), F.col("last_seq").alias("seq"))
    rec = recoveries.select(
        F.col("source_ip").alias("device_ip"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("open_seq"),
        F.lit(None).cast("bigint").alias("open_us"), "us", F.lit(1).alias("phase"), "seq")
    rows = inc.unionByName(rec).withColumn("chunk", timeline.chunk("us", width))
    nxt = timeline.running_max(
        rows, ["device_ip"], {"_next": F.when(F.col("phase") == 1, F.struct("us", "seq"))},
        ["us", "seq", "phase"], inclusive=False, reverse=True,
    ).where("phase = 0")
    hit = F.col("_next.us") - F.col("us") <= TTL_US
    found = nxt.select(
        "kind", "key", F.col("open_us").alias("us"), F.col("open_seq").alias("seq"),
        F.when(hit, F.col("_next.us")).alias("resolved_us"), F.when(hit, F.col("_next.seq")).alias("resolved_by"))
    return opens.join(found, ["kind", "key", "us", "seq"], "left")


def expire_incidents(opens: DataFrame, now_us: Column, ttl_us: int = TTL_US) -> DataFrame:
    """Adds ``fate``: ``resolved``, ``expired`` (newest event more than 24 h before ``now_us``)
    or ``live``. Needs ``resolved_us``."""
    return opens.withColumn("fate", F.when(F.col("resolved_us").isNotNull(), "resolved").when(
        now_us - F.col("last_us") > ttl_us, "expired").otherwise("live"))


def number_incidents(corr: DataFrame, recoveries: DataFrame, stored: DataFrame | None = None,
                     width: int = CHUNK_US) -> tuple[DataFrame, DataFrame]:
    """C8, C11 together: (events with ``incident_id``, openings with id and resolution)."""
    opens = materialize(
        resolve_on_recovery(incident_ids(incident_openings(corr), stored, width=width), recoveries, width),
        "incident-openings")
    ids = opens.select(F.col("kind").alias("inc_kind"), F.col("key").alias("inc_key"),
                       F.col("us").alias("_ous"), F.col("seq").alias("_oseq"), "incident_id")
    events = corr.withColumns({"_ous": F.col("inc.us"), "_oseq": F.col("inc.seq")}).join(
        ids, ["inc_kind", "inc_key", "_ous", "_oseq"], "left").drop("_ous", "_oseq")
    return events, opens
