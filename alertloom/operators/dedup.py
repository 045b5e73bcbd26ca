"""Duplicate suppression, flap detection and bundle grouping in event time.

Input: ``seq, us, device_name, mnemonic, message, rule_id, interface_name, bundle_parent,
bgp_neighbor`` (``us`` is the event time in microseconds, ``seq`` breaks ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import blank_to_null
from ..session import materialize
from . import timeline
from .enrich import bgp_direction

COLUMNS = ["seq", "us", "device_name", "mnemonic", "message", "rule_id", "interface_name",
           "bundle_parent", "bgp_neighbor"]
REASONS = ["new", "suppressed_duplicate", "flapping", "bundle_grouped"]


def _narrow(df: DataFrame) -> DataFrame:
    """The columns suppression needs, with the message reduced to a direction."""
    return df.select(
        "seq", "us", "device_name", "mnemonic", "bundle_parent", "bgp_neighbor",
        F.coalesce(blank_to_null(F.col("bgp_neighbor")), F.col("interface_name"), F.lit("")).alias("disc"),
        bgp_direction(F.col("rule_id"), F.col("mnemonic"), F.col("message")).alias("direction"),
    )


def _is_peer_event() -> Column:
    return (F.col("bgp_neighbor") != "") & (F.col("mnemonic") == "ADJCHANGE")


def bundle_group(df: DataFrame, window_s: int = fixed.BUNDLE_WINDOW) -> DataFrame:
    """D1 over rows with a bundle parent: ``kept`` is false for grouped members."""
    rows = df.where(F.col("bundle_parent") != "")
    return timeline.throttle(rows, ["device_name", "bundle_parent"], window_s * timeline.SECOND)


def bgp_flap(df: DataFrame, window_s: int = fixed.FLAP_WINDOW) -> DataFrame:
    """D2 on rows with ``direction``: adds ``flap`` (``flapping`` / ``change`` / ``same`` / NULL).

    The history of a peer is its directed ADJCHANGE events of the last ``window_s`` seconds, each
    recorded whatever became of it, so the two previous rows decide: no unbounded state.
    """
    window_us = window_s * timeline.SECOND
    tracked = _is_peer_event() & F.col("direction").isNotNull()
    rows = timeline.with_halo(df.where(tracked), window_us)
    w = Window.partitionBy("device_name", "bgp_neighbor", "chunk").orderBy("us", "seq")

    def recent(n: int) -> Column:
        return F.when(F.col("us") - F.lag("us", n).over(w) <= window_us, F.lag("direction", n).over(w))

    flap = (
        F.when((F.col("direction") == "down") & (F.col("_p1") == "up") & (F.col("_p2") == "down"), "flapping")
        .when(F.col("_p1").isNull() | (F.col("_p1") != F.col("direction")), "change")
        .otherwise("same")
    )
    seen = (
        rows.withColumns({"_p1": recent(1), "_p2": recent(2)})
        .withColumn("flap", flap)
        .where(~F.col("halo"))
        .drop("_p1", "_p2", "chunk", "halo")
    )
    rest = df.where(~F.coalesce(tracked, F.lit(False))).withColumn("flap", F.lit(None).cast("string"))
    return seen.unionByName(rest)


def window_dedup(df: DataFrame, window_s: int = fixed.DEDUP_WINDOW) -> DataFrame:
    """D3 on rows with ``disc`` and ``flap``: flapping rows are sent and leave the anchor alone,
    direction changes restart the window, the rest waits ``window_s`` after the last kept row."""
    flapping = F.coalesce(F.col("flap") == "flapping", F.lit(False))
    chain = df.where(~flapping)
    kept = timeline.throttle(
        chain, ["device_name", "mnemonic", "disc"], window_s * timeline.SECOND, F.col("flap") == "change"
    )
    reason = F.when(F.col("kept"), "new").otherwise("suppressed_duplicate")
    return kept.withColumn("reason", reason).drop("kept").unionByName(
        df.where(flapping).withColumn("reason", F.lit("flapping"))
    )


def should_notify(df: DataFrame, window_s: int = fixed.DEDUP_WINDOW, flap_s: int = fixed.FLAP_WINDOW,
                  bundle_s: int = fixed.BUNDLE_WINDOW) -> DataFrame:
    """``seq, should_send, reason`` per row: D1, then D2 and D3 over what D1 lets through.

    Each step reads its input several times, so the narrow rows between steps are written once.
    """
    if window_s <= 0:
        raise ValueError(f"window_s must be positive, got {window_s}")
    rows = materialize(_narrow(df), "dedup-input")
    grouped = materialize(bundle_group(rows, bundle_s), "dedup-bundle")
    passed = rows.where(F.coalesce(F.col("bundle_parent"), F.lit("")) == "").unionByName(
        grouped.where("kept").drop("kept")
    )
    flapped = materialize(
        bgp_flap(passed, flap_s).select("seq", "us", "device_name", "mnemonic", "disc", "flap"), "dedup-flap"
    )
    decided = window_dedup(flapped, window_s).select("seq", "reason").unionByName(
        grouped.where(~F.col("kept")).select("seq", F.lit("bundle_grouped").alias("reason"))
    )
    return decided.select("seq", F.col("reason").isin("new", "flapping").alias("should_send"), "reason")


def flap_state(df: DataFrame, as_of_us: Column | int | None = None,
               window_s: int = fixed.FLAP_WINDOW) -> DataFrame:
    """D5 export: ``bgp_key, state, us, seq`` of the histories still inside the flap window.

    A history is pruned when its peer's next event arrives; the rows older than the window at the
    peer's last event can never matter again, so those are left out. Rows that D1 grouped must be
    filtered out by the caller, as they never reach the history.
    """
    rows = _narrow(df) if "direction" not in df.columns else df
    rows = rows.where(_is_peer_event() & F.col("direction").isNotNull())
    if as_of_us is not None:
        rows = rows.where(F.col("us") >= F.lit(as_of_us) - window_s * timeline.SECOND)
    last = rows.groupBy("device_name", "bgp_neighbor").agg(F.max("us").alias("_last"))
    return (
        rows.join(last, ["device_name", "bgp_neighbor"])
        .where(F.col("us") >= F.col("_last") - window_s * timeline.SECOND)
        .select(F.concat_ws(":", "device_name", "bgp_neighbor").alias("bgp_key"),
                F.col("direction").alias("state"), "us", "seq", "device_name", "bgp_neighbor")
    )


def export_flap_state(state: DataFrame) -> DataFrame:
    """D5 as stored text: ``bgp_key, history`` with history = JSON ``[[state, iso time], ...]``."""
    from ..functions.times import from_us

    ts = from_us(F.col("us"))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                   F.when(F.col("us") % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""))
    entry = F.struct("us", "seq", F.array("state", iso).alias("pair"))
    return state.groupBy("bgp_key").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["pair"])).alias("history")
    )


def import_flap_state(stored: DataFrame) -> DataFrame:
    """D5 import: one row per well-formed entry; malformed ones are skipped.

    Returns ``bgp_key, state, us, seq`` with negative ``seq`` so the entries sort before new events
    of the same instant.
    """
    from ..functions.times import to_us

    entries = F.from_json("history", "array<string>")
    pair = F.from_json("entry", "array<string>")
    rows = stored.select("bgp_key", F.posexplode(entries).alias("pos", "entry"))
    ts = F.regexp_replace(F.get("pair", F.lit(1)), r"([+-]\d\d:?\d\d|Z)$", "").try_cast("timestamp_ntz")
    return (
        rows.withColumn("pair", pair)
        .where(F.size("pair") == 2)
        .select("bgp_key", F.get("pair", F.lit(0)).alias("state"), to_us(ts).alias("us"),
                (F.col("pos") - 1_000_000).cast("bigint").alias("seq"))
        .where("us IS NOT NULL AND state IS NOT NULL")
    )


def resume(df: DataFrame, stored: DataFrame, flap_s: int = fixed.FLAP_WINDOW) -> DataFrame:
    """D2 over new rows as if the stored histories had just happened; returns ``seq, flap``."""
    key = F.concat_ws(":", "device_name", "bgp_neighbor")
    rows = _narrow(df) if "direction" not in df.columns else df
    old = import_flap_state(stored).select(
        F.col("bgp_key").alias("device_name"), F.lit("peer").alias("bgp_neighbor"), "us", "seq",
        F.lit("ADJCHANGE").alias("mnemonic"), F.col("state").alias("direction"), F.lit(True).alias("_old"),
    )
    new = rows.where(F.col("bgp_neighbor") != "").select(
        key.alias("device_name"), F.lit("peer").alias("bgp_neighbor"), "us", "seq", "mnemonic", "direction",
        F.lit(False).alias("_old"),
    )
    return bgp_flap(old.unionByName(new), flap_s).where(~F.col("_old")).select("seq", "flap")
