"""D1-D5 on streams: duplicate suppression with keyed state.

The same rules as :mod:`alertloom.operators.dedup`, row by row per key. State per key is one time
and the flap history of the last two minutes, so it grows with the number of keys, not of rows.
Rows of one micro-batch are taken in (us, seq) order; a row older than its key's last kept row is a
duplicate, as on arrival. Needs the RocksDB state store provider (see :data:`STATE_STORE`).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..operators.dedup import _narrow

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
OUT = "seq bigint, us bigint, reason string"
PASS = ("seq bigint, us bigint, device_name string, mnemonic string, bundle_parent string, bgp_neighbor string, "
        "disc string, direction string, grouped boolean")
_US = 1_000_000


class BundleGrouping(StatefulProcessor):
    """D1 per (device, bundle): marks rows that follow the last kept one within the window."""

    def __init__(self, window_us: int, ttl_ms: int | None):
        self.window_us, self.ttl_ms = window_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "us bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"])
        grouped = []
        for us in pdf["us"]:
            hit = anchor is not None and us - anchor <= self.window_us
            grouped.append(hit)
            anchor = anchor if hit else int(us)
        self.anchor.update((anchor,))
        yield pdf.assign(grouped=grouped)

    def close(self) -> None:
        pass


class Suppression(StatefulProcessor):
    """D2 and D3 per (device, mnemonic, neighbor or interface)."""

    def __init__(self, window_us: int, flap_us: int, ttl_ms: int | None):
        self.window_us, self.flap_us, self.ttl_ms = window_us, flap_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "us bigint", self.ttl_ms)
        self.history = handle.getListState("history", "state string, us bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        history = [(s, u) for s, u in self.history.get()] if self.history.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["us", "seq"])
        reasons = []
        for us, direction, peer, mnemonic in zip(
                pdf["us"].tolist(), pdf["direction"].tolist(), pdf["bgp_neighbor"].tolist(), pdf["mnemonic"].tolist()):
            if direction and peer and mnemonic == "ADJCHANGE":
                history = [h for h in history if h[1] >= us - self.flap_us]
                states = [h[0] for h in history]
                history.append((direction, us))
                if direction == "down" and states[-2:] == ["down", "up"]:
                    reasons.append("flapping")
                    continue
                if not states or states[-1] != direction:
                    anchor = us
                    reasons.append("new")
                    continue
            if anchor is not None and us - anchor <= self.window_us:
                reasons.append("suppressed_duplicate")
            else:
                anchor = us
                reasons.append("new")
        if anchor is not None:
            self.anchor.update((anchor,))
        if history:
            self.history.put(history)
        yield pd.DataFrame({"seq": pdf["seq"], "us": pdf["us"], "reason": reasons})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values(["us", "seq"])
        self.history.put(list(zip(rows["state"].tolist(), rows["us"].tolist())))

    def close(self) -> None:
        pass


def should_notify_stream(events: DataFrame, window_s: int = fixed.DEDUP_WINDOW, flap_s: int = fixed.FLAP_WINDOW,
                         bundle_s: int = fixed.BUNDLE_WINDOW, ttl_ms: int | None = None,
                         flap_state: DataFrame | None = None) -> DataFrame:
    """D4 on a stream: ``seq, us, should_send, reason``.

    ``flap_state`` (D5: device_name, bgp_neighbor, state, us, seq) starts the peers' histories where an
    earlier run stopped. ``ttl_ms`` drops keys that were silent for that long on the wall clock; it
    needs a continuous trigger, since a query with wall-clock expiry never runs out of batches.
    """
    rows = _narrow(events)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    grouped = rows.where("bundle_parent <> ''").groupBy("device_name", "bundle_parent").transformWithStateInPandas(
        BundleGrouping(bundle_s * _US, ttl_ms), PASS, "Append", mode)
    free = rows.where("bundle_parent = ''").withColumn("grouped", F.lit(False))
    both = grouped.unionByName(free.select(*grouped.columns))
    initial = None
    if flap_state is not None:
        initial = flap_state.select(
            "device_name", F.lit("ADJCHANGE").alias("mnemonic"), F.col("bgp_neighbor").alias("disc"),
            "state", "us", "seq").groupBy("device_name", "mnemonic", "disc")
    decided = both.where("NOT grouped").groupBy("device_name", "mnemonic", "disc").transformWithStateInPandas(
        Suppression(window_s * _US, flap_s * _US, ttl_ms), OUT, "Append", mode, initial)
    held = both.where("grouped").select("seq", "us", F.lit("bundle_grouped").alias("reason"))
    return decided.unionByName(held).withColumn("should_send", F.col("reason").isin("new", "flapping"))
