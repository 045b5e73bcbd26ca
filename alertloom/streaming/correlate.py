"""C1-C7, C9 and C11 on streams: correlation of each event once the watermark has passed it.

The rules are those of :mod:`alertloom.operators.correlate`; what a batch reads from windows is kept
as state by key, in event time:

* subjects: the times of the last 300 s (:class:`FlapCount`); failure slots: the last failure or clear
  and the episode it began (:class:`LinkState`). Both are one operator, :class:`Marks`, and forgotten by
  a timer after 300 and 60 s. What they tell about an event goes on to its device;
* devices: the labels that several links gave one event become one, mass events are counted and
  joined to the device's mass incident (:class:`DeviceState`);
* link incidents: touches and recoveries of a link (:class:`LinkIncidents`).

Incidents end by a recovery, or by a timer 24 h after their last event. Every operator holds rows back
until the watermark has passed them and then takes them in (us, seq) order, so the result of a replay
does not depend on how lines were cut into micro-batches or in which order they came, as long as none
came behind the watermark (see :mod:`alertloom.streaming.late` for those).

State is a few numbers per key and the rows inside the watermark. Needs the RocksDB state store
provider (:data:`alertloom.streaming.dedup.STATE_STORE`).
"""

from __future__ import annotations

import datetime as dt
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.text import blank_to_null
from ..operators.correlate import _alertable, _is_mass_type, _probe_map, fault_kind
from .dedup import STATE_STORE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_US = 1_000_000
TTL_US = fixed.INCIDENT_TTL * _US
#: The year 3000, later than any event.
_CLOSE_US = 32_503_680_000 * _US


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark passes them, then hands them to :meth:`take` in order.

    ``rows`` is the DDL of the input, with us and seq; ``order`` the columns that rows are taken by. What
    goes out has the moment after the watermark as its ``event_time``, as nothing may go out behind it; an
    operator behind this one gets all of it in the same micro-batch. A subclass keeps its state as one JSON value; :meth:`rest` ends what the watermark has outlived and
    says until when the state matters.
    """

    def __init__(self, rows: str, order: tuple[str, ...] = ("us", "seq")):
        self.rows, self.columns = rows, _names(rows)
        self.order = [self.columns.index(c) for c in order]
        self.at = self.columns.index("us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", "json string")
        self.due = handle.getValueState("due", "ms bigint")

    def start(self) -> dict:
        raise NotImplementedError

    def take(self, key, state: dict, row: dict) -> Iterator[Row]:
        raise NotImplementedError

    def rest(self, key, state: dict, passed: int) -> tuple[list[Row], int | None]:
        """(rows of what ended, the moment up to which the state matters or None if it does not)."""
        raise NotImplementedError

    def _release(self, key, timers, new: list[tuple]) -> Iterator[Row]:
        # A timer goes off once the watermark is later than its millisecond, so rows of that one still wait.
        passed = timers.getCurrentWatermarkInMs() * 1000 - 1
        self.now = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=passed // 1000 + 2)
        held = (list(map(tuple, self.waiting.get())) if self.waiting.exists() else []) + new
        ready = sorted((r for r in held if r[self.at] <= passed), key=lambda r: [r[i] for i in self.order])
        later = [r for r in held if r[self.at] > passed]
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        for row in ready:
            yield from self.take(key, state, dict(zip(self.columns, row)))
        ended, needed = self.rest(key, state, passed)
        yield from ended
        if ready or ended:
            self.state.update((json.dumps(state),)) if needed is not None else self.state.clear()
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        elif new:
            self.waiting.appendList(new)
        moments = [r[self.at] for r in later] + ([needed] if needed is not None else [])
        self._wake(min(moments) // 1000 if moments else None)
        if needed is None and self.state.exists():
            self.state.clear()

    def _wake(self, ms: int | None) -> None:
        """One timer a key: for its earliest waiting row or the end of its state."""
        old = self.due.get()[0] if self.due.exists() else None
        if old == ms:
            return
        if old is not None and old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._release(key, timerValues, [tuple(r[c] for c in self.columns) for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        yield from self._release(key, timerValues, [])

    def close(self) -> None:
        pass


MARKS = ("us bigint, seq bigint, event_time timestamp, source_ip string, is_recovery boolean, mass_type boolean, "
         "alertable boolean, part int, kind string")
DEVICE_IN = ("us bigint, seq bigint, event_time timestamp, source_ip string, is_recovery boolean, mass_type boolean, "
             "alertable boolean, part int, flap_count bigint, live boolean, opens boolean, episode_us bigint, episode_seq bigint, "
             "slot_ip string, slot_bundle string")
LABELS = ("what string, us bigint, seq bigint, event_time timestamp, source_ip string, is_recovery boolean, flap_count bigint, "
          "is_bh_symptom boolean, is_bh_root boolean, slot_ip string, slot_bundle string, is_mass boolean, mass_us bigint, "
          "mass_seq bigint, opens_mass boolean, resolved_us bigint, resolved_by bigint")
#: 0 touches its link's incidents, 1 is a recovery on the link's device, 2 has nothing to do with a link.
TOUCH_IN = LABELS + ", phase int"
OUT = LABELS + ", bh_us bigint, bh_seq bigint, opens_link boolean"


def _row(ddl: str, **values) -> Row:
    return Row(**{c: values.get(c) for c in _names(ddl)})


class FlapCount:
    """C1 per (source_ip, subject): events of the last ``window_us``, the row itself included."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def start(self):
        return {"recent": []}

    def take(self, key, state, row):
        state["recent"] = [u for u in state["recent"] if u >= row["us"] - self.window_us] + [row["us"]]
        return {"flap_count": len(state["recent"])}

    def until(self, state):
        return state["recent"][-1] + self.window_us + 1 if state["recent"] else None


class LinkState:
    """C3 per failure slot: whether a failure is live before each row that can see it."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def start(self):
        return {"last": None, "episode": [None, None]}

    def take(self, key, state, row):
        last, episode = state["last"], state["episode"]
        live = last is not None and last[1] == "F" and row["us"] - last[0] <= self.window_us
        opens = row["kind"] == "F" and not live
        if opens:
            state["episode"] = [row["us"], row["seq"]]
        if row["kind"] is not None:
            state["last"] = [row["us"], row["kind"]]
        return {"live": live, "opens": opens, "episode_us": episode[0], "episode_seq": episode[1], "slot_ip": key[1], "slot_bundle": key[2]}

    def until(self, state):
        return state["last"][0] + self.window_us + 1 if state["last"] else None


class Marks(InOrder):
    """The first level, per (part, one, two): subjects of events (part 0) and slots that they see (part 1).

    One operator for both, so that the stream is read once and each event goes on as the rows of one operator.
    """

    def __init__(self, flap_us: int, window_us: int):
        super().__init__(MARKS)
        self.kinds = [FlapCount(flap_us), LinkState(window_us)]

    def start(self):
        return {}

    def take(self, key, state, row):
        kind = self.kinds[key[0]]
        if not state:
            state.update(kind.start())
        told = kind.take(key, state, row)
        yield _row(DEVICE_IN, **{**row, "event_time": self.now}, **told)

    def rest(self, key, state, passed):
        until = self.kinds[key[0]].until(state) if state else None
        return [], until if until is not None and until > passed else None


class DeviceState(InOrder):
    """C2, C4 and C6 per device, over its events (part 0) and what its links say of them (part 1)."""

    def __init__(self, window_us: int, threshold: int, ttl_us: int):
        super().__init__(DEVICE_IN, ("us", "seq", "part"))
        self.window_us, self.threshold, self.ttl_us = window_us, threshold, ttl_us

    def start(self):
        return {"recent": [], "open": None, "last": None, "event": None, "links": []}

    def _label(self, key, state) -> Iterator[Row]:
        """The event whose rows are all there."""
        e, links = state["event"], state["links"]
        state["event"], state["links"] = None, []
        if e is None:
            return
        us = e["us"]
        seen = min((x[2:6] for x in links if x[0]), default=None)
        own = max((x[4:6] for x in links if x[1]), default=None)
        root, symptom = seen is None and own is not None, seen is not None
        slot = seen[2:] if symptom else own or [None, None]
        state["recent"] = [u for u in state["recent"] if u >= us - self.window_us]
        mass = e["mass_type"] and len(state["recent"]) >= self.threshold - 1
        if e["mass_type"] and e["alertable"]:
            state["recent"].append(us)
        joins = mass or not (symptom or root)
        opens, inc = False, None
        if joins:
            if state["open"] and us - state["last"] > self.ttl_us:
                yield self._ended(key, state, "expired", state["last"] + self.ttl_us + 1)
            opens = mass and state["open"] is None
            if opens:
                state["open"] = [us, e["seq"]]
            inc = state["open"]
            if inc:
                state["last"] = us
        yield _row(LABELS, what="event", us=us, seq=e["seq"], event_time=self.now, source_ip=key[0], is_recovery=e["is_recovery"],
                   flap_count=e["flap_count"], is_bh_symptom=symptom, is_bh_root=root, slot_ip=slot[0], slot_bundle=slot[1], is_mass=mass,
                   mass_us=inc and inc[0], mass_seq=inc and inc[1], opens_mass=opens)
        if e["is_recovery"] and state["open"]:
            within = us - state["last"] <= self.ttl_us
            yield self._ended(key, state, "resolved", us, e["seq"]) if within else self._ended(key, state, "expired", state["last"] + self.ttl_us + 1)

    def _ended(self, key, state, how, us, by=None) -> Row:
        opened, state["open"] = state["open"], None
        return _row(LABELS, what=how, us=us, seq=opened[1], event_time=self.now, source_ip=key[0], mass_us=opened[0], mass_seq=opened[1],
                    resolved_us=us if by is not None else None, resolved_by=by)

    def take(self, key, state, row):
        if row["part"] == 0:
            yield from self._label(key, state)
            state["event"] = {c: row[c] for c in ("us", "seq", "is_recovery", "flap_count", "mass_type", "alertable")}
        else:
            state["links"].append([row[c] for c in ("live", "opens", "episode_us", "episode_seq", "slot_ip", "slot_bundle")])

    def rest(self, key, state, passed):
        # All rows of an event pass the watermark together, so the last one is complete as well.
        out = list(self._label(key, state))
        if state["open"] and state["last"] + self.ttl_us < passed:
            out.append(self._ended(key, state, "expired", state["last"] + self.ttl_us + 1))
        state["recent"] = [u for u in state["recent"] if u >= passed - self.window_us]
        ends = [u + self.window_us + 1 for u in state["recent"][-1:]] + ([state["last"] + self.ttl_us + 1] if state["open"] else [])
        return out, max(ends) if ends else None


class LinkIncidents(InOrder):
    """C5 per link, over its touches (phase 0) and the recoveries of its device (phase 1); other rows pass."""

    def __init__(self, ttl_us: int):
        super().__init__(TOUCH_IN, ("us", "seq", "phase"))
        self.ttl_us = ttl_us

    def start(self):
        return {"live": []}  # [opened us, seq, last us], the newest last

    def _ended(self, key, inc, how, us, by=None) -> Row:
        return _row(OUT, what=how, us=us, seq=inc[1], event_time=self.now, source_ip=key[0], slot_ip=key[0], slot_bundle=key[1], bh_us=inc[0],
                    bh_seq=inc[1], resolved_us=us if by is not None else None, resolved_by=by)

    def _expire(self, key, state, now) -> Iterator[Row]:
        for inc in [i for i in state["live"] if now - i[2] > self.ttl_us]:
            state["live"].remove(inc)
            yield self._ended(key, inc, "expired", inc[2] + self.ttl_us + 1)

    def take(self, key, state, row):
        same = {c: v for c, v in row.items() if c != "phase"} | {"event_time": self.now}
        if row["phase"] == 2:
            yield _row(OUT, **same)
            return
        yield from self._expire(key, state, row["us"])
        if row["phase"] == 1:
            for inc in state["live"]:
                yield self._ended(key, inc, "resolved", row["us"], row["seq"])
            state["live"] = []
            return
        opens = row["is_bh_root"] or not state["live"]
        if opens:
            state["live"].append([row["us"], row["seq"], row["us"]])
        inc = state["live"][-1]
        inc[2] = row["us"]
        yield _row(OUT, **same, bh_us=inc[0], bh_seq=inc[1], opens_link=opens)

    def rest(self, key, state, passed):
        out = list(self._expire(key, state, passed))
        return out, min(i[2] for i in state["live"]) + self.ttl_us + 1 if state["live"] else None


def correlate_stream(events: DataFrame, topology: DataFrame, watermark: str = "10 minutes",
                     window_s: int = fixed.CORRELATION_WINDOW, threshold: int = fixed.MASS_THRESHOLD,
                     flap_s: int = fixed.FLAP_COUNT_WINDOW, ttl_us: int = TTL_US) -> DataFrame:
    """C7 on a stream of the columns of ``correlate.COLUMNS``; ``topology`` is a table.

    Rows with ``what = 'event'`` are what ``correlate.correlate`` gives for the event, once and for all. Rows with
    ``what = 'resolved'`` (C11) or ``'expired'`` (C9) tell the end of the incident ``inc_kind, inc_key, inc``; their ``us`` is the moment, ``seq`` that of the opening event.
    """
    def keyed(df: DataFrame, keys: list[str], processor: InOrder, out: str) -> DataFrame:
        return df.groupBy(*keys).transformWithState(processor, out, "Append", "EventTime", eventTimeColumnName="event_time")

    timed = events.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", watermark)
    rows = timed.select(
        "us", "seq", "event_time", "source_ip", F.coalesce("is_recovery", F.lit(False)).alias("is_recovery"),
        F.coalesce(_is_mass_type(), F.lit(False)).alias("mass_type"), F.coalesce(_alertable(), F.lit(False)).alias("alertable"),
        F.coalesce(blank_to_null(F.col("bgp_neighbor")), blank_to_null(F.col("interface_name")), F.col("mnemonic")).alias("subject"),
        "event_bundle", fault_kind().alias("fault"))
    # An event goes to its subject and to each slot that it can see: its own link's, and those of the far device that come back.
    far = _probe_map(topology).where("slot_ip <> source_ip OR slot_bundle <> event_bundle").groupBy("source_ip", "event_bundle").agg(
        F.collect_list(F.struct(F.lit(1).alias("part"), F.col("slot_ip").alias("one"), F.col("slot_bundle").alias("two"),
                                F.lit(None).cast("string").alias("kind"))).alias("far"))
    none = F.array().cast("array<struct<part:int,one:string,two:string,kind:string>>")
    subject = F.array(F.struct(F.lit(0).alias("part"), F.col("source_ip").alias("one"), F.col("subject").alias("two"), F.lit(None).cast("string").alias("kind")))
    own = F.when(F.col("event_bundle").isNotNull(), F.array(F.struct(
        F.lit(1).alias("part"), F.col("source_ip").alias("one"), F.col("event_bundle").alias("two"), F.col("fault").alias("kind")))).otherwise(none)
    marks = rows.join(far, ["source_ip", "event_bundle"], "left").select(
        "us", "seq", "event_time", "source_ip", "is_recovery", "mass_type", "alertable", F.inline(F.concat(subject, own, F.coalesce("far", none))))
    told = keyed(marks, ["part", "one", "two"], Marks(flap_s * _US, window_s * _US), DEVICE_IN)
    labels = keyed(told, ["source_ip"], DeviceState(window_s * _US, threshold, ttl_us), LABELS)

    # A label goes to the link it touches, and a recovery to all links of its device.
    touch = F.coalesce(F.col("is_bh_symptom") | F.col("is_bh_root"), F.lit(False))
    slots = topology.groupBy(F.col("ip").alias("source_ip")).agg(F.collect_set("bundle").alias("bundles"))
    one = F.struct(F.when(touch, F.col("slot_ip")).otherwise(F.col("source_ip")).alias("on_ip"),
                   F.when(touch, F.col("slot_bundle")).otherwise("").alias("on_bundle"), F.when(touch, 0).otherwise(2).alias("phase"))
    kills = F.transform("bundles", lambda b: F.struct(F.col("source_ip").alias("on_ip"), b.alias("on_bundle"), F.lit(1).alias("phase")))
    ends = F.when((F.col("what") == "event") & F.col("is_recovery") & F.col("bundles").isNotNull(), kills).otherwise(
        F.array().cast("array<struct<on_ip:string,on_bundle:string,phase:int>>"))
    dealt = labels.join(slots, "source_ip", "left").select(*_names(LABELS), F.inline(F.concat(F.array(one), ends)))
    return _shown(keyed(dealt, ["on_ip", "on_bundle"], LinkIncidents(ttl_us), OUT))


def _shown(df: DataFrame) -> DataFrame:
    """Labels as the batch form shows them; positions that are absent are NULL."""
    def position(us: str, seq: str):
        return F.when(F.col(us).isNotNull(), F.struct(F.col(us).alias("us"), F.col(seq).alias("seq")))

    by_mass = F.col("is_mass") & ~F.col("is_bh_root")
    by_link = ~by_mass & (F.col("is_bh_symptom") | F.col("is_bh_root"))
    in_mass = ~by_link & F.col("mass_us").isNotNull()
    event = F.col("what") == "event"
    link = F.when(event, by_link).otherwise(F.col("bh_us").isNotNull())
    mass = F.when(event, in_mass).otherwise(F.col("bh_us").isNull())
    flapping = F.col("flap_count") >= fixed.FLAP_THRESHOLD
    symptom = F.when(by_link, F.col("is_bh_symptom")).otherwise(in_mass & ~F.col("opens_mass"))
    return df.select(
        "what", "seq", "us", "source_ip", F.when(by_link, F.col("is_bh_root")).otherwise(F.col("opens_mass")).alias("is_root_cause"),
        symptom.alias("is_symptom"), (~by_link & ~in_mass & ~flapping).alias("is_independent"), flapping.alias("is_flapping"), "flap_count",
        symptom.alias("suppress_notification"), F.when(link, "link").when(mass, "mass").alias("inc_kind"),
        F.when(link, F.concat_ws(":", "slot_ip", "slot_bundle")).when(mass, F.col("source_ip")).alias("inc_key"),
        F.when(link, position("bh_us", "bh_seq")).when(mass, position("mass_us", "mass_seq")).alias("inc"),
        position("bh_us", "bh_seq").alias("bh_inc"), F.concat_ws(":", "slot_ip", "slot_bundle").alias("bh_key"), "slot_ip",
        F.coalesce("opens_link", F.lit(False)).alias("opens_link"), "opens_mass", position("mass_us", "mass_seq").alias("mass_inc"),
        "is_bh_root", "is_recovery", "resolved_us", "resolved_by")


def run_correlation(spark: SparkSession, src: str, schema, topology: DataFrame, out: str, checkpoint: str,
                    watermark: str = "10 minutes", close: bool = True, partitions: int | None = None) -> DataFrame:
    """Correlate the event files in ``src`` up to the end, one micro-batch a file, and read the result.

    ``close`` ends the history after the last event: a mark far in the future passes the watermark over everything
    that still waits. A stream that goes on leaves it out. ``partitions`` is how many parts the state has, for good.
    """
    if close:
        last = spark.createDataFrame([(_CLOSE_US, "close")], "us bigint, mnemonic string")
        blank = [F.col(f.name) if f.name in last.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        last.select(*blank).coalesce(1).write.mode("append").parquet(src)
    settings = STATE_STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = correlate_stream(stream, topology, watermark).writeStream.format("parquet").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(out).where(F.col("us") < _CLOSE_US)
