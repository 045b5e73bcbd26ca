"""Exact order-dependent operators over long per-key timelines.

A key (a router, a link, a peer) may hold a third of all rows, so nothing here puts one key in one
task. Every timeline is cut into fixed time chunks and work is shuffled by ``(key, chunk)``:

* look-back windows copy the rows at the end of a chunk into the next one (:func:`with_halo`);
* running values are scanned per chunk, and one row per chunk carries the value on
  (:func:`running_max`);
* the keep-first-then-wait rule needs its last kept row. Chunks that touch their neighbour are
  summarised as a step function of that row, the few summaries are composed per key, and every
  chunk then starts from its exact state (:func:`throttle`).

Positions are ``struct(us, seq)``: event time in microseconds, then the tie-breaking sequence id.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

# Executors need not have this package installed: its task functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
CHUNK_US = 3600 * SECOND


def chunk(us: Column | str, width: int = CHUNK_US) -> Column:
    """Number of the time chunk a moment falls in."""
    us = F.col(us) if isinstance(us, str) else us
    width = F.lit(width).cast("bigint")
    return F.call_function("div", us - F.pmod(us, width), width)


def with_halo(df: DataFrame, lookback_us: int, us: str = "us", width: int = CHUNK_US) -> DataFrame:
    """Adds ``chunk`` and ``halo``: each row in its own chunk and in those that look back on it."""
    home = chunk(us, width)
    last = chunk(F.col(us) + F.lit(lookback_us), width)
    return (
        df.withColumn("chunk", F.explode(F.sequence(home, last)))
        .withColumn("halo", F.col("chunk") != home)
    )


def count_recent(df: DataFrame, keys: list[str], window_us: int, out: str, counted: Column | None = None,
                 us: str = "us", seq: str = "seq", width: int = CHUNK_US) -> DataFrame:
    """Adds how many counted rows of the same key lie at most ``window_us`` before each row.

    The row itself counts when it is ``counted``; rows of the same instant count up to ``seq``.
    Each counted row enters as +1 and leaves as -1, so one running sum gives the window count in
    linear time however dense a key is. ``seq`` must be unique.
    """
    weight = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    leave = F.col(us) + F.lit(window_us + 1)
    home, end = chunk(us, width), chunk(leave, width)
    arrive = F.transform(
        F.sequence(home, F.when(F.col("_w") == 1, end).otherwise(home)),
        lambda c: F.struct(c.alias("chunk"), F.col(us).alias("at"), F.lit(1).alias("phase"),
                           F.col("_w").alias("delta"), (c != home).alias("halo")),
    )
    gone = F.when(F.col("_w") == 1, F.array(
        F.struct(end.alias("chunk"), leave.alias("at"), F.lit(0).alias("phase"), F.lit(-1).alias("delta"),
                 F.lit(True).alias("halo"))
    )).otherwise(F.array().cast("array<struct<chunk:bigint,at:bigint,phase:int,delta:int,halo:boolean>>"))
    marks = (
        df.withColumn("_w", weight)
        .withColumn("_m", F.explode(F.concat(arrive, gone)))
        .drop("_w")
    )
    w = (
        Window.partitionBy(*keys, "_m.chunk").orderBy("_m.at", "_m.phase", seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return marks.withColumn(out, F.sum("_m.delta").over(w)).where(~F.col("_m.halo")).drop("_m")


def running_max(df: DataFrame, keys: list[str], values: dict[str, Column], order: list, inclusive: bool,
                chunk_col: str = "chunk", reverse: bool = False) -> DataFrame:
    """Adds, per value, its maximum over all earlier rows of the key (minimum of later ones if ``reverse``).

    ``df`` carries its chunk; NULL values are skipped. Positions grow along the order, so the
    maximum of a position that only some rows have is the latest such row.
    """
    agg, pick = (F.min, F.least) if reverse else (F.max, F.greatest)
    order = [F.desc(o) for o in order] if reverse else order
    chunk_order = F.desc(chunk_col) if reverse else chunk_col
    tmp = {f"_v_{n}": v for n, v in values.items()}
    df = df.withColumns(tmp)
    totals = df.groupBy(*keys, chunk_col).agg(*[agg(c).alias(c) for c in tmp])
    before = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, chunk_col, *[agg(c).over(before).alias(f"{c}_in") for c in tmp])
    inner = (
        Window.partitionBy(*keys, chunk_col).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    scanned = df.withColumns({f"{c}_here": agg(c).over(inner) for c in tmp})
    return (
        scanned.join(carry, [*keys, chunk_col], "left")
        .withColumns({n: pick(F.col(f"_v_{n}_here"), F.col(f"_v_{n}_in")) for n in values})
        .drop(*tmp, *[f"{c}_here" for c in tmp], *[f"{c}_in" for c in tmp])
    )


# ---------------------------------------------------------------------------------------------
# Keep-first-then-wait
# ---------------------------------------------------------------------------------------------
_ANY = 1 << 62


def _emit(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Groups:
    """The (key, chunk) groups of a sorted batch: where each begins, and times as one ascending array.

    ``at`` is group * (width + 1) + time since the chunk's start, so one search finds a place in any
    group; a time at or after the chunk's end is the end of the group.
    """

    def __init__(self, keys: pa.Array, chunks: np.ndarray, us: np.ndarray, width: int):
        code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(len(us), bool)
        new[1:] = (code[1:] != code[:-1]) | (chunks[1:] != chunks[:-1])
        self.first = np.flatnonzero(new)
        self.of, self.n, self.width = np.cumsum(new) - 1, len(us), width
        self.end = np.append(self.first[1:], self.n)
        self.base = chunks[self.first] * width
        self.at = self.of * (width + 1) + (us - chunks * width)

    def after(self, group: np.ndarray, us: np.ndarray) -> np.ndarray:
        """First row of each group later than a time; the group's end if there is none."""
        since = np.clip(us - self.base[group], -1, self.width)
        return np.searchsorted(self.at, group * (self.width + 1) + since, "right")


def _successors(groups: _Groups, us: np.ndarray, reset: np.ndarray, window_us: int) -> np.ndarray:
    """The row that is kept next after each row if that one is kept; n where its group has none."""
    n = len(us)
    resets = np.append(np.where(reset, np.arange(n), n), n)
    following = np.minimum.accumulate(resets[::-1])[::-1][1:]  # the next reset after each row
    after = np.minimum(groups.after(groups.of, us + window_us), following)
    return np.append(np.where(after < groups.end[groups.of], after, n), n)


def _reached(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All rows on the chains from ``starts``: doubled jumps, the longest taken first."""
    n = len(following) - 1
    jumps = [following]
    while (jumps[-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    rows = starts[starts < n]
    for jump in reversed(jumps):
        more = jump[rows]
        rows = np.concatenate([rows, more[more < n]])
    mask = np.zeros(n, bool)
    mask[rows] = True
    return mask


def _last_of(following: np.ndarray) -> np.ndarray:
    """The last row of the chain from each row."""
    n = len(following) - 1
    own = np.arange(n + 1)
    last = np.where(following < n, following, own)
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _keeper(window_us: int, us_col: str, width: int):
    """mapInArrow: rows sorted by (_k, _chunk, us, seq) gain ``kept``; seed rows are consumed.

    The state across batches is the last kept time of the current chunk.
    """

    def run(batches):
        carried = None  # (key, chunk, last kept time or None) at the end of the batch before
        for b in batches:
            seeds = b.filter(b.column("_seed"))
            rows = b.filter(pc.invert(b.column("_seed")))
            anchors = {(k, c): t for k, c, t in zip(*(seeds.column(x).to_pylist() for x in ("_k", "_chunk", us_col)))}
            if carried is not None and carried[2] is not None:
                anchors.setdefault(carried[:2], carried[2])
            # The last row may be a seed, whose rows are all in the next batch.
            ahead = tuple(b.column(x)[-1].as_py() for x in ("_k", "_chunk", us_col)) if b.num_rows and b.column("_seed")[-1].as_py() else None
            if not rows.num_rows:
                carried = ahead or carried
                continue
            us, chunks = (rows.column(x).to_numpy(zero_copy_only=False) for x in (us_col, "_chunk"))
            reset = rows.column("_reset").to_numpy(zero_copy_only=False)
            groups = _Groups(rows.column("_k"), chunks, us, width)
            # A chunk starts at its first row, or, after an anchor, at the first row past the wait or with a reset.
            names = list(zip(rows.column("_k").take(pa.array(groups.first)).to_pylist(), chunks[groups.first].tolist()))
            start = groups.first.copy()
            held = [(g, anchors[x]) for g, x in enumerate(names) if x in anchors]
            if held:
                g, anchor = (np.array(x, np.int64) for x in zip(*held))
                resets = np.append(np.flatnonzero(reset), len(us))
                at = np.minimum(groups.after(g, anchor + window_us), resets[np.searchsorted(resets, groups.first[g])])
                start[g] = np.where(at < groups.end[g], at, len(us))
            keep = _reached(_successors(groups, us, reset, window_us), start)
            mine = np.flatnonzero(keep[groups.first[-1]:])
            last = int(us[groups.first[-1] + mine[-1]]) if len(mine) else anchors.get(names[-1])
            carried = ahead or (*names[-1], last)
            yield rows.append_column("kept", pa.array(keep)).drop_columns(["_k", "_chunk", "_reset", "_seed"])

    return run


def _summariser(window_us: int, width: int, us_col: str, schema: pa.Schema):
    """mapInArrow: rows sorted by (_k, _chunk, us) -> one step function per chunk.

    A row ``(bound, exit)`` reads: if the first row that may be kept lies at or before ``bound``
    and after the next smaller bound, the last kept time of the chunk is ``exit``. Only rows in the
    first window of a chunk can be such a first row. The state is a pair for each of their distinct
    times; from a reset on there is one.
    """

    def run(batches):
        open_ = None  # key, chunk, linked, next chunk, bounds, exits of the chunk at the end of the batch before

        def told(group):
            key, chunk_, linked, following, bounds, exits = group
            # Neighbours with one exit are one step, up to the largest bound.
            ends = np.append(exits[1:] != exits[:-1], True)
            many = int(ends.sum())
            return _emit([[key] * many, [chunk_] * many, [linked] * many, [following] * many, bounds[ends], exits[ends]], schema)

        for b in batches:
            if not b.num_rows:
                continue
            us, chunks = (b.column(x).to_numpy(zero_copy_only=False) for x in (us_col, "_chunk"))
            reset = b.column("_reset").to_numpy(zero_copy_only=False)
            groups = _Groups(b.column("_k"), chunks, us, width)
            last = _last_of(_successors(groups, us, reset, window_us))
            at = pa.array(groups.first)
            names = list(zip(*(b.column(x).take(at).to_pylist() for x in ("_k", "_chunk", "_linked_in", "_next_chunk"))))
            resets = np.flatnonzero(reset)
            distinct = np.ones(len(us), bool)
            distinct[1:] = (us[1:] != us[:-1]) | (groups.of[1:] != groups.of[:-1])
            early = us - chunks * width < window_us
            # The first time at or after the first window is an entry too: rows whose predecessor time is early.
            before = np.zeros(len(us), bool)
            before[1:] = early[:-1] & (groups.of[1:] == groups.of[:-1])
            entries = distinct & (early | before)
            for g, name in enumerate(names):
                a, z = int(groups.first[g]), int(groups.end[g])
                bounds, exits = np.zeros(0, np.int64), np.zeros(0, np.int64)
                fresh = True
                if open_ is not None:
                    if open_[:2] == name[:2]:
                        bounds, exits = open_[4:]
                        fresh = False
                    else:
                        yield told(open_)
                    open_ = None
                r = resets[np.searchsorted(resets, a):np.searchsorted(resets, z)]
                if len(r) or (len(bounds) and bounds[-1] == _ANY):
                    if len(r):
                        bounds, exits = np.array([_ANY]), us[last[r[-1:]]]
                    else:
                        nxt = int(groups.after(np.array([g]), exits + window_us)[0])
                        exits = us[last[[nxt]]] if nxt < z else exits
                else:
                    if len(bounds):
                        nxt = groups.after(np.full(len(exits), g), exits + window_us)
                        exits = np.where(nxt < z, us[last[np.minimum(nxt, len(us) - 1)]], exits)
                    own = a + np.flatnonzero(entries[a:z])
                    if fresh:
                        if not len(own) or own[0] != a:
                            own = np.append(a, own)
                    else:
                        # The batch before may have had the last entry, or this time already.
                        done = bounds[-1] >= name[1] * width + window_us
                        own = own[:0] if done else own[us[own] > bounds[-1]]
                        if not done and not len(own):
                            later = int(groups.after(np.array([g]), bounds[-1:])[0])
                            own = np.array([later]) if later < z else own
                    bounds, exits = np.append(bounds, us[own]), np.append(exits, us[last[own]])
                open_ = (*name, bounds, exits)
        if open_ is not None:
            yield told(open_)

    return run


def _composer(window_us: int, schema: pa.Schema):
    """mapInArrow: step functions sorted by (_k, _chunk, bound) -> the state each next chunk starts from."""

    def run(batches):
        group, key, anchor, exit_, found, nxt = None, None, None, None, False, None
        out: list[tuple] = []
        for b in batches:
            for k, c, linked, nxt_, bound, ex in zip(*[col.to_pylist() for col in b.columns]):
                if (k, c) != group:
                    if group is not None:
                        out.append((key, nxt, exit_))
                    anchor = exit_ if (linked and k == key) else None
                    group, key, nxt, exit_, found = (k, c), k, nxt_, anchor, False
                if not found and (anchor is None or bound > anchor + window_us):
                    exit_, found = ex, True
            if len(out) > 10_000:
                yield _emit(list(zip(*out)), schema)
                out.clear()
        if group is not None:
            out.append((key, nxt, exit_))
        if out:
            yield _emit(list(zip(*out)), schema)

    return run


def _together(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with equal ``cols`` in one partition, by an exchange of its own.

    ``repartition(*cols)`` would be dropped after a join on the same columns, and the join may then
    be turned into a broadcast join that reads its shuffle locally. Task functions state no
    distribution, so nothing would restore it. No operator promises a hash of the columns, so this
    exchange always stays.
    """
    return df.repartition(F.xxhash64(*cols))


def throttle(df: DataFrame, keys: list[str], window_us: int, reset: Column | None = None,
             us: str = "us", seq: str = "seq", width: int = CHUNK_US) -> DataFrame:
    """Adds ``kept``: a row is kept iff it comes more than ``window_us`` after the last kept one.

    Rows with ``reset`` are always kept. Rows of a key are taken in (us, seq) order. ``df`` is read
    three times, so hand in a table or a cheap projection of one.

    A kept row depends on the one before it, without limit. Still no key is handled by one task:
    chunks whose first row follows the previous chunk's last row within the window are summarised
    as step functions, one streaming pass per key composes those summaries (a few per chunk), and
    all chunks are then decided in parallel from their exact starting state.
    """
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys])
    rows = df.select(
        "*", key.alias("_k"), chunk(us, width).alias("_chunk"),
        (F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))).alias("_reset"),
    )
    by_key = Window.partitionBy("_k").orderBy("_chunk")
    spans = rows.groupBy("_k", "_chunk").agg(F.min(us).alias("a"), F.max(us).alias("z"))
    links = spans.select(
        "_k", "_chunk",
        F.coalesce(F.col("a") - F.lag("z").over(by_key) <= window_us, F.lit(False)).alias("_linked_in"),
        F.lead("_chunk").over(by_key).alias("_next_chunk"),
        (F.lead("a").over(by_key) - F.col("z") <= window_us).alias("_out"),
    ).where("_out").drop("_out")

    tail_schema = pa.schema([("_k", pa.string()), ("_chunk", pa.int64()), ("_linked_in", pa.bool_()),
                             ("_next_chunk", pa.int64()), ("bound", pa.int64()), ("exit", pa.int64())])
    tails = (
        rows.select("_k", "_chunk", us, "_reset").join(links, ["_k", "_chunk"])
        .transform(_together, "_k", "_chunk").sortWithinPartitions("_k", "_chunk", us)
        .mapInArrow(_summariser(window_us, width, us, tail_schema),
                    "_k string, _chunk bigint, _linked_in boolean, _next_chunk bigint, bound bigint, exit bigint")
    )
    seed_schema = pa.schema([("_k", pa.string()), ("_chunk", pa.int64()), (us, pa.int64())])
    seeds = (
        tails.transform(_together, "_k").sortWithinPartitions("_k", "_chunk", "bound")
        .mapInArrow(_composer(window_us, seed_schema), f"_k string, _chunk bigint, {us} bigint")
        .withColumn("_seed", F.lit(True))
    )
    out_schema = T.StructType([*df.schema.fields, T.StructField("kept", T.BooleanType())])
    return (
        rows.withColumn("_seed", F.lit(False))
        .unionByName(seeds, allowMissingColumns=True)
        .transform(_together, "_k", "_chunk").sortWithinPartitions("_k", "_chunk", us, seq)
        .mapInArrow(_keeper(window_us, us, width), out_schema)
    )
