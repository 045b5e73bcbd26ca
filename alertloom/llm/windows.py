"""Substring dedup on words: every window of 13 words is hashed, hashes are counted over the corpus.

A word goes if a window that covers it also starts in a document with a smaller id. Rabin-Karp
hashes of all windows of a run come from one prefix sum. A run settles its own repeats and asks
once for each distinct hash whether an earlier run has it; covered words merge into maximal spans.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from . import runs as R, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"
LOWEST = -(1 << 63)


def _windows(table: pa.Table, length: int):
    """Sorted distinct window hashes of a run with the smallest id of each, and per piece what it takes to return to them."""
    column = table.column("text").combine_chunks()
    ids = table.column("doc_id").to_numpy()
    every, owner = [], []
    for at, rows in tokens.pieces(column):
        data, offsets = tokens.flat(column.slice(at, rows))
        starts, ends, first = tokens.words(data, offsets, tokens.SPACE)
        place, h = tokens.window_hashes(tokens.word_hashes(data, starts, ends), first, length)
        every.append(h)
        owner.append(ids[at + np.searchsorted(first, place, "right") - 1])
    h = np.concatenate(every) if every else np.zeros(0, np.uint64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    kinds, back = np.unique(h, return_inverse=True)
    least = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(least, back, owner)
    return kinds, owner > least[back], back


def earlier_elsewhere(_, hashes, __):
    """For each hash of each run, whether an earlier run has it: the first entry of a group is the earliest run's."""
    order, _, begins = R.merged(hashes)
    later = np.ones(len(order), np.uint8)
    later[begins] = 0
    return R.split_back(later, order, hashes)


def deduplicate(docs: DataFrame, length: int = WINDOW, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans (words, end exclusive) of every row.

    A null text has no words. A text shorter than a window loses nothing. Rows with the same id are
    not earlier than each other, so repeated rows have equal results; a null id is smaller than all
    others. Other columns are not read. Windows are equal by a 64-bit hash.
    """
    runs = R.into_runs(docs.select("doc_id", "text"), run_bytes=run_bytes)

    def question(table):
        return _windows(table, length)[0], None

    def use(table: pa.Table, replies: bytes) -> pa.Table:
        kinds, later, back = _windows(table, length)
        known = np.frombuffer(replies, np.uint8).astype(bool)
        repeated = later | known[back] if len(back) else later
        column, done, out = table.column("text").combine_chunks(), 0, []
        for at, rows in tokens.pieces(column):
            data, offsets = tokens.flat(column.slice(at, rows))
            starts, ends, first = tokens.words(data, offsets, tokens.SPACE)
            place, _ = tokens.window_hashes(np.zeros(len(starts), np.uint64), first, length)
            begin = place[repeated[done:done + len(place)]]
            done += len(place)
            gone = tokens.cover(begin, begin + length, len(starts))
            text = data.tobytes()
            for i in range(rows):
                a, b = first[i], first[i + 1]
                mine = gone[a:b]
                kept = np.flatnonzero(~mine) + a
                low, high = tokens.spans_of(mine)
                joined = b" ".join([text[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())])
                out.append((b - a, int(mine.sum()), hashlib.sha256(joined).hexdigest(), low.tolist(), high.tolist()))
        ids = [None if i == LOWEST else i for i in table.column("doc_id").to_pylist()]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([x[0] for x in out], pa.int64()),
            "n_removed": pa.array([x[1] for x in out], pa.int64()), "kept_sha256": pa.array([x[2] for x in out], pa.string()),
            "starts": pa.array([x[3] for x in out], pa.list_(pa.int64())), "ends": pa.array([x[4] for x in out], pa.list_(pa.int64()))})

    # About one window for every six bytes.
    blocks = R.asked(runs, runs.buckets(runs.n_bytes / 6), question)
    return R.used(runs, R.answered(blocks, earlier_elsewhere), use, OUT)


def op5_rabin_karp_windows(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
