"""Documents in runs by ascending id, and hashes that all runs ask about in one exchange.

A run is a range of ids of about RUN_BYTES of text, small enough for one task. As ids ascend from
run to run, "earlier" between runs is a smaller run number, and equal ids share a run.

For a question about every distinct hash of a run (how often, where first, known elsewhere), one row
per hash would cost several times its 8 bytes. So a run sends its sorted hashes as one block for
each bucket of the hash space, a task answers a bucket for all runs, and each run gets the answers
in the order it asked. A hot hash is one entry of each run. Documents are dealt out once: the plan
uses the same exchange for the first and the later pass over a run.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text in a run and hashes in a bucket, for up to BASE bytes of text; both grow with its root up to GROW times.
RUN_BYTES, BUCKET_HASHES, BASE, GROW = 8 << 20, 1 << 20, 1 << 33, 16


@dataclass(frozen=True)
class Runs:
    rows: DataFrame     # run, doc_id (null ids as the smallest), text
    runs: int
    n_bytes: int
    grown: float

    def buckets(self, hashes: float) -> int:
        """Buckets for so many hashes altogether."""
        return max(1, int(-(-hashes // (BUCKET_HASHES * self.grown))))


def into_runs(docs: DataFrame, *more, run_bytes: int = RUN_BYTES) -> Runs:
    """``docs`` (doc_id, text) dealt into runs; ``more`` are further columns to carry.

    Null ids are before all others, in the first run. A null text stays null.
    """
    size = F.octet_length("text")
    seen = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n_bytes = int(seen["b"])
    grown = min(GROW, max(1.0, (n_bytes / BASE) ** 0.5))
    runs = max(1, -(-n_bytes // int(run_bytes * grown)))
    lowest = F.lit(-(1 << 63)).cast("bigint")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("doc_id"), "text", *more)
    run = F.lit(0)
    if runs > 1:
        # Ids at equal shares of the rows; a task finds its run by halving.
        shares = [i / runs for i in range(1, runs)]
        cuts = rows.agg(F.percentile_approx("doc_id", shares, min(1_000_000, 20 * runs)).alias("c")).first()["c"]
        cuts = sorted(set(cuts or []))
        table = F.array(*map(F.lit, cuts)) if len(cuts) < 4096 else F.from_json(F.lit(str(cuts)), "array<bigint>")
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
        # The run is the number of cuts up to the id: as many more of them as still hold, halving the step.
        run = F.aggregate(steps, F.lit(0), lambda n, k: F.when(
            (n + k <= len(cuts)) & (F.try_element_at(table, n + k) <= F.col("doc_id")), n + k).otherwise(n))
    return Runs(rows.select(run.cast("int").alias("run"), *rows.columns), runs, n_bytes, grown)


def by_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; a bucket is a range of the hash space."""
    width = (1 << 64) // buckets + 1
    cuts = np.array([min(b * width, (1 << 64) - 1) for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes with their bytes in planes, highest first: the leading planes hardly change and compress."""
    hashes, planes = hashes.astype(np.uint64, copy=False), np.empty((8, len(hashes)), np.uint8)
    for i in range(8):
        np.right_shift(hashes, np.uint64(56 - 8 * i), out=planes[i], casting="unsafe")
    return planes.tobytes()


def unpack(block: bytes) -> np.ndarray:
    planes = np.frombuffer(block, np.uint8).reshape(8, -1)
    hashes = planes[0].astype(np.uint64)
    for plane in planes[1:]:
        hashes <<= np.uint64(8)
        hashes |= plane
    return hashes


def squeezed(raw: bytes) -> bytes:
    """Size and compressed bytes."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(held: bytes) -> bytes:
    return pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)


ASKED = "run int, bucket int, hashes binary, extra binary"
ANSWER = "run int, bucket int, answer binary"


def asked(runs: Runs, buckets: int, question: Callable) -> DataFrame:
    """ASKED rows: ``question(table)`` of a run gives sorted distinct uint64 hashes, and an array beside them or None."""
    def blocks(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        hashes, extra = question(table)
        at = by_bucket(hashes, buckets)
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "run": pa.array([run] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
            "hashes": pa.array([pack(hashes[at[b]:at[b + 1]]) for b in full], pa.binary()),
            "extra": pa.array([b"" if extra is None else extra[at[b]:at[b + 1]].tobytes() for b in full], pa.binary())})

    return runs.rows.groupBy("run").applyInArrow(blocks, ASKED)


def answered(blocks: DataFrame, answer: Callable, more: int | None = None) -> DataFrame:
    """ANSWER rows: ``answer(runs, hashes, extras)`` of a bucket gives an array for each run, in ascending run order,
    and one more for the run number ``more`` if that is given."""
    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        number = table.column("run").to_pylist()
        found = answer(number, [unpack(x.as_py()) for x in table.column("hashes")], [x.as_py() for x in table.column("extra")])
        number += [more] * (len(found) - len(number))
        return pa.table({"run": pa.array(number, pa.int32()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(number), pa.int32()),
                         "answer": pa.array([x.tobytes() for x in found], pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(bucket, ANSWER)


def used(runs: Runs, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """``use(table, answers)`` of every run; the answers are bytes in the order of the run's hashes."""
    def apply(documents: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("bucket")
        return use(documents, b"".join(x.as_py() for x in replies.column("answer")))

    return runs.rows.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(apply, schema)


def merged(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of a bucket sorted, the block each came from, and where each value's group begins."""
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[order][1:] != every[order][:-1]
    return order, np.repeat(np.arange(len(hashes)), sizes)[order], np.flatnonzero(new)


def split_back(values: np.ndarray, order: np.ndarray, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Values in merged order, back in each block's own order."""
    out = np.empty(len(values), values.dtype)
    out[order] = values
    return np.split(out, np.cumsum([len(h) for h in hashes])[:-1])
