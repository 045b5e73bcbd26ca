"""SimHash near duplicates found by deletion variants of half fingerprints.

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of one half. So
each half is indexed 32 times, with one bit left out each time; fingerprints that link have such a
variant in common. Variants meet by equality, the distance is then verified, and links become
components.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from . import tokens
from .components import connected
from .tables import fresh, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, DISTANCE = 3, 42, 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None, shingle: int = SHINGLE, step: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a text's word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else iter([words])
    ones, n = np.zeros(64, np.int64), 0
    while True:
        hashes = b"".join([xxhash.xxh64_digest(b" ".join(s), SEED) for s in itertools.islice(shingles, step)])
        if not hashes:
            break
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
        if len(bits) < step:
            break
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers, one text at a time; a null text has no words."""
    return pa.array(np.array([simhash(t.as_py()) for t in text], np.uint64).view(np.int64))


def _distances(one: np.uint64, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one)


def spanning_links(prints: np.ndarray, distance: int = DISTANCE) -> tuple[list, list]:
    """Links that join the same distinct prints as all links within ``distance`` would.

    Each print looks for its links among those that none has reached yet, so a dense group costs
    little more than its size, and at most one link a print is given.
    """
    left, a, b = prints, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _distances(one, left) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), one))
                b.append(found)
                queue.extend(found)
    return a, b


def _bucket_links(batches):
    """Spanning links of every bucket, from batches sorted by (variant, print); a bucket may go on in the next batch."""
    held_key, held = None, []

    def close():
        prints = np.concatenate(held) if held else np.zeros(0, np.uint64)
        return spanning_links(prints) if len(prints) > 1 else ([], [])

    def out(a, b):
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))),
                                           pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])

    for batch in batches:
        at = batch.column("variant").to_numpy(zero_copy_only=False)
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        place = batch.column("place").to_numpy(zero_copy_only=False)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1])
        cuts = np.concatenate([np.flatnonzero(new), [len(at)]])
        sizes = np.diff(cuts)
        a, b = [], []
        # Only buckets of several prints, and those at either end of the batch, need a look.
        look = set(np.flatnonzero(sizes > 1)) | {0, len(sizes) - 1} if len(sizes) else set()
        for i in sorted(look):
            key = (int(place[cuts[i]]), int(at[cuts[i]]))
            if key != held_key:
                x, y = close()
                a += x
                b += y
                held_key, held = key, []
            held.append(prints[cuts[i]:cuts[i + 1]])
        if a:
            yield out(a, b)
    a, b = close()
    if a:
        yield out(a, b)


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column ``print``) that join all that are within DISTANCE."""
    halves = []
    for half in range(2):
        for bit in range(32):
            mask = ((1 << 32) - 1) ^ (1 << bit)
            value = F.shiftrightunsigned("print", 32) if half else F.col("print").bitwiseAND(F.lit((1 << 32) - 1).cast("bigint"))
            halves.append(F.struct(F.lit(half * 32 + bit).alias("place"), value.bitwiseAND(F.lit(mask).cast("bigint")).alias("variant")))
    variants = prints.select("print", F.explode(F.array(*halves)).alias("v")).select("v.place", "v.variant", "print")
    dealt = variants.repartition(F.xxhash64("place", "variant")).sortWithinPartitions("place", "variant", "print")
    return dealt.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, root (the smallest print linked with it) and component_id of every row.

    A null or blank text has fingerprint 0 and links like any other. Copies share one fingerprint and
    are linked once. A null id is no candidate for the smallest one; a component of null ids
    only has a null component_id. Repeated rows give repeated results. Other columns are not read.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("print")), "prints")
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    found = connected(links(prints.select("print"))).withColumnRenamed("node", "print")
    by_root = prints.join(found, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    members = by_root.select("print", "root").join(smallest, "root")
    return rows.join(members, "print").select("doc_id", "print", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id.

    Where an id is repeated, or a component has null ids only, the first of its rows by all columns
    stays, found among those rows alone.
    """
    # Ids that are joined with the rows have a name that no column of theirs has.
    own, odd_id = fresh(docs, "_own"), fresh(docs, "_odd")
    member = materialize(groups(docs), "members")
    times = member.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("least"))
    once = times.where("n = 1 and least").select(F.col("doc_id").alias(own))
    out = docs.join(once, docs["doc_id"] == once[own], "left_semi")
    several = times.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(odd_id))
    odd = (member.join(several, member["doc_id"].eqNullSafe(several[odd_id]), "left_semi")
           .where("doc_id <=> component_id").select(F.col("doc_id").alias(odd_id), "print", "root").distinct())
    if odd.isEmpty():
        return out
    ids = odd.select(odd_id).distinct()
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids[odd_id]), "left_semi")
    rows = rows.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), fingerprint("text").alias("p"))
    more = (rows.join(odd, rows["i"].eqNullSafe(odd[odd_id]) & (rows["p"] == odd["print"]))
            .groupBy("root").agg(F.min("row").alias("row")).select("row.*"))
    return out.unionByName(more)


def op8_deletion_variant_simhash(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
