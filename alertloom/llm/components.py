"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _contract(batches):
    """Links of a part of the table as stars: every node with the smallest node it reaches there, batch by batch."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        node, root = roots(a, b)
        apart = node != root
        yield pa.RecordBatch.from_arrays([pa.array(root[apart]), pa.array(node[apart])], ["a", "b"])


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: every node of the links (a, b) with the smallest node of its component.

    Alternates two steps until no link changes: every node links its larger neighbours to its
    smallest one, then its smaller ones. A hub is a group of links that is aggregated, never held
    as a list: each step is a minimum for each node and a join. Each round is written to the shared
    folder. Parts of the table are contracted to stars first, which leaves few rounds.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialize(links.mapInArrow(_contract, "a bigint, b bigint").distinct(), "links")
    last = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: for each node, its larger neighbours go to its smallest neighbour or itself.
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")
        large = large.where(F.col("a") != F.col("b")).distinct()
        # Small star: for each node, its smaller neighbours and itself go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        links = materialize(
            small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b")
            .unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "links")
        # Stars only: no node has two roots, and no root is another's member.
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not seen["n"] or (seen["n"], seen["s"]) == last:
            break
        last = (seen["n"], seen["s"])
    else:
        raise RuntimeError("components did not settle")
    star = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return star.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
