"""Hierarchical weighted hash tree: rows to shards by draws at region, rack and shard level.

At each level every child draws ``-ln(u) / weight`` with u hashed from the row's key and the
child's name, and the smallest draw wins. A child is chosen in proportion to its weight, and a
draw depends on nothing but the key, the child and the child's weight. So if the weight of one
subtree grows, rows move only into that subtree from its siblings, and if it shrinks, only out of
it; the order of all other children of a node stays. A new region therefore takes rows only into
itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import materialize


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has a shard number and a weight, an inner node weighs its sum."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else self.own_weight)


def layout(shards: int, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None, first: int = 8) -> Node:
    """The tree over ``shards`` shards; it depends on nothing but their number (and weights).

    The first ``first`` shards fill regions of ``racks`` x ``per_rack`` shards in turn. Every further shard is a region
    of its own, so from ``first`` on a tree of one shard more is the same tree with one region more, and rows move into
    that one only. Below ``first`` a shard more makes its region heavier, and rows move into all of that region.
    """
    weights = weights or {}
    old = min(shards, first)
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(old):
        region, rest = divmod(s, racks * per_rack)
        leaf = Node(f"shard-{s}", shard=s, own_weight=weights.get(s, 1.0))
        regions.setdefault(region, {}).setdefault(rest // per_rack, []).append(leaf)
    made = [Node(f"region-{r}", tuple(Node(f"region-{r}/rack-{k}", tuple(leaves)) for k, leaves in sorted(by_rack.items())))
            for r, by_rack in sorted(regions.items())]
    for s in range(old, shards):
        leaf = Node(f"shard-{s}", shard=s, own_weight=weights.get(s, 1.0))
        made.append(Node(f"region-of-{s}", (Node(f"region-of-{s}/rack-0", (leaf,)),)))
    return Node("root", tuple(made))


def _draw(key: Column, node: Node) -> Column:
    """Exponential with the node's weight as rate, from 52 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches below ``node``; children without weight get no rows."""
    if node.shard is not None:
        return F.lit(node.shard)
    children = [c for c in node.children if c.weight > 0]
    if len(children) == 1:
        return descend(key, children[0])
    # Every draw stands once in the expression, however many children a node has.
    best = F.least(*(F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(children)))["i"]
    return F.get(F.array(*(descend(key, c) for c in children)), best)


def assign(docs: DataFrame, tree: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text",
           rows_per_chunk: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    * Only the id decides on the shard; a null id is a key of its own. Repeated rows and equal ids
      get one shard. A null text has 0 bytes (size 1, crc32 0). An empty table gives no rows. Other
      columns are not read, so names cannot clash.
    * ``slot`` numbers the rows of a shard from 0 without gaps. A shard's rows are numbered in
      hashed chunks of about ``rows_per_chunk`` rows, each moved up by the rows of the chunks
      before it, so no task sees a whole shard. Rows equal in all columns get the next numbers in
      any order. Chunks hash the text too, so a repeated id does not fill one.
    * Text never takes part in a shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null id"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"))
    n = docs.count()
    shards = len(_leaves(tree))
    chunks = max(1, -(-n // (shards * rows_per_chunk)))
    # Written once: both the chunk counts and the numbering read these narrow rows.
    rows = materialize(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(chunks))), "shards")
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("shard").alias("s"), F.col("chunk").alias("c"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("place", place)
    return (numbered.join(before, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    (F.col("base") + F.col("place") - 1).cast("bigint").alias("slot"), "grown_shard"))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in _leaves(c)]


def op2_hash_tree_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    return assign(docs, layout(shards), layout(shards + 1))
