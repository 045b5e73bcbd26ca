"""The prefix trie of conversations from vertical bitmaps.

Turns become 128-bit keys, conversations strings of keys. Equal conversations are one path with a
count. Paths are put in order and dealt out in ranges, so a subtree lies in one shard or in
neighbouring ones. A shard holds, for every (position, turn), the bitset of its paths with that turn
there; from the root down, a node's bitset is intersected with the postings of the next position,
which gives its children, and what no posting takes ends at the node. All that a node reports adds
up over shards: counts of members, children and leaves are counted where the node is first met. Only
nodes that the last path of a shard shares with the first of the next one are open and have to be
added up; a shard learns from its neighbours' paths which these are.
"""

from __future__ import annotations

import hashlib
import math
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hex digits of a turn's key; paths and turns of a shard; ids in one piece of an end list.
KEY, SHARD_PATHS, SHARD_TURNS, LISTED = 32, 2048, 1 << 16, 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: an array of (key, size) a conversation, in order of its turns.

    Null turns come first; rows of one turn follow by the key of their role and text. Null role or text is empty. Rows
    without a conv_id belong to no conversation. Texts do not leave the task that reads them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, KEY)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("size")).alias("t"))
    # Structs sort by field, nulls first.
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 5, longest: int = 9) -> DataFrame:
    """``conv_id, turns``: the first h turns of conversation c - c % group, then the own ones after the first h.

    h = crc32 of the decimal id, modulo ``longest``. ``%`` is SQL's: it has the sign of the id.
    """
    first = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    rows = turns.withColumns({"h": h, "base": base}).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _shared(a: str, b: str) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid * KEY] == b[:mid * KEY] else (low, mid - 1)
    return low


NODES = ("key binary, parent binary, end binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint")
_NUMBERS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _keys(path: str, depth: int) -> list[bytes]:
    """Keys of the nodes of a path up to a depth; the last of a whole path is its ``end``."""
    h, out = hashlib.sha256(), []
    for d in range(depth + 1):
        h.update(path[(d - 1) * KEY:d * KEY].encode() if d else b"")
        out.append(h.copy().digest()[:KEY // 2])
    return out


class _Node:
    """A node on the way: its members, those not yet parted, and what is summed up so far."""

    __slots__ = ("depth", "members", "rest", "row", "key", "new", "size", "n", "least", "children", "leaves", "saved", "end")

    def __init__(self, depth, members, row, key, new, size):
        self.depth, self.members, self.rest, self.row, self.key, self.new, self.size = depth, members, members, row, key, new, size
        self.n, self.least, self.children, self.leaves, self.saved, self.end = 0, None, 0, 0, 0, None

    def take(self, n, least, leaves, saved):
        self.n += n
        self.least = least if self.least is None else min(self.least, least)
        self.leaves += leaves
        self.saved += saved


def shard_nodes(rows: pa.Table, around: pa.Table) -> pa.Table:
    """NODES of a shard of paths; ``key`` and ``parent`` are set where that node is open to a neighbour.

    A row has path, its key ``end``, the sizes of its turns, its copies ``n`` and their smallest conv_id.
    """
    rows = rows.sort_by("path")
    paths, ends, sizes = (rows.column(c).to_pylist() for c in ("path", "end", "sizes"))
    copies, least = rows.column("n").to_pylist(), rows.column("conv_id").to_pylist()
    before, after = around.column("before")[0].as_py(), around.column("after")[0].as_py()
    last = len(paths) - 1
    met = -1 if before is None else _shared(before, paths[0])       # up to this depth the first path is not new
    going = -1 if after is None else _shared(paths[last], after)    # up to this depth the last path goes on
    met_keys, going_keys = _keys(paths[0], met) if met >= 0 else [], _keys(paths[last], going) if going >= 0 else []

    # The vertical index: position -> turn -> bitset of paths.
    postings: list[dict[str, int]] = []
    for i, path in enumerate(paths):
        for d in range(len(path) // KEY):
            if d == len(postings):
                postings.append({})
            turn = path[d * KEY:(d + 1) * KEY]
            postings[d][turn] = postings[d].get(turn, 0) | 1 << i

    keys: dict[str, list] = {"key": [], "parent": [], "end": []}
    numbers = {c: array("q") for c in _NUMBERS}

    def room(parent: _Node | None) -> int:
        keys["key"].append(None)
        keys["end"].append(None)
        keys["parent"].append(parent.key if parent else None)
        for c in _NUMBERS:
            numbers[c].append(parent.row if parent and c == "parent_conv_id" else -1)
        return len(keys["key"]) - 1

    def visit(depth: int, members: int, parent: _Node | None) -> _Node:
        old, goes_on = bool(members & 1) and depth <= met, depth <= going and bool(members >> last & 1)
        first = (members & -members).bit_length() - 1
        key = met_keys[depth] if old else going_keys[depth] if goes_on else None
        return _Node(depth, members, room(parent), key, not old, sizes[first][depth - 1] if depth else 0)

    def chain(i: int, depth: int, parent: _Node):
        """The nodes from a depth on that path i alone has."""
        own = np.array(sizes[i][depth - 1:], np.int64)
        many, row = len(own), len(keys["key"])
        saved = (copies[i] - 1) * np.cumsum(own[::-1])[::-1]
        keys["key"].extend([None] * many)
        keys["parent"].extend([parent.key] + [None] * (many - 1))
        keys["end"].extend([None] * (many - 1) + [ends[i]])
        for c, values in (("conv_id", np.full(many, least[i])), ("depth", np.arange(depth, depth + many)),
                          ("parent_conv_id", np.append(parent.row, np.arange(row, row + many - 1))), ("n_convs", np.full(many, copies[i])),
                          ("n_children", np.append(np.ones(many - 1, np.int64), 0)), ("n_leaves", np.ones(many, np.int64)), ("saved_tokens", saved)):
            numbers[c].frombytes(values.astype(np.int64).tobytes())
        parent.take(copies[i], least[i], 1, int(saved[0]))

    stack = [visit(0, (1 << len(paths)) - 1, None)]
    while stack:
        node = stack[-1]
        if node.rest:
            i, depth = (node.rest & -node.rest).bit_length() - 1, node.depth
            if len(paths[i]) == depth * KEY:
                node.rest ^= 1 << i
                node.end = ends[i]
                node.take(copies[i], least[i], 0, 0)
                continue
            members = node.rest & postings[depth][paths[i][depth * KEY:(depth + 1) * KEY]]
            node.rest ^= members
            if members.bit_count() == 1 and depth >= max(met if i == 0 else -1, going if i == last else -1):
                node.children += 1
                chain(i, depth + 1, node)
                continue
            child = visit(depth + 1, members, node)
            node.children += child.new
            stack.append(child)
            continue
        stack.pop()
        goes_on = node.depth <= going and node.members >> last & 1
        node.leaves += node.end is not None and node.members.bit_count() == 1 and not goes_on
        node.saved += (node.n - node.new) * node.size
        keys["key"][node.row], keys["end"][node.row] = node.key, node.end
        for c, value in (("conv_id", node.least), ("depth", node.depth), ("n_convs", node.n), ("n_children", node.children),
                         ("n_leaves", node.leaves), ("saved_tokens", node.saved)):
            numbers[c][node.row] = int(value)
        if stack:
            stack[-1].take(node.n, node.least, node.leaves, node.saved)
    columns = {c: np.frombuffer(v, np.int64) for c, v in numbers.items()}
    parent = columns["parent_conv_id"]
    columns["parent_conv_id"] = pa.array(columns["conv_id"][np.maximum(parent, 0)], pa.int64(), mask=parent < 0)
    return pa.table({**{c: pa.array(v, pa.binary()) for c, v in keys.items()}, **columns})


def listed(batches: Iterable[pa.RecordBatch]):
    """mapInArrow over end, conv_id in order: the ids of an end as text, in pieces of bounded length."""
    end, first, ids = None, None, []

    def piece():
        return pa.RecordBatch.from_pydict({"end": pa.array([end], pa.binary()), "first": pa.array([first], pa.int64()),
                                           "ids": pa.array([",".join(ids)], pa.string())})

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        for e, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (e != end or len(ids) >= LISTED):
                rows.append(piece())
                ids = []
                if len(rows) >= 1024:
                    yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                    rows = []
            if not ids:
                end, first = e, i
            ids.append(str(i))
    if ids:
        rows.append(piece())
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


def digested(batches: Iterable[pa.RecordBatch]):
    """mapInArrow over end, first, ids in order: the digest of each end's whole list, holding one piece at a time."""
    end, h = None, None
    out: list[tuple] = []

    def taken():
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())],
                                          names=["end", "ends_sha256"])

    for batch in batches:
        for e, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if e != end:
                if h is not None:
                    out.append((end, h.hexdigest()))
                end, h = e, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_py().encode())
        if len(out) > 10_000:
            yield taken()
            out = []
    if h is not None:
        out.append((end, h.hexdigest()))
    if out:
        yield taken()


def end_lists(ends: DataFrame) -> DataFrame:
    """``end, ends_sha256`` of ``ends`` (end, conv_id): the digest of each end's ids, ascending and comma-joined.

    Ids are sorted by range, so many tasks write the text of a frequent end; the digest then reads that text as a stream.
    """
    pieces = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(
        listed, "end binary, first bigint, ids string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(digested, "end binary, ends_sha256 string")


def trie(turns: DataFrame, shard_paths: int = SHARD_PATHS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a node of the prefix trie of ``turns`` (conv_id, turns: array of key and size; conv_ids distinct).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` and
    ``saved_tokens`` over the subtree, ``ends_sha256``. No conversations, no nodes. A conversation's keys are held in one
    task, 32 bytes a turn; its texts are not.
    """
    path = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    rows = turns.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = materialize(rows.withColumn("end", F.unhex(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, KEY))), "trie-rows")
    distinct = materialize(rows.groupBy("end").agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "trie-paths")
    size = distinct.agg(F.count("*").alias("p"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("t")).first()
    shards = max(1, math.ceil(size["p"] / shard_paths), math.ceil(size["t"] / shard_turns))
    dealt = materialize(distinct.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "trie-shards")
    by_shard = Window.orderBy("shard")  # one row a shard
    around = dealt.groupBy("shard").agg(F.min("path").alias("a"), F.max("path").alias("z")).select(
        "shard", F.lag("z").over(by_shard).alias("before"), F.lead("a").over(by_shard).alias("after"))
    nodes = materialize(dealt.groupBy("shard").cogroup(around.groupBy("shard")).applyInArrow(shard_nodes, NODES), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = materialize(nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("end").alias("end"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), *sums), "trie-open")
    every = nodes.where("key IS NULL").unionByName(opened)
    parents = opened.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    below = every.where("parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
    every = every.where("parent IS NULL").unionByName(below)
    ended = every.where("end IS NOT NULL").join(end_lists(rows), "end")
    passed = every.where("end IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return ended.unionByName(passed).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_bitmap_trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Null turns come first, rows of one turn in order of the key of role and text, repeated rows are turns of their own;
    null role or text is empty; rows with a null conv_id belong to no conversation; other columns are ignored. An empty
    table has no nodes.
    """
    return trie(rebuilt(turns_of(conversations)))


#: The check: nodes as strings of digests, subtrees by common beginnings. CRC-32 bit by bit.
ORACLE = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h FROM ids),
turns AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    strlen(coalesce(text, '')) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
parts AS (SELECT h.c, 0 AS own, t.p, t.k, t.b FROM hashed h JOIN turns t ON t.c = h.c - h.c % 5 AND t.p <= h.h
    UNION ALL SELECT h.c, 1, t.p, t.k, t.b FROM hashed h JOIN turns t ON t.c = h.c AND t.p > h.h),
steps AS (SELECT c, b, row_number() OVER w AS d, string_agg(k, '') OVER w AS path FROM parts
    WINDOW w AS (PARTITION BY c ORDER BY own, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
prefixes AS (SELECT c, b, d, path FROM steps UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT path, d, min(c) AS c, count(*) AS n, max(b) AS b, substr(path, 1, (d - 1) * 64) AS up FROM prefixes GROUP BY path, d),
families AS (SELECT v.*, (SELECT count(*) FROM nodes u WHERE u.d = v.d + 1 AND u.up = v.path) AS children FROM nodes v),
subtrees AS (SELECT v.path, sum(CASE WHEN u.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.b) AS saved
    FROM families v JOIN families u ON starts_with(u.path, v.path) GROUP BY v.path),
lengths AS (SELECT c, max(d) AS d FROM prefixes GROUP BY c),
ends AS (SELECT p.path, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS e FROM prefixes p JOIN lengths l ON l.c = p.c AND l.d = p.d GROUP BY p.path)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, u.c AS parent_conv_id, v.n::BIGINT AS n_convs, v.children::BIGINT AS n_children,
    s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM families v JOIN subtrees s ON s.path = v.path LEFT JOIN families u ON v.d = u.d + 1 AND v.up = u.path LEFT JOIN ends e ON e.path = v.path
"""
