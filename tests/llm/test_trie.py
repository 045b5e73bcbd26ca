"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from alertloom.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("depth", "key", "path", "end", "n", "shard"))])


def key(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def expected(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, key(role, text)[:32], role or "", text or ""))
    for c in convs:
        convs[c] = [(r, t) for _, _, _, r, t in sorted(convs[c])]
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = own + sum(saved[p] for p in children[path])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if made[c] == p).encode()).hexdigest()) for p, m in members.items())


def got(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def odd_rows(seed):
    rnd = random.Random(seed)
    texts = ["hi", "", None, "é" * 3, "long " * 40, "hi"]
    rows = []
    for c in [*range(-12, 60), 1000, 1003, 10**12 + 1]:
        if c % 7 != 3:
            rows += [(c, rnd.choice([t, t, None]), rnd.choice(["user", None, "a"]), rnd.choice(texts)) for t in range(rnd.randint(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(12)]      # copies
    rows += [(c, t, "user", f"same {t}") for c in range(200, 220) for t in range(c - 199)]  # beginnings of one another
    rows += [(300, t, "u", str(t)) for t in range(700)] + [(305, t, "u", str(min(t, 650))) for t in range(690)]
    rows += [(None, 1, "user", "x"), (None, None, None, None)] + [(400, 1, "user", "twice")] * 3
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("paths,turns", [(2048, 1 << 16), (16, 1 << 16), (2, 8)])
def test_odd_rows(spark, paths, turns):
    rows = odd_rows(paths)
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(4)
    nodes = trie.trie(trie.rebuilt(trie.turns_of(df)), paths, turns)
    assert got(nodes) == expected(rows)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    assert got(trie.op13_bitmap_trie(df)) == want
    assert got(trie.trie(trie.rebuilt(trie.turns_of(df)), 4, 10)) == want


def test_end_list_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "LISTED", 3)
    rows = [(c, 0, "user", "same") for c in range(50)]
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)
    assert got(trie.op13_bitmap_trie(df)) == expected(rows)


def test_empty_table(spark):
    assert trie.op13_bitmap_trie(spark.createDataFrame([], SCHEMA)).count() == 0
