"""Packing against the tokenizer itself, one-by-one placement and its own promises."""

import itertools
import sys
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from alertloom.llm import packing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("length", "rank", "part", "ids", "local", "n"))])
ODD = ["", None, "a", "<|endoftext|>x<|startoftext|> y", "don't I'LL we've IT'S 12345 3.14", "café CAFÉ été naïve Straße",
       "你好 мир ΟΔΟΣ ǅ İstanbul", "a b c\x1cd\x1fe ́x", "tab\tnew\nline\r\nvt\x0bff\x0c end", "\U0001f600\U0001f600 x² ½ ٣ _-_!?",
       "á" * 50, "x" * 5000, "<|endoftext", "|> <|", "×÷ªº µm", "\x00\x01 ctrl"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _encode():
    return packing.encoder(open(packing.VOCABULARY, encoding="utf-8").read())


def test_encoder_equals_the_library(tokenizer, small):
    encode = _encode()
    rnd = random.Random(3)
    letters = "abcXYZ '’.,<|>éßÀ×÷ \t\n ́ª1²中Σςẞ\U0001f600"
    texts = ODD + ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(3000)]
    texts += [r["text"] for r in small.select("text").collect()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer(text), repr(text)


def one_by_one(counts, length):
    """How many packs are how full when every piece is placed by itself into the shortest pack that it fits."""
    packs = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [p for p in packs if sum(p) + size <= length]
            if fits:
                min(fits, key=sum).append(size)
            else:
                packs.append([size])
    return Counter(sum(p) for p in packs)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_equal_one_by_one_placement(seed):
    rnd = random.Random(seed)
    length = rnd.choice([8, 16, 64])
    counts = Counter(rnd.choice([rnd.randint(1, length - 1), rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 150)))
    placed, groups = packing.shortest_pack_first(counts, length)
    packs, spans = defaultdict(list), defaultdict(list)
    for size, rank, number, copies, first, offset in placed:
        for i in range(number):
            for j in range(copies):
                packs[first + i].append(size)
                spans[first + i].append((offset + j * size, size))
    # Equally short packs may swap what they get; how many are how full may not.
    assert Counter(sum(p) for p in packs.values()) == one_by_one(counts, length)
    assert Counter(s for p in packs.values() for s in p) == counts
    assert {p: sum(x) for p, x in packs.items()} == {f + i: filled for f, n, filled in groups for i in range(n)}
    for held in spans.values():
        at = 0
        for start, size in sorted(held):
            assert start == at
            at += size


def _padding(rows, length):
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    return used, sum(length - u for u in used.values() if u & (u - 1))


def _check(rows, docs, encode, length, least_gap):
    """Every document's ids come back, sequences are gapless, padding is as promised."""
    want = Counter((i, tuple(np.frombuffer(encode(t), "<u4").tolist()) + (2,)) for i, t in docs)
    by_sequence, by_place = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= length and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_place[(r["doc_id"], r["doc_tokens"])].append(r)
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length and (not at & (at - 1) or length - at < least_gap)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    whole = Counter()
    for (i, tokens), held in by_place.items():
        copies = sum(n for (d, ids), n in want.items() if d == i and len(ids) == tokens)
        covered = Counter()
        for r in held:
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert covered == {k: copies for k in range(tokens)}
        if copies == 1:
            whole[(i, tuple(np.frombuffer(b"".join(r["ids"] for r in sorted(held, key=lambda r: r["start"])), "<u4").tolist()))] += 1
    once = Counter((i, len(ids)) for i, ids in want.elements())
    assert whole == Counter({k: n for k, n in want.items() if once[(k[0], len(k[1]))] == 1})
    return by_sequence


@pytest.mark.parametrize("length,least_gap", [(64, 4), (4096, 16), (8, 1)])
def test_pack_odd_rows(spark, length, least_gap):
    rnd = random.Random(length)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "same text"), (None, "same text"), (7, "same id"), (7, "same id")]
    docs += [(1000 + i, " ".join(rnd.choice(["one", "two", "three"]) for _ in range(rnd.choice([33, 35, 40, rnd.randint(0, 90)])))) for i in range(300)]
    df = spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA).repartition(5)
    rows = packing.pack(df, length=length, least_gap=least_gap).collect()
    _check(rows, docs, _encode(), length, least_gap)


def test_documents_just_over_half_leave_no_gaps(spark):
    docs = [(i, "one " * 39) for i in range(200)]
    rows = packing.pack(spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA).repartition(3), length=64, least_gap=4).collect()
    used, padding = _padding(rows, 64)
    _check(rows, docs, _encode(), 64, 4)
    assert len(used) <= 200 * 40 // 64 + 6 and padding <= 4 * len(used)


def test_empty_table_and_digest(spark, small):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    encode = _encode()
    docs = {r["doc_id"]: np.append(np.frombuffer(encode(r["text"]), "<u4"), np.array([2], "<u4")) for r in small.collect()}
    rows = packing.op11_histogram_packing(small).collect()
    for r in rows:
        own = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].astype("<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(map(len, docs.values()))
    used, padding = _padding(rows, 4096)
    assert padding < 16 * len(used)


def test_a_new_word_takes_few_calls():
    encode, calls = _encode(), 0

    def count(_, event, __):
        nonlocal calls
        calls += event in ("call", "c_call")

    words = ["".join(c) for c in itertools.product("bcdfgh", "aeiou", "klmnp", "aeiou", "rst")]
    text = " ".join(words)
    encode("warm up")
    sys.setprofile(count)
    try:
        encode(text)
    finally:
        sys.setprofile(None)
    assert calls < 21 * len(words)
