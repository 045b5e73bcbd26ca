"""Texts and words far longer than usual: equal to a plain version, in time that follows their length."""

import random

import brute
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from alertloom.llm import bpe, language, secrets


def long_text(n, seed):
    rng = random.Random(seed)
    parts = ["token = abcdefghijkl%05d", "AKIAABCDEFGHIJ%05d", "0123456789abcdef%05d", "naïve 😀 wörd %d", "password: '0123456789abcdef0123%d'",
             "ABCDEFGHIJKLMNOP%d", "Zz9-qW3rTyZz9-qW3rTyZz9-%05d", "https://a.example/b%d"]
    return " ".join(rng.choice(parts) % i for i in range(n))


def plain_mask(text, spans):
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], secrets.MASK]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_many_secrets(spark):
    texts = [long_text(n, n) for n in (0, 1, 255, 256, 257, 513, 3000, 100_000)] + [None, "x" * 700, "token=abcdefghijkl" * 300]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in secrets.op4_multipart_secrets(docs).collect()}
    for want in brute.op4(rows):
        assert tuple(got[want[0]])[:5] == tuple(want)
    assert got[7]["n_assign"] > 20_000
    clean = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    for i, text in rows:
        spans = [(int(a), int(b)) for _, a, b in (x.split(":") for x in got[i]["spans"].split(",") if x)]
        assert clean[i] == (None if text is None else plain_mask(text, spans)), i


def test_weak_apart(spark):
    """A weak span is dropped exactly where it overlaps a base one."""
    span = lambda a, b: {"start": a, "rank": 0, "end": b}
    rng = random.Random(3)
    rows = []
    for i in range(200):
        at = sorted(rng.sample(range(60), 2 * rng.randrange(0, 6)))
        low = rng.randrange(60)
        rows.append((i, span(low, low + rng.randrange(1, 8)), [span(a, b) for a, b in zip(at[::2], at[1::2])]))
    df = spark.createDataFrame(rows, f"i int, w struct<start:bigint,rank:int,end:bigint>, b {secrets.SPANS}")
    got = {r["i"]: r["t"] for r in df.select("i", secrets._touched(F.col("w"), F.col("b")).alias("t")).collect()}
    assert got == {i: any(w["start"] < s["end"] and s["start"] < w["end"] for s in b) for i, w, b in rows}


def test_long_words(spark):
    """Words on both sides of the fold's bound, and far beyond it, as the tokenizer's own library encodes them."""
    rng = random.Random(5)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)))
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = [word("ab", n) for n in (511, 512, 513)] + ["a" * 200_000, word("abcdefghijklmnopqrstuvwxyz", 200_000), word("日本語の文é", 5000),
             "=" * 3000, "a" * 600 + " " + "a" * 600 + " b", word("ethanois", 700) + " short words " + word("ethanois", 700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, run_bytes=100_000).collect()}
    assert got == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}


def test_long_joins():
    """The heap gives what joining the leftmost lowest pair step by step gives, for any ranks."""
    rng = random.Random(8)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        for piece in {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(30)}:
            ranks[piece] = len(ranks)
        word = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.join_long(word, ranks) == [ranks[p] for p in parts]


def test_language_steps():
    """The size of a step does not change a prediction."""
    rng = random.Random(4)
    model = language.Model(("a", "b"), np.random.default_rng(1).integers(0, 4, (1, 1 << language.SLOT_BITS)).astype(np.uint64), (0.1, 0.2))
    texts = ["".join(rng.choices("abcdeΣσé \n'1.", k=n)) for n in (1, 50, 3000)] + ["abc" * 500, " " * 40, ""]
    for text in texts:
        assert len({language.predict(text, model, chunk) for chunk in (1, 7, 100, 1 << 20)}) == 1
