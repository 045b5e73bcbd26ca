"""Words whose sums of powers collide in every odd base are different words in every operator."""

import random

import numpy as np
import pytest
import xxhash

import brute
from alertloom.llm import bpe, classes, decontaminate, quality, tokens, windows
from test_operators import encoding, same  # noqa: F401

A = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
B = A.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair(spark):
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([A] + rest)), (2, " ".join([B] + rest)), (3, f"{A}\n{B}\n{A}\n{B} x"), (4, A), (5, B), (6, "one two")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows


def test_word_hashes():
    rnd = random.Random(1)
    words = list({"".join(rnd.choices("ab", k=rnd.choice([*range(1, 40), 255, 256, 257, 1000]))).encode() for _ in range(5_000)} | {A.encode(), B.encode()})
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = tokens.words(data, np.array([0, len(data)]), tokens.SPACE)
    h = tokens.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(words)
    assert [tokens.word_hash(w) for w in words] == h.tolist()
    # Every bit of a hash depends on the last letter of short words.
    one, two = (np.array([tokens.word_hash(b"word%d" % i + x) for i in range(2_000)], np.uint64) for x in (b"a", b"b"))
    flips = np.unpackbits((one ^ two).view(np.uint8)).reshape(-1, 64).mean(axis=0)
    assert (abs(flips - 0.5) < 0.06).all()


def test_operators_on_the_pair(spark, pair, encoding):  # noqa: F811
    docs, rows = pair
    same(windows.op5_rabin_karp_windows(docs), brute.op5(rows))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same(quality.op6_risk_controlled_quality(docs, labels).drop("kept"), brute.op6(rows))
    items = [("i1", " ".join([B] + [f"w{i}" for i in range(12)]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    same(decontaminate.op7_positional_index_decontamination(docs, bench).drop("n_near_items"), brute.op7(rows, items))
    same(bpe.op9_hof_byte_bpe(docs), brute.op9(rows, encoding))
    got = {r["doc_id"]: r["n_known"] for r in classes.op10_brown_class_bigrams(docs).collect()}
    training = {w for i, t in rows if brute.crc_fold(i, 10) for w in t.split()}
    assert got == {i: 1 + sum(w in training for w in t.split()) for i, t in rows}
