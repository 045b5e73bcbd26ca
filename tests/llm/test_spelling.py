"""Spelling variants against edit distance over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from alertloom.llm import spelling

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       *(T.StructField(c, T.StringType()) for c in ("word", "n", "key", "form", "side", "size", "g"))])
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def counts(docs, deleted=199):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % deleted == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def expected(n):
    letters = {c for w in n for c in w}
    forms, rows = {}, {}
    for w in n:
        near = [x for x in edits(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        forms[w] = best if near and n[best] >= 5 * n[w] else None
        rows[w] = len(near)
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], rows[w], n[forms[w]] if forms[w] else None))
    return out


def got(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,indexed", [(0, 1 << 19), (1, 300), (2, 40)])
def test_near_words_of_a_dense_vocabulary(spark, seed, indexed):
    """Few letters, so that runs of equal ones and halves that many words have are common; small groups and blocks."""
    rnd = random.Random(seed)
    n = {"".join(rnd.choices("aabé", k=rnd.randint(6, 9))): rnd.choice([5, 6, 30, 31, 160, 5000]) for _ in range(500)}
    n.update({"abcabc" + "d" * k: 7 ** (k % 6) * 5 for k in range(30)})
    words = spark.createDataFrame(list(n.items()), "word string, n bigint").repartition(3)
    assert got(spelling.variants(words, indexed=indexed)) == expected(n)


def test_odd_rows(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choices("abcdefghijÀ÷ÿ", k=rnd.randint(5, 14))) for _ in range(60)]
    def typo(w):
        i = rnd.randrange(len(w))
        return rnd.choice([w[:i] + w[i + 1:], w[:i] + "e" + w[i:], w[:i] + "f" + w[i + 1:], w.upper(), w])
    docs = [(i, " ".join(typo(rnd.choice(base)) if rnd.random() < .3 else rnd.choice(base) for _ in range(80))) for i in range(150)]
    docs += [(None, " ".join(base)), (None, None), (5, None), (6, ""), (7, "12 Ā ,"), (8, "x" * 3000), (9, "x" * 2999)]
    docs += [(100 + i, "x" * 3000 + " " + "x" * 2999 + " " + "y" + "x" * 2999) for i in range(6)] * 2
    df = spark.createDataFrame([(*d, *"abcdefg") for d in docs], SCHEMA).repartition(4)
    n = counts(docs)
    assert got(spelling.op12_fm_spelling(df)) == expected(n)
    more = spelling.variants(spelling.vocabulary(df, deleted=7))
    assert got(more) == expected(counts(docs, 7))


def test_given_table_and_empty_table(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    rows = got(spelling.op12_fm_spelling(small))
    assert rows == expected(counts(docs)) and len(rows) > 500
    assert spelling.op12_fm_spelling(spark.createDataFrame([], SCHEMA)).count() == 0
