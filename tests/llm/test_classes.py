"""Exchange clustering over all words and the scores of the class model, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import classes, tokens
import brute

END = None


def likelihood(pairs, of):
    """Sum of n log n over class bigrams, less that over both sides."""
    cells, left, right = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        cells[of[a], of[b]] += n
        left[of[a]] += n
        right[of[b]] += n
    f = lambda c: sum(n * math.log(n) for n in c.values() if n)
    return f(cells) - f(left) - f(right)


def texts_of(rows):
    """(id, held out, tokens with the end) of every row."""
    return [(i, brute.crc_fold(i, 10) == 0, [*brute.SPACE_WORD.findall(brute.lower(t or "")), END]) for i, t in rows]


def bigrams(texts):
    pairs = Counter()
    for _, out, words in texts:
        if not out:
            pairs.update(zip([END, *words], words))
    return pairs


def best(word, of, pairs, end):
    """The first class of highest likelihood for a word, by trying all; its own unless another is better."""
    tried = [likelihood(pairs, {**of, word: c}) for c in range(end)]
    top = max(tried)
    if top <= tried[of[word]] + 1e-6:
        return of[word]
    return next(c for c, x in enumerate(tried) if x >= top - 1e-6)


def numbered(words, of, pairs, end):
    """The neighbours of words as the operator numbers them."""
    width, near = 2 * end + 3, Counter()
    at = {w: i for i, w in enumerate(words)}
    for (a, b), n in pairs.items():
        if a == b and a is not END:
            near[at[a] * width + width - 1] += n
        elif a != b:
            if a is not END:
                near[at[a] * width + of[b]] += n
            if b is not END:
                near[at[b] * width + end + 1 + of[a]] += n
    return np.array(sorted(near), np.int64), np.array([near[k] for k in sorted(near)], np.int64)


def matrix(pairs, of, end):
    g = np.zeros((end + 1, end + 1), np.int64)
    for (a, b), n in pairs.items():
        g[of[a], of[b]] += n
    return g


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("step", [1, classes.STEP])
def test_best_class_is_that_of_highest_likelihood(seed, step, monkeypatch):
    monkeypatch.setattr(classes, "STEP", step)
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(14)]
    pairs = bigrams([(i, False, [*rnd.choices(words, weights=range(1, 15), k=rnd.randint(0, 9)), END]) for i in range(12)])
    end = rnd.randint(1, 4)
    of = {w: rnd.randrange(end) for w in words} | {END: end}
    got = classes.best_classes(np.array([of[w] for w in words]), *numbered(words, of, pairs, end), matrix(pairs, of, end))
    assert got.tolist() == [best(w, of, pairs, end) for w in words]


def model_scores(rows, first, rounds, end):
    """score of every row, with sweeps by trying every class of every word."""
    texts = texts_of(rows)
    pairs, train = bigrams(texts), Counter(w for _, out, words in texts if not out for w in words)
    of = dict(first) | {END: end}
    for sweep in range(rounds):
        movers = [w for w in train if w is not END and tokens.word_hash(w.encode()) & 1 == sweep % 2]
        of |= {w: best(w, of, pairs, end) for w in movers}
    g, kinds = matrix(pairs, of, end), Counter(of[w] for w in train if w is not END)
    move = (g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * (end + 1))
    total, size = sum(train.values()), len(train)
    out = []
    for i, _, words in texts:
        value = 0.0
        for a, b in zip([END, *words], words):
            inside = 1.0 if b is END else (train[b] + 0.1) / (g[:, of[b]].sum() + 0.1 * (kinds[of[b]] + 1))
            value += math.log10(0.85 * move[of[a], of[b]] * inside + 0.15 * (train[b] + 0.1) / (total + 0.1 * (size + 1)))
        out.append((i, value))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run_bytes", [120, 1 << 20])
@pytest.mark.parametrize("rounds", [0, 3])
def test_scores_equal_a_plain_class_model(spark, run_bytes, rounds, monkeypatch):
    """Words beyond the items are moved too: two words and three endings are items, for thirty words."""
    monkeypatch.setattr(classes, "WORDS", 2)
    monkeypatch.setattr(classes, "ENDINGS", 3)
    rnd = random.Random(9)
    words = [f"{'ab'[k % 2]}{k}{'xyz'[k % 3]}" for k in range(30)]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 31), k=rnd.randint(0, 12)))) for i in range(25)]
    rows += [(25, None), (26, ""), (3, "Twice a0x a0x A0X"), (None, "a0x new words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    whole = classes.exchange

    def watched(counts, n):
        seen["of"] = whole(counts, n)
        return seen["of"]

    monkeypatch.setattr(classes, "exchange", watched)
    got = classes.score(docs, run_bytes=run_bytes, rounds=rounds, fewest=3).select("doc_id", "score").collect()
    texts = texts_of(rows)
    train = Counter(w for _, out, ws in texts if not out for w in ws if w is not END)
    top = sorted(train, key=lambda w: (-train[w], np.uint64(tokens.word_hash(w.encode())).view(np.int64)))[:2]
    rest = Counter()
    for w, n in train.items():
        rest[w.encode()[-2:].rjust(2, b"\0")] += 0 if w in top else n
    often = sorted((e for e in rest if rest[e]), key=lambda e: (-rest[e], e))[:3]
    items = sorted(top, key=lambda w: tokens.word_hash(w.encode())) + sorted(often)

    def place(w):
        e = w.encode()[-2:].rjust(2, b"\0")
        return items.index(w) if w in items[:2] else items.index(e) if e in items[2:] else len(items)
    first = {w: int(seen["of"][place(w)]) for _, _, ws in texts for w in ws if w is not END}
    want = model_scores(rows, first, rounds, int(seen["of"][-1]))
    got = sorted(((r["doc_id"], r["score"]) for r in got), key=repr)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert all(abs(x[1] - y[1]) < 1e-6 for x, y in zip(sorted(got, key=lambda r: (repr(r[0]), r[1])), sorted(want, key=lambda r: (repr(r[0]), r[1]))))


def test_sweeps_over_all_words_lower_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = lambda rounds: classes.score(docs, rounds=rounds).where("held_out").agg(F.sum("score")).first()[0]
    assert of(4) > of(0)


def test_packed_numbers():
    keys, n = np.array([0, 5, 6, 1 << 50], np.int64), np.array([1, 300, 7, 1 << 40], np.int64)
    for k, v in ((keys, n), (keys[:0], n[:0])):
        a, b = classes._unpacked(classes._packed(k, v))
        assert a.tolist() == k.tolist() and b.tolist() == v.tolist()


def test_few_logarithms_for_moves(monkeypatch):
    """Class bigrams without a word differ from those of all words in few cells; the others are looked up."""
    rnd = np.random.default_rng(3)
    end, words = 40, 3000
    width = 2 * end + 3
    g = rnd.integers(200, 900, (end + 1, end + 1))
    near = np.unique(rnd.integers(0, words, 12_000) * width + rnd.integers(0, 2 * end + 2, 12_000))
    seen, plain = 0, classes._xlogx

    def counted(x):
        nonlocal seen
        seen += np.size(x)
        return plain(x)

    monkeypatch.setattr(classes, "_xlogx", counted)
    classes.best_classes(rnd.integers(0, end, words), near, rnd.integers(1, 4, len(near)), g)
    assert seen < len(near) * end / 2


def test_order_of_numbers():
    rnd = np.random.default_rng(4)
    for n, shift in ((0, 0), (1, 0), (5000, 0), (5000, 40), (5000, 60)):
        x = rnd.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False) >> np.uint64(shift)
        close = x | (np.uint64(1) << np.uint64(63)) if shift else x   # They differ in their low bits only.
        for numbers in (x, close):
            assert (tokens.ascending(numbers) == np.argsort(numbers, kind="stable")).all()
            kinds, first, which = tokens.distinct(numbers)
            want = np.unique(numbers, return_index=True, return_inverse=True)
            assert all((a == b).all() for a, b in zip((kinds, first, which), want))
