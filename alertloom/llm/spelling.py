"""Spelling variants found by search schemes on FM-indexes of the vocabulary.

Two words at one edit agree exactly in one half of either of them. So a word is searched twice: its
right half exactly and then leftwards over the left half with one error, and, on the index of the
reversed words, its left half exactly and then over the right half. Both searches are backward
searches from the delimiter: a state is an interval of suffix ranks, the exact half narrows it, and
from then on each step may spend the error on another letter, a letter more or a letter less.

Words meet by the half that is exact: a task holds the words that end (or begin) with the halves of
its searches, at most one letter shorter or longer. Halves that very many words have are dealt out
in blocks of words, and every search of the half visits each block.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT, RATIO, DELETED = 6, 5, 5, 199
#: Distinct words that a task counts before it hands them on; code points of words in one index.
COUNTED, INDEXED = 1 << 18, 1 << 19

# -----------------------------------------------------------------------------------------------
# Words
# -----------------------------------------------------------------------------------------------


def counted_words(least_length: int, deleted: int, step: int = 1 << 20):
    """mapInArrow over doc_id, text: (word, n) as the task has them; equal words may come more than once."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    run_of = re.compile("[a-zÀ-ÿ]+")

    def handed(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]):
        counts: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # bytes.lower() changes A to Z only.
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                own: dict[str, int] = {}
                for found in run_of.finditer(text) if len(text) > step else run_of.findall(text):
                    word = found if isinstance(found, str) else found[0]
                    own[word] = own.get(word, 0) + 1
                for word, n in own.items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % deleted == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield handed(counts)
                    counts = {}
        if counts:
            yield handed(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted: int = DELETED) -> DataFrame:
    """``word, n``: runs of letters after the deletions of :func:`op12_fm_spelling`, of so many code points and occurrences.

    A null id counts as the empty text, a null text has no words.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(counted_words(least_length, deleted), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -----------------------------------------------------------------------------------------------
# The index and the search, over all searches of a task at once
# -----------------------------------------------------------------------------------------------
class Index:
    """FM-index of a list of distinct words: delimited, suffixes ranked, each with the letter before it.

    ``before`` is the Burrows-Wheeler transform, with 0 where a word begins; ``back`` the rank of the suffix one letter longer.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """``codes``: letters of all words without delimiters, as numbers from 1; ``sizes``: letters in each word."""
        words, total = len(sizes), len(codes) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[ends] = False
        text[inside] = codes
        self.word = np.repeat(np.arange(words), sizes + 1)
        # Ranks by the first letters, twice as many each round, until they reach past every word's end.
        rank, span = text, 1
        left = np.repeat(ends, sizes + 1) - np.arange(total)  # letters before the delimiter
        longest = int(sizes.max()) + 1 if words else 0
        while span < longest:
            far = np.zeros(total, np.int64)
            here = np.flatnonzero(left >= span)
            far[here] = rank[here + span] + 1
            order = np.lexsort((far, rank))
            new = np.ones(total, np.int64)
            new[1:] = (rank[order][1:] != rank[order][:-1]) | (far[order][1:] != far[order][:-1])
            rank = np.empty(total, np.int64)
            rank[order] = np.cumsum(new)
            span *= 2
        # Equal suffixes in the order of their words, so that longer ones keep it.
        self.suffix = np.argsort(rank, kind="stable")
        place = np.empty(total, np.int64)
        place[self.suffix] = np.arange(total)
        starts = np.concatenate([[0], ends[:-1] + 1]) if words else np.zeros(0, np.int64)
        first = np.zeros(total, bool)
        first[starts] = True
        before, back = np.zeros(total, np.int64), np.zeros(total, np.int64)
        later = np.flatnonzero(~first)
        before[later], back[later] = text[later - 1], place[later - 1]
        self.before, self.back = before[self.suffix], back[self.suffix]
        self.size, self.words = total, words
        by_letter = np.argsort(self.before, kind="stable")
        #: letter and rank of every place of the transform, ascending: how often a letter comes before a rank is a search.
        self.key = self.before[by_letter] * (total + 1) + by_letter
        self.back_of = self.back[by_letter]
        begins = self.before == 0
        self.begins = np.concatenate([[0], np.cumsum(begins)])
        self.begun = self.word[self.suffix[begins]]

    def step(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray):
        """Intervals of the suffixes one letter longer; empty ones have low == high."""
        at = letter * (self.size + 1)
        i, j = np.searchsorted(self.key, at + low), np.searchsorted(self.key, at + high)
        some = j > i
        start = np.where(some, self.back_of[np.minimum(i, self.size - 1)], 0)
        return start, start + np.where(some, j - i, 0)

    def children(self, low: np.ndarray, high: np.ndarray):
        """(interval number, letter, low, high) for every letter before some suffix of disjoint intervals."""
        many = high - low
        own = np.repeat(np.arange(len(low)), many)
        at = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        letter, back = self.before[at], self.back[at]
        keep = letter > 0
        own, letter, back = own[keep], letter[keep], back[keep]
        order = np.lexsort((back, letter, own))
        own, letter, back = own[order], letter[order], back[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (letter[1:] != letter[:-1])
        start = np.flatnonzero(new)
        return own[start], letter[start], back[start], back[start] + np.diff(np.append(start, len(own)))


def one_error(index: Index, codes: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(search, word of the index) at exactly one edit that lies before the last ``exact`` letters, each once.

    ``codes``: letters of the searches, 0 where the index lacks them (as numbers that no word has).
    """
    starts = np.cumsum(sizes) - sizes
    found_q, found_w = [], []
    q = np.arange(len(sizes))
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.words)  # all suffixes that are the delimiter
    # States that have spent the error: search, letters still to match, interval.
    eq, ep, el, eh = (np.zeros(0, np.int64) for _ in range(4))

    def moved(q, p, low, high):
        """One letter on for states of searches q with p letters left; those that end or die go."""
        done = p == 0
        if done.any():
            a, b = index.begins[low[done]], index.begins[high[done]]
            hit = b > a  # one word: the interval is a whole word between delimiters
            found_q.append(q[done][hit])
            found_w.append(index.begun[a[hit]])
            q, p, low, high = q[~done], p[~done], low[~done], high[~done]
        l2, h2 = index.step(low, high, codes[starts[q] + p - 1])
        live = h2 > l2
        return q[live], p[live] - 1, l2[live], h2[live]

    depth = 0
    while len(q) or len(eq):
        if len(eq):
            eq, ep, el, eh = moved(eq, ep, el, eh)
        p = sizes[q] - depth
        free = depth >= exact[q]
        if free.any():
            fq, fp, fl, fh = q[free], p[free], low[free], high[free]
            spans, own = np.unique(np.stack([fl, fh], 1), axis=0, return_inverse=True)
            own = own.reshape(-1)
            node, letter, cl, ch = index.children(spans[:, 0], spans[:, 1])
            begin = np.searchsorted(node, np.arange(len(spans) + 1))
            times = begin[own + 1] - begin[own]
            at = np.repeat(np.arange(len(fq)), times)
            child = np.repeat(begin[own] - (np.cumsum(times) - times), times) + np.arange(len(at))
            nq, np_, nc = fq[at], fp[at], letter[child]
            mine = np.where(np_ > 0, codes[np.minimum(starts[nq] + np.maximum(np_, 1) - 1, len(codes) - 1)], -1)
            other = nc != mine
            swap = other & (np_ > 0)
            # A letter less: of equal neighbours the first one. A letter more: left of those equal to it.
            last = codes[starts[fq] + np.maximum(fp, 1) - 1]
            prior = np.where(fp > 1, codes[starts[fq] + np.maximum(fp, 2) - 2], -1)
            less = (fp > 0) & (last != prior)
            eq = np.concatenate([eq, nq[swap], nq[other], fq[less]])
            ep = np.concatenate([ep, np_[swap] - 1, np_[other], fp[less] - 1])
            el = np.concatenate([el, cl[child][swap], cl[child][other], fl[less]])
            eh = np.concatenate([eh, ch[child][swap], ch[child][other], fh[less]])
        more = p > 0
        q, low, high = q[more], low[more], high[more]
        if len(q):
            low, high = index.step(low, high, codes[starts[q] + p[more] - 1])
            live = high > low
            q, low, high = q[live], low[live], high[live]
        depth += 1
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), sizes


FOUND = "word string, n_near bigint, best struct<n:bigint,word:string>"


def search_group(table: pa.Table) -> pa.Table:
    """FOUND rows of the searches of a task: side, word, n, asks, held (a search, a word of the index, or both)."""
    side = table.column("side")[0].as_py()
    merged: dict[str, list] = {}
    for word, n, asks, held in zip(*(table.column(c).to_pylist() for c in ("word", "n", "asks", "held"))):
        own = merged.setdefault(word, [n, False, False])
        own[1], own[2] = own[1] or asks, own[2] or held
    index_words = sorted(w for w, (_, _, held) in merged.items() if held)
    searches = [w for w, (_, asks, _) in merged.items() if asks]
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()),
                        ("best", pa.struct([("n", pa.int64()), ("word", pa.string())]))])
    if not index_words or not searches:
        return schema.empty_table()
    turned = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
    held_codes, held_sizes = _letters([turned(w) for w in index_words])
    codes, sizes = _letters([turned(w) for w in searches])
    letters = np.unique(held_codes)
    index = Index(np.searchsorted(letters, held_codes) + 1, held_sizes)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    codes = np.where(letters[at] == codes, at + 1, len(letters) + 1 + codes)
    half = sizes // 2
    q, w = one_error(index, codes, sizes, half if side == 0 else sizes - half)
    counts = np.fromiter((merged[x][0] for x in index_words), np.int64, len(index_words))
    if side:
        # What begins with the left half as well is the other search's.
        both = np.fromiter((index_words[b].startswith(searches[a][:half[a]]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
        q, w = q[~both], w[~both]
    # Words of the index are in code-point order, so the least number is the smallest word.
    order = np.lexsort((w, -counts[w], q))
    q, w = q[order], w[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    best = w[start]
    return pa.table({
        "word": pa.array([searches[i] for i in q[start]], pa.string()),
        "n_near": pa.array(np.diff(np.append(start, len(q))), pa.int64()),
        "best": pa.array([{"n": int(counts[i]), "word": index_words[i]} for i in best], schema.field("best").type)}, schema)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, indexed: int = INDEXED) -> DataFrame:
    """FOUND rows: for every word of ``words`` (word, n) with near words how many, and the one of largest n (then smallest).

    Near is one inserted, deleted or replaced code point. ``words`` are distinct, of ``least_length`` (4 at least) or more.
    """
    if least_length < 4:
        raise ValueError("a word of less than four code points has no half to search by")
    size = F.length("word")
    # The searches of a half belong to one length; a word is held for the lengths around its own.
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda m: m >= least_length)
    sides = F.array(*(F.lit(s) for s in (0, 1)))
    roles = words.select("word", "n", size.alias("size"), F.explode(lengths).alias("m")).select("*", F.explode(sides).alias("side"))
    half = F.floor(F.col("m") / 2).cast("int")
    begin = F.when(F.col("side") == 0, 1).otherwise(F.col("size") - (F.col("m") - half) + 1)
    exact = F.col("word").substr(begin, F.when(F.col("side") == 0, half).otherwise(F.col("m") - half))
    roles = roles.select("word", "n", "size", "side", (F.col("m") == F.col("size")).alias("asks"),
                         F.xxhash64("side", "m", exact.alias("h")).alias("key"))
    roles = materialize(roles, "spelling-roles")
    weights = roles.groupBy("key").agg(F.sum(F.col("size") + 1).alias("cps"))
    total = roles.agg(F.coalesce(F.sum(F.col("size") + 1), F.lit(0)).alias("t")).first()["t"]
    groups = max(1, math.ceil(total / indexed))
    hot = weights.where(F.col("cps") > indexed).select("key", F.ceil(F.col("cps") / indexed).cast("int").alias("blocks"))
    marked = roles.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # A group of its own for each block of a frequent half, of which a word is held by one and asked for in all.
    block = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).when(
        F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    dealt = marked.withColumn("own", own).withColumn("block", block)
    group = F.when(F.col("block") < 0, F.struct(F.pmod("key", F.lit(groups)).alias("a"), F.lit(-1).alias("b"))).otherwise(
        F.struct(F.col("key").alias("a"), F.col("block").alias("b")))
    held = (F.col("block") < 0) | (F.col("block") == F.col("own"))
    found = dealt.select("side", group.alias("g"), "word", "n", "asks", held.alias("held")).groupBy("side", "g").applyInArrow(
        search_group, FOUND)
    better = F.max(F.struct(F.col("best.n").alias("n"), _descending(F.col("best.word")).alias("d"), F.col("best.word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), better.alias("b")).select(
        "word", "n_near", F.struct("b.n", "b.word").alias("best"))


def _descending(word: Column) -> Column:
    """A key that is larger for words smaller in code-point order."""
    # Hex digits of the bytes with every digit turned, closed by a digit above all: a shorter beginning is larger.
    return F.concat(F.translate(F.hex(F.encode(word, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def variants(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, indexed: int = INDEXED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary ``words`` (word, n; distinct words).

    A word's form is its most frequent near word, if that is ``ratio`` (2 at least) times as frequent; the root is where
    forms lead. As counts grow by ``ratio`` with each form, following twice as far in each round ends after few.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    near = near_words(words, least_length, indexed)
    formed = F.col("best.n") >= ratio * F.col("n")
    named = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")), "spelling-forms")
    links = materialize(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    most = named.agg(F.max("n").alias("m"), F.min("n").alias("l")).first()
    steps = math.ceil(math.log((most["m"] or 1) / (most["l"] or 1), ratio)) + 1 if most["m"] else 1
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-links")
    return named.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_fm_spelling(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lower-cased; where 199 divides
    crc32("<doc_id>:<run>"), the code point at that number modulo the length is left out. They have 6 code points and 5
    occurrences at least. A null id counts as the empty text; null and empty texts have no words; repeated rows count
    again; other columns are ignored; an empty table gives no rows. Near words of equal n: the smallest in code-point
    order. Texts are read in one pass whatever their length; words of any length are indexed whole.
    """
    return variants(vocabulary(docs))
