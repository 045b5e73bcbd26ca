"""Scoring with a class-based bigram model.

    P(w | v) = P(class of w | class of v) * P(w | class of w), mixed with the smoothed unigram

Classes come from exchange clustering over all training words: a word moves to the class that raises
the likelihood of the class bigrams most. Every run of documents keeps its word bigrams as a table. In
a sweep a run joins them with the classes of its words and adds up each word's neighbours by class; the
task of a bucket of words sums that over the runs and moves its words, against the class matrix of all
training texts. Half of the words may move in a sweep, by a bit of their hash, so two neighbours seldom
move at once. Only the matrix of classes reaches the driver.

The sweeps start from classes of a bounded set of items: the most frequent words, and for all other
words their last two bytes. Words without training text keep that class.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import runs as R, tokens
from .tables import fold_of, materialize, shuffles_removed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHA = 0.1
#: Items that the first classes are found for, and sweeps over them.
WORDS, ENDINGS, SWEEPS = 500, 400, 12
#: Sweeps over all training words; each half of them moves in every second one.
ROUNDS = 4
#: Classes grow with the fourth root of the distinct training words, within these bounds; a class is a byte.
FEWEST, MOST = 24, 255
#: Numbers of a step that weighs moves: neighbours by class, times classes.
STEP = 1 << 18
#: Bytes of a row group of the tables between the sweeps, whose rows hold many words.
GROUP = 8 << 20
#: Weight of the class model beside the unigram.
MIX = 0.85
LOWEST = -(1 << 63)
OUT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
       "score double, perplexity double")


def _words(column, at: int, rows: int):
    """(hash, ending, first word of each text) of a part of a column."""
    data, offsets = tokens.flat(column.slice(at, rows))
    data = tokens.LOWER[data]
    starts, ends, first = tokens.words(data, offsets, tokens.SPACE)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return tokens.word_hashes(data, starts, ends), before * 256 + last, first


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending distinct numbers and their counts, compressed."""
    step = np.diff(keys, prepend=0).astype(np.uint64)
    raw = len(keys).to_bytes(8, "little") + R.pack(step) + R.pack(counts.astype(np.uint64))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)
    cut = 8 + 8 * int.from_bytes(raw[:8], "little")
    return np.cumsum(R.unpack(raw[8:cut]).astype(np.int64)), R.unpack(raw[cut:]).astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    order = tokens.ascending(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begins], np.add.reduceat(counts[order], begins) if len(begins) else np.zeros(0, np.int64)


def _asked(buckets: int):
    """R.ASKED rows of a run: its distinct words by bucket, with (training count, ending) beside each; and in bucket -1 its
    word bigrams as pairs of places among those words, with where each bucket begins. The end of a text is one place more."""
    def run(table: pa.Table) -> pa.Table:
        column, train = table.column("text").combine_chunks(), ~table.column("held").to_numpy()
        parts = [_words(column, at, rows) for at, rows in tokens.pieces(column)]
        h = np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in parts)])
        ending = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)])
        first = np.concatenate([[0], *(np.diff(x[2]) for x in parts)]).cumsum()
        del parts
        known, place, back = tokens.distinct(h)
        ending, size = ending[place], len(known) + 1
        del h, place
        seq, before, text, word = _sequence(back, first, len(known))
        own = train[text]
        total = np.bincount(seq[own & word], minlength=len(known))
        keys, n = np.unique((before * size + seq)[own], return_counts=True)
        at = R.by_bucket(known, buckets)
        full = np.flatnonzero(np.diff(at))
        beside = np.stack([total, ending], axis=1).astype(np.int64)
        number = table.column("run")[0].as_py()
        return pa.table({
            "run": pa.array([number] * (len(full) + 1), pa.int32()), "bucket": pa.array([*full, -1], pa.int32()),
            "hashes": pa.array([*(R.pack(known[at[k]:at[k + 1]]) for k in full), at.astype(np.int64).tobytes()], pa.binary()),
            "extra": pa.array([*(beside[at[k]:at[k + 1]].tobytes() for k in full), _packed(keys, n)], pa.binary())})

    return run


def _merged(hashes, extras):
    """(order, begins, distinct hashes, their training counts, their endings) of a bucket's blocks."""
    order, _, begins = R.merged(hashes)
    beside = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in extras])[order]
    return order, begins, np.concatenate(hashes)[order][begins], np.add.reduceat(beside[:, 0], begins), beside[begins, 1]


def _back(values, order, begins, hashes):
    """A value for each distinct word of a bucket, for the words of every run."""
    return R.split_back(np.repeat(values, np.diff(np.append(begins, len(order)))), order, hashes)


def _summary(words: int):
    """what, key, ending, n, v of a bucket: its most frequent words (what 0) and all endings (what 1)."""
    def summary(table: pa.Table) -> pa.Table:
        _, _, kind, total, ending = _merged([R.unpack(x.as_py()) for x in table.column("hashes")],
                                            [x.as_py() for x in table.column("extra")])
        seen = total > 0
        top = np.lexsort((kind, -total))[:words]
        top = top[total[top] > 0]
        codes, at = np.unique(ending[seen], return_inverse=True)
        n = np.bincount(at, weights=total[seen], minlength=len(codes))
        v = np.bincount(at, minlength=len(codes))
        col = lambda *xs: pa.array(np.concatenate(xs).astype(np.int64))
        return pa.table({"what": col(np.zeros(len(top)), np.ones(len(codes))), "key": col(kind[top].view(np.int64), codes),
                         "ending": col(ending[top], codes), "n": col(total[top], n), "v": col(np.ones(len(top)), v)})

    return summary


@dataclass(frozen=True)
class Items:
    """word hashes (sorted) and endings (sorted) that are items; numbers: words, then endings, then other, then the end."""

    words: np.ndarray
    endings: np.ndarray

    @property
    def end(self) -> int:
        return len(self.words) + len(self.endings) + 1

    def of_ending(self, ending: np.ndarray) -> np.ndarray:
        out = np.full(len(ending), self.end - 1)
        if len(self.endings):
            at = np.minimum(np.searchsorted(self.endings, ending), len(self.endings) - 1)
            out = np.where(self.endings[at] == ending, len(self.words) + at, out)
        return out

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = self.of_ending(ending)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, at, out)
        return out


def _sequence(items: np.ndarray, first: np.ndarray, end: int):
    """(item, item before, text, whether a word) of all tokens in order, each text with its end."""
    texts = len(first) - 1
    n = np.diff(first)
    place = np.arange(len(items)) + np.repeat(np.arange(texts), n)
    seq = np.full(len(items) + texts, end)
    seq[place] = items
    word = np.zeros(len(seq), bool)
    word[place] = True
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[:1] = end  # a text begins after the end of another
    return seq, before, np.repeat(np.arange(texts), n + 1), word


def _neighbours(end: int, vectors: bool):
    """From the bigrams of a run and a class for each of its words: R.ASKED rows, one with the run's class bigrams (bucket -1)
    and, if asked for, one a bucket with each word's class (hashes) and its neighbours by class (extra).

    A neighbour's number is place * (2 * end + 3) + code: the class that follows, end + 1 + the class before, or
    2 * end + 2 for the word itself. ``end`` is the class of the end of a text, the last one.
    """
    width = 2 * end + 3

    def run(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        edges = np.frombuffer(pairs.column("hashes")[0].as_py(), np.int64)
        keys, n = _unpacked(pairs.column("extra")[0].as_py())
        replies = replies.sort_by("bucket")
        own = np.concatenate([np.frombuffer(b"".join(x.as_py() for x in replies.column("answer")), np.int64) & 0xFFFF, [end]])
        a, b = keys // len(own), keys % len(own)
        numbers, hashes, extras = [-1], [b""], [_packed(*_added(own[a] * (end + 1) + own[b], n))]
        if vectors:
            same, last = a == b, len(own) - 1
            right, left = ~same & (a < last), ~same & (b < last)
            alone = same & (a < last)
            near, count = _added(np.concatenate([a[right] * width + own[b[right]], b[left] * width + end + 1 + own[a[left]],
                                                 a[alone] * width + width - 1]), np.concatenate([n[right], n[left], n[alone]]))
            at = np.searchsorted(near, edges * width)
            for k in np.flatnonzero(np.diff(edges)):
                numbers.append(int(k))
                hashes.append(own[edges[k]:edges[k + 1]].astype(np.int16).tobytes())
                extras.append(_packed(near[at[k]:at[k + 1]] - edges[k] * width, count[at[k]:at[k + 1]]))
        return pa.table({"run": pa.array([pairs.column("run")[0].as_py()] * len(numbers), pa.int32()),
                         "bucket": pa.array(numbers, pa.int32()), "hashes": pa.array(hashes, pa.binary()),
                         "extra": pa.array(extras, pa.binary())})

    return run


def _joined(blocks: DataFrame, answers: DataFrame, end: int, vectors: bool) -> DataFrame:
    return blocks.where("bucket = -1").groupBy("run").cogroup(answers.where("run >= 0").groupBy("run")).applyInArrow(
        _neighbours(end, vectors), R.ASKED)


def _matrix(joined: DataFrame, end: int) -> np.ndarray:
    """Class bigrams of all training texts, (end + 1) squared of them."""
    def entries(batches):
        for batch in batches:
            for x in batch.column("extra"):
                keys, n = _unpacked(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["k", "n"])

    rows = joined.where("bucket = -1").select("extra").mapInArrow(entries, "k bigint, n bigint")
    rows = rows.groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    g = np.zeros((end + 1) ** 2, np.int64)
    g[rows["k"].to_numpy(np.int64)] = rows["n"]
    return g.reshape(end + 1, end + 1)


def best_classes(own: np.ndarray, near: np.ndarray, count: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The class each word would best be in, all others staying: :func:`exchange`'s gain, worked out over a word's neighbours.

    ``near`` and ``count`` are the words' neighbours by class as :func:`_neighbours` numbers them, ``g`` the class bigrams.
    A word without neighbours, or without a better class by a millionth, stays.
    """
    end = len(g) - 1
    width, out = 2 * end + 3, own.copy()
    g = g.astype(np.float64)
    row_sum, col_sum = g.sum(1), g.sum(0)
    # What n more tokens add to a class bigram is looked up for small n, but for the word's own class.
    small = np.arange(max(1, min(32, 4 * STEP // (end + 1) ** 2)) + 1)
    sides = [(table, _xlogx(table), _xlogx(table[:end].T[:, None] + small[:, None]) - _xlogx(table[:end].T[:, None]))
             for table in (g, np.ascontiguousarray(g.T))]
    sums = [(total[:end], _xlogx(total[:end]), _xlogx(total[:end] + small[:, None]) - _xlogx(total[:end]))
            for total in (row_sum, col_sum)]
    starts = np.searchsorted(near, np.arange(len(own) + 1) * width)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + STEP // (end + 1), "right")) - 1)
        part = slice(starts[at], starts[to])
        word, code = near[part] // width - at, near[part] % width
        mine, words = own[at:to], np.arange(to - at)
        dense = np.bincount(word * width + code, weights=count[part], minlength=(to - at) * width).reshape(-1, width)
        right, left, alone = dense[:, :end + 1], dense[:, end + 1:width - 1], dense[:, -1]
        gain = np.zeros((to - at, end))
        for (table, plain, added), side, back in zip(sides, (right, left), (left, right)):
            w, d = np.nonzero(side)
            n, o = side[w, d], mine[w]
            more = added[d, np.minimum(n, small[-1]).astype(np.int64)]
            often = np.flatnonzero(n > small[-1])
            more[often] = _xlogx(table[:end, d[often]].T + n[often, None]) - plain[:end, d[often]].T
            # Class bigrams without the word: of its own class with d, and of every class with its own.
            more[np.arange(len(w)), o] = plain[o, d] - _xlogx(table[o, d] - n)
            inner = np.flatnonzero(d == o)
            cell = table[:end, d[inner]].T.copy()
            cell[np.arange(len(inner)), o[inner]] -= n[inner] + alone[w[inner]]
            cell -= back[w[inner], :end]
            more[inner] = _xlogx(cell + n[inner, None]) - _xlogx(cell)
            begins = np.flatnonzero(np.diff(w, prepend=-1))
            if len(begins):
                gain[w[begins]] += np.add.reduceat(more, begins, axis=0)
        # The cell of a class with itself gets both sides and the word after itself, once.
        # That is nothing for a class on one side only.
        w, c = np.nonzero((right[:, :end] > 0) & (left[:, :end] > 0) | (alone > 0)[:, None])
        r, l, s = right[w, c], left[w, c], alone[w]
        diagonal = g[c, c] - np.where(c == mine[w], r + l + s, 0)
        gain[w, c] += _xlogx(diagonal + r + l + s) - _xlogx(diagonal + r) - _xlogx(diagonal + l) + _xlogx(diagonal)
        for (total, plain, added), n in zip(sums, (right.sum(1) + alone, left.sum(1) + alone)):
            more = added[np.minimum(n, small[-1]).astype(np.int64)]
            often = np.flatnonzero(n > small[-1])
            more[often] = _xlogx(total + n[often, None]) - plain
            more[words, mine] = plain[mine] - _xlogx(total[mine] - n)
            gain -= more
        best = np.argmax(np.round(gain, 6), axis=1)
        moves = gain[words, best] > gain[words, mine] + 1e-6
        out[at:to] = np.where(moves, best, mine)
        at = to
    return out


def _moved(sweep: int, g: np.ndarray):
    """R.ANSWER rows of a bucket: training count * 65536 + class of each run's words after the sweep, and as run -1 how many
    distinct training words each class has."""
    end = len(g) - 1
    width = 2 * end + 3

    def bucket(blocks: pa.Table, vectors: pa.Table) -> pa.Table:
        blocks, vectors = blocks.sort_by("run"), vectors.sort_by("run")
        hashes = [R.unpack(x.as_py()) for x in blocks.column("hashes")]
        order, begins, kind, total, _ = _merged(hashes, [x.as_py() for x in blocks.column("extra")])
        own = np.concatenate([np.frombuffer(x.as_py(), np.int16) for x in vectors.column("hashes")])[order][begins].astype(np.int64)
        places = _back(np.arange(len(begins)), order, begins, hashes)
        near, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, x in zip(places, vectors.column("extra")):
            keys, n = _unpacked(x.as_py())
            near.append(place[keys // width] * width + keys % width)
            count.append(n)
        near, count = _added(np.concatenate(near), np.concatenate(count))
        turn = (kind & np.uint64(1)) == np.uint64(sweep % 2)
        mine = turn[near // width]
        own = np.where(turn, best_classes(own, near[mine], count[mine], g), own)
        found = _back(total * 65536 + own, order, begins, hashes)
        found.append(np.bincount(own[total > 0], minlength=end).astype(np.int64))
        return pa.table({"run": pa.array([*blocks.column("run").to_pylist(), -1], pa.int32()),
                         "bucket": pa.array([blocks.column("bucket")[0].as_py()] * len(found), pa.int32()),
                         "answer": pa.array([x.tobytes() for x in found], pa.binary())})

    return bucket


def _first_classes(items: "Items", of: np.ndarray, end: int):
    """The answer of a bucket: training count * 65536 + the class of each run's words by their items."""
    def answer(numbers, hashes, extras):
        order, begins, kind, total, ending = _merged(hashes, extras)
        own = of[items.of(kind, ending)]
        return [*_back(total * 65536 + own, order, begins, hashes), np.bincount(own[total > 0], minlength=end).astype(np.int64)]

    return answer


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(counts: np.ndarray, classes: int = FEWEST, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item; the last item, the end of a text, is alone in the last class.

    Starts from items dealt round by frequency. An item leaves its class and joins the one that
    maximises sum n(c, d) log n(c, d) - sum n(c) log n(c) over both sides, until no item moves.
    """
    size = len(counts)
    counts = counts.astype(np.float64)
    weight = counts.sum(0) + counts.sum(1)
    order = np.lexsort((np.arange(size - 1), -weight[:-1]))
    classes = max(1, min(classes, size - 1))
    of = np.empty(size, np.int64)
    of[order] = np.arange(size - 1) % classes
    of[-1] = classes
    put = np.eye(classes + 1)[of]
    g = put.T @ counts @ put
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            own = of[w]
            right = np.bincount(of, weights=counts[w], minlength=classes + 1)
            left = np.bincount(of, weights=counts[:, w], minlength=classes + 1)
            self_n = counts[w, w]
            right[own] -= self_n
            left[own] -= self_n
            g[own] -= right
            g[:, own] -= left
            g[own, own] -= self_n
            row, col = g.sum(1) + left, g.sum(0) + right  # the partners' own totals do not depend on the class
            n_right, n_left = right.sum() + self_n, left.sum() + self_n
            gain = (_xlogx(g + right) - _xlogx(g)).sum(1) + (_xlogx(g.T + left) - _xlogx(g.T)).sum(1)
            d = np.diag(g)
            # The cell of a class with itself gets both sides and the item after itself, once.
            gain += _xlogx(d + right + left + self_n) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            gain -= _xlogx(row + n_right) - _xlogx(row) + _xlogx(col + n_left) - _xlogx(col)
            best = int(np.argmax(gain[:classes]))
            best = own if gain[own] >= gain[best] - 1e-9 else best
            g[best] += right
            g[:, best] += left
            g[best, best] += self_n
            moved += best != own
            of[w] = best
        if not moved:
            break
    return of


def _numbered(batches):
    """c, v: the numbers of the answers of run -1, each with its place."""
    for batch in batches:
        for x in batch.column("answer"):
            v = np.frombuffer(x.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["c", "v"])


def score(docs: DataFrame, run_bytes: int = R.RUN_BYTES, rounds: int = ROUNDS, fewest: int = FEWEST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    A null or empty text is its end only. Texts whose crc32(id as text) mod 10 is 0 are held out: they
    are scored but teach nothing. Without training texts every token has base probability 1. Ids
    may repeat and be null (a null id hashes as empty text). Words are told apart by a 64-bit hash. A text of
    any length is one text, held by one task with about 40 bytes for every word. Other columns are not read.
    """
    held = (fold_of("doc_id", 10) == 0).alias("held")
    runs = R.into_runs(docs.select("doc_id", "text"), held, run_bytes=run_bytes)
    with shuffles_removed(docs.sparkSession):
        # A run has about one distinct word for every 60 bytes, and several neighbours of each.
        buckets = runs.buckets(runs.n_bytes / 8)
        blocks = materialize(runs.rows.groupBy("run").applyInArrow(_asked(buckets), R.ASKED), "word-blocks", GROUP)
        words = blocks.where("bucket >= 0")
        model = materialize(words.groupBy("bucket").applyInArrow(
            _summary(WORDS), "what bigint, key bigint, ending bigint, n bigint, v bigint"), "word-counts")
        top = model.where("what = 0").orderBy(F.desc("n"), "key").limit(WORDS).toPandas()
        # At most 65 536 endings.
        endings = model.where("what = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
        texts = docs.select("doc_id").where(fold_of("doc_id", 10) != 0).count()
        train_tokens, kinds = int(endings["n"].sum()) + texts, int(endings["v"].sum()) + (texts > 0)

        # Endings count the words that are no items of their own.
        n_of = np.zeros(1 << 16, np.int64)
        n_of[endings["key"]] = endings["n"]
        np.subtract.at(n_of, top["ending"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
        often = np.lexsort((np.arange(1 << 16), -n_of))[:ENDINGS]
        hashes = top["key"].to_numpy(np.int64).view(np.uint64)
        items = Items(np.sort(hashes), np.sort(often[n_of[often] > 0]))
        as_items = R.answered(words, _first_classes(items, np.arange(items.end + 1), items.end + 1), more=-1)
        of = exchange(_matrix(_joined(blocks, as_items, items.end, False), items.end), min(MOST, max(fewest, int(np.ceil(kinds ** 0.25)))))
        end = int(of[-1])

        answers = materialize(R.answered(words, _first_classes(items, of, end), more=-1), "word-classes", GROUP)
        for sweep in range(rounds):
            vectors = materialize(_joined(blocks, answers, end, True), "word-neighbours", GROUP)
            g = _matrix(vectors, end)
            answers = materialize(words.groupBy("bucket").cogroup(vectors.where("bucket >= 0").groupBy("bucket")).applyInArrow(
                _moved(sweep, g), R.ANSWER), "word-classes", GROUP)
        g = _matrix(_joined(blocks, answers, end, False), end)
        tokens_of, kinds_of = g.sum(0).astype(np.float64), np.zeros(end + 1)
        # A row for each bucket, of one number a class.
        in_class = answers.where("run = -1").select("answer").mapInArrow(_numbered, "c int, v bigint")
        in_class = in_class.groupBy("c").agg(F.sum("v").alias("v")).toPandas()
        kinds_of[in_class["c"]] = in_class["v"]
    move = (g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * (end + 1))
    emit = tokens_of + ALPHA * (kinds_of + 1)
    below = train_tokens + ALPHA * (kinds + 1)

    def use(table: pa.Table, replies: bytes) -> pa.Table:
        column, out, at = table.column("text").combine_chunks(), [], 0
        parts = [_words(column, *part)[::2] for part in tokens.pieces(column)]
        back = tokens.distinct(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]))[2]
        parts = [first for _, first in parts]
        seen = np.frombuffer(replies, np.int64)
        for first in parts:
            rows, found = len(first) - 1, seen[back[at:at + first[-1]]]
            at += first[-1]
            n = found >> 16
            seq, before, text, word = _sequence(found & 0xFFFF, first, end)
            c = np.full(len(seq), texts, np.int64)
            c[word] = n
            base = (c + ALPHA) / below
            inside = np.where(word, (c + ALPHA) / emit[seq], 1.0)
            mixed = MIX * move[before, seq] * inside + (1 - MIX) * base
            total = lambda x: np.bincount(text, weights=x, minlength=rows)
            out.append((total(np.ones(len(seq))), total(c > 0), total(np.log10(base)), total(np.log10(mixed))))
        n, k, base, mixed = (np.concatenate([x[i] for x in out]) for i in range(4))
        ids = [None if i == LOWEST else i for i in table.column("doc_id").to_pylist()]
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": table.column("held"), "n_tokens": whole(n), "n_known": whole(k),
            "train_tokens": pa.array(np.full(len(n), train_tokens, np.int64)), "base_score": pa.array(base),
            "score": pa.array(mixed), "perplexity": pa.array(10 ** np.minimum(300, -mixed / n))})

    return R.used(runs, answers.where("run >= 0"), use, OUT)


def op10_brown_class_bigrams(docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
