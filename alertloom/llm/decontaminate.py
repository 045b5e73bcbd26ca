"""Benchmark decontamination with a positional inverted index of the training texts.

The index is one table. A row is a segment of texts: for each term the sorted positions at which it
stands, the terms' lists one after the other. Positions of two texts are at least one apart, so no
list of consecutive positions crosses texts. A phrase is found segment by segment: from the list
of its rarest term, moved back by the term's offset, and intersected with the next rarer
ones until it is empty or all terms agree. Segments are independent, so a query is a scan.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import tokens
from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
#: Bytes of text in a segment, or one text if it is longer.
SEGMENT = 1 << 20
#: Terms of the queries up to which the index leaves other terms out; with more it keeps every term.
MAX_TERMS = 2_000_000
#: Bytes of a row group of the stored index; a scan holds a row group of it, and not all segments of a file, at once.
INDEX_GROUP = 4 << 20
#: Query items that one scan of the index looks for.
BLOCK = 5_000

SEGMENTS = ("doc_ids array<bigint>, k1 array<bigint>, k2 array<bigint>, n_words array<bigint>, places array<bigint>, terms binary, ends binary, postings binary")


@dataclass(frozen=True)
class Phrases:
    """Windows of query items: rows of term hashes with a length, rarest term first by ``order``."""

    items: tuple            # item id of each item
    item: np.ndarray        # item index of each window
    terms: np.ndarray       # hashes, windows x longest
    length: np.ndarray
    order: np.ndarray       # places of a window's terms from the rarest on


def _item_words(text: str | None) -> np.ndarray:
    raw = tokens.LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, ends, _ = tokens.words(raw, np.array([0, len(raw)]), tokens.NOT_ALNUM)
    return tokens.word_hashes(raw, starts, ends)


def _term_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a segment's texts, and the words of each text; hashing holds one piece at a time."""
    hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, rows in tokens.pieces(column, tokens.SMALL_PIECE):
        data, offsets = tokens.flat(column.slice(at, rows))
        data = tokens.LOWER[data]
        starts, ends, first = tokens.words(data, offsets, tokens.NOT_ALNUM)
        hashes.append(tokens.word_hashes(data, starts, ends))
        n.append(np.diff(first))
    return np.concatenate(hashes), np.concatenate(n)


def _text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text; a null text is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The index of doc_id, text; with a vocabulary of term hashes, only of those terms.

    ``segment`` numbers the rows; it is fixed once the index is written. k1 and k2 are hashes of each text. n_words and places tell for each text how many words it has and at which position they begin.
    """
    if vocabulary is not None:
        vocabulary = np.unique(vocabulary)

    def segments(batches):
        for batch in batches:
            column = batch.column("text")
            for at, rows in tokens.pieces(column, SEGMENT):
                part = column.slice(at, rows)
                h, n = _term_hashes(part)
                begin = np.cumsum(n) - n + np.arange(len(n))  # a gap before each next text
                place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
                if vocabulary is not None:
                    near = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                    known = vocabulary[near] == h if len(vocabulary) else np.zeros(len(h), bool)
                    h, place = h[known], place[known]
                order = np.argsort(h, kind="stable")
                h, place = h[order], place[order]
                last = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, np.int64)
                lists = lambda x: pa.array([x.astype(np.int64)], pa.list_(pa.int64()))
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), batch.column(c).slice(at, rows).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    one("doc_id"), one("k1"), one("k2"), lists(n), lists(begin),
                    pa.array([h[last].tobytes()], pa.binary()), pa.array([(last + 1).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([place.astype(np.int32).tobytes()], pa.binary())],
                    ["doc_ids", "k1", "k2", "n_words", "places", "terms", "ends", "postings"])

    k1, k2 = _text_keys(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), "text")
    return rows.mapInArrow(segments, SEGMENTS).withColumn("segment", F.monotonically_increasing_id())


def term_counts(index: DataFrame) -> DataFrame:
    """term, n: how often each indexed term stands in the whole corpus."""
    def lists(batches):
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                n = np.diff(np.frombuffer(ends.as_py(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(n)], ["term", "n"])

    return index.select("terms", "ends").mapInArrow(lists, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def phrases_of(items: list[tuple], counts: dict[int, int], window: int = WINDOW) -> Phrases:
    """The distinct windows of (id, words) items; an item of fewer words is one window."""
    seen, item, rows = set(), [], []
    for i, (_, h) in enumerate(items):
        span = min(window, len(h))
        for k in range(len(h) - span + 1 if span else 0):
            row = h[k:k + span]
            if (key := (i, row.tobytes())) not in seen:
                seen.add(key)
                item.append(i)
                rows.append(row)
    width = max([window, *map(len, rows)])
    terms, length = np.zeros((len(rows), width), np.uint64), np.array([len(r) for r in rows], np.int64)
    rarity = np.full((len(rows), width), np.iinfo(np.int64).max)
    for i, r in enumerate(rows):
        terms[i, :len(r)] = r
        rarity[i, :len(r)] = [counts.get(int(x), 0) for x in r.view(np.int64)]
    return Phrases(tuple(x for x, _ in items), np.array(item, np.int64), terms, length, np.argsort(rarity, axis=1, kind="stable"))


class Segment:
    """One row of the index, ready for queries."""

    def __init__(self, row: dict):
        self.ids, self.n_words = row["doc_ids"], np.array(row["n_words"], np.int64)
        self.places = np.array(row["places"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
        self.postings = np.frombuffer(row["postings"], np.int32)

    def list_numbers(self, terms: np.ndarray) -> np.ndarray:
        """Which list each term has; -1 without one."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def positions(self, number: int) -> np.ndarray:
        return self.postings[self.ends[number]:self.ends[number + 1]]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.places, places, "right") - 1

    def exact(self, phrases: Phrases):
        """(window, first positions) of every phrase that occurs."""
        numbers = self.list_numbers(phrases.terms)
        used = np.arange(numbers.shape[1]) < phrases.length[:, None]
        for w in np.flatnonzero(((numbers >= 0) | ~used).all(axis=1)):
            at = None
            for k in phrases.order[w, :phrases.length[w]]:
                here = self.positions(numbers[w, k]) - int(k)
                if at is None:
                    at = here
                else:
                    near = np.minimum(np.searchsorted(here, at), len(here) - 1)
                    at = at[here[near] == at]
                if not len(at):
                    break
            if at is not None and len(at):
                yield w, at.astype(np.int64)

    def near(self, rare: list[tuple[np.ndarray, int]]):
        """(item, text) of items whose rarest terms all stand within the item's span of the rarest one, in any order."""
        for i, (terms, slop) in enumerate(rare):
            numbers = self.list_numbers(terms)
            if not len(terms) or (numbers < 0).any():
                continue
            at = self.positions(numbers[0]).astype(np.int64)
            text = self.text_of(at)
            for n in numbers[1:]:
                here = self.positions(n).astype(np.int64)
                low = np.maximum(at - slop, self.places[text])
                high = np.minimum(at + slop, self.places[text] + self.n_words[text] - 1)
                ok = np.searchsorted(here, high, "right") > np.searchsorted(here, low)
                at, text = at[ok], text[ok]
            for t in np.unique(text):
                yield i, int(t)


#: One row for each text and block of items: words hit as a bit for each word, ids of items found and near.
HITS = "segment bigint, text bigint, doc_id bigint, k1 bigint, k2 bigint, n_words bigint, hit binary, items array<string>, near array<string>"


#: The same where one block holds all items, so that nothing is left to put together.
WHOLE = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, n_hit bigint, items array<string>, items_sha256 string, near array<string>"


def _sha256(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def matches(index: DataFrame, phrases: Phrases, rare: list[tuple[np.ndarray, int]], every_text: bool, whole: bool = False) -> DataFrame:
    """HITS of the phrases: of every text, or only of texts with an exact or near match. ``whole``: WHOLE instead, of phrases of all items.

    ``segment`` and ``text`` name a row: the number of the segment in the written index, and the text's number in it.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("near", pa.list_(pa.string()))] if whole else [
        ("segment", pa.int64()), ("text", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
        ("n_words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a few MB
                row = batch.slice(i, 1).to_pylist()[0]
                seg = Segment(row)
                total = int(seg.places[-1] + seg.n_words[-1]) if len(seg.places) else 0
                step = np.zeros(total + 1, np.int64)
                items: dict[int, set] = {}
                for w, at in seg.exact(phrases):
                    np.add.at(step, at, 1)
                    np.add.at(step, at + phrases.length[w], -1)
                    for t in np.unique(seg.text_of(at)):
                        items.setdefault(int(t), set()).add(int(phrases.item[w]))
                hit = np.cumsum(step[:-1]) > 0
                close: dict[int, set] = {}
                for i, t in seg.near(rare):
                    close.setdefault(t, set()).add(i)
                texts = range(len(seg.ids)) if every_text else sorted(set(items) | set(close))
                names = lambda found: sorted({str(phrases.items[i]) for i in found})
                out = {k: [] for k in schema.names}
                for t in texts:
                    span = hit[seg.places[t]:seg.places[t] + seg.n_words[t]]
                    found = names(items.get(t, ()))
                    for k, v in (("doc_id", seg.ids[t]), ("k1", row["k1"][t]), ("k2", row["k2"][t]), ("n_words", int(seg.n_words[t])),
                                 ("items", found), ("near", names(close.get(t, ())))):
                        out[k].append(v)
                    for k, v in ((("n_hit", int(span.sum())), ("items_sha256", _sha256(found))) if whole else (
                            ("segment", row["segment"]), ("text", t), ("hit", np.packbits(span).tobytes() if span.any() else b""))):
                        out[k].append(v)
                if texts:
                    yield pa.RecordBatch.from_pydict(out, schema)

    return index.mapInArrow(find, WHOLE if whole else HITS)


@F.arrow_udf(T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("items_sha256", T.StringType())]))
def _digest(hits: pa.Array, items: pa.Array) -> pa.Array:
    """Words hit in any of a text's blocks, and the sha256 of its item ids."""
    n, sha = [], []
    for parts, ids in zip(hits.to_pylist(), items.to_pylist()):
        parts = [p for p in parts or [] if p]
        whole = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts]) if parts else np.zeros(0, np.uint8)
        n.append(int(np.bitwise_count(whole).sum()))
        sha.append(_sha256(ids or []))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["n_hit", "items_sha256"])


def search(docs: DataFrame, items: DataFrame, near_terms: int = 5, slop: int = 2 * WINDOW) -> DataFrame:
    """doc_id, k1 and k2 (hashes of the text), n_words, n_hit, items, items_sha256, near_items and contaminated of every row of docs.

    ``items`` (item_id, text) is the stated set of queries: its words go to the tasks in blocks of
    BLOCK items, each block in one scan of the stored index. Items with a null text or
    without a word have no window; items with equal ids count as one, a null id is listed as None. A null text has no words. A
    repeated row is found again on its own. A very long text is one segment. Other columns are not read.
    ``near_items`` have the ``near_terms`` rarest of their terms that the corpus has within ``slop`` words of the rarest, or
    within the item's length if that is longer, in any order; so a whole item that occurs is near, too.
    """
    queries = [(r["item_id"], _item_words(r["text"])) for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
    queries = [(i, h) for i, h in queries if len(h)]
    vocabulary = np.unique(np.concatenate([h for _, h in queries])) if queries else np.zeros(0, np.uint64)
    index = materialize(build_index(docs, vocabulary if len(vocabulary) <= MAX_TERMS else None), "postings", INDEX_GROUP)
    counts = term_counts(index)
    if len(vocabulary) > MAX_TERMS:  # only the queries' terms come to the driver
        known = docs.sparkSession.createDataFrame([(int(x),) for x in vocabulary.view(np.int64)], "term bigint")
        counts = counts.join(known, "term", "left_semi")
    counted = {r["term"]: r["n"] for r in counts.toLocalIterator()}
    found = None
    for at in range(0, max(1, len(queries)), BLOCK):
        block = queries[at:at + BLOCK]
        by_rarity = [sorted(counted.keys() & h.view(np.int64).tolist(), key=lambda x: (counted[x], x))[:near_terms] for _, h in block]
        rare = [(np.array(x, np.int64).view(np.uint64), max(slop, len(h))) for x, (_, h) in zip(by_rarity, block)]
        part = matches(index, phrases_of(block, counted), rare, every_text=at == 0, whole=len(queries) <= BLOCK)
        found = part if found is None else found.unionByName(part)
    if len(queries) > BLOCK:
        found = found.groupBy("segment", "text", "doc_id", "k1", "k2", "n_words").agg(
            F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        found = found.select("*", _digest("hits", "items").alias("d")).select("*", "d.*")
    return found.select("doc_id", "k1", "k2", "n_words", "n_hit", "items", "items_sha256", F.col("near").alias("near_items"),
                        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows without a contaminated text, with all their columns: a row is known by its id and a 128-bit hash of its text."""
    bad = search(docs, items).where("contaminated").select(F.col("doc_id").alias("_bad"), "k1", "k2").distinct()
    bad = materialize(bad, "contaminated")  # the planner knows the size of a written table before it deals the texts out
    k1, k2 = _text_keys(docs["text"])
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (k1 == bad["k1"]) & (k2 == bad["k2"]), "left_anti")


def op7_positional_index_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256", "contaminated",
        F.size("near_items").cast("bigint").alias("n_near_items"))
