"""Language ID by bit-sliced Bloom filters of n-grams.

Every slot of one Bloom filter holds a bitmask of languages, so the AND of an n-gram's slots is the
set of all languages that contain it: one lookup for all languages. A text's n-grams give each
language a popcount; a language whose slices are fuller gets more false hits, and the count is
corrected by that slice's measured rate before the largest one decides.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import tokens
from .tables import fold_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lengths of the n-grams in characters; a word is taken with a space at either end.
GRAMS = (2, 3, 4)
SLOT_BITS, HASHES = 20, 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    slots: np.ndarray            # uint64 masks of 64 languages each, 2 ** SLOT_BITS in a row, a row for every 64 languages
    false_rate: tuple[float, ...]  # chance that an n-gram outside the language hits its slices


def _characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters as a space, spaces at both ends."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = points >= 128
    letter = (points >= 97) & (points <= 122)
    if wide.any():
        kinds, back = np.unique(points[wide], return_inverse=True)
        letter[wide] = np.array([chr(int(p)).isalpha() for p in kinds])[back]
    return np.where(letter, points, np.uint32(32))


def _gram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each n-gram that has a letter and no inner space."""
    space = points == 32
    codes = tokens.mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = []
    for n in GRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        ok = ~(space[:m] & space[n - 1:n - 1 + m]) if n == 2 else np.ones(m, bool)
        for k in range(n):
            h = h * np.uint64(tokens.WORD_BASE) + codes[k:k + m]
            if 0 < k < n - 1:
                ok &= ~space[k:k + m]
        out.append(tokens.mix(h[ok]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slots(h: np.ndarray):
    """The slots of each hash, one array per hash function."""
    step = (h >> np.uint64(40)) | np.uint64(1)
    for k in range(HASHES):
        yield ((h + np.uint64(k) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _by_language(values: dict) -> Column:
    """The value of the row's language; null without one."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang")) if values else F.lit(None)


def training_rows(docs: DataFrame, per_language: int, seed: int) -> DataFrame:
    """lang, text: at most about ``per_language`` labelled texts of each language, chosen by a hash of the id."""
    learn = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", 4) != 2))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    cut = _by_language({lang: min(scale, scale * per_language // n) for lang, n in sizes.items()})
    return learn.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(scale)) < cut).select("lang", "text")


def fit(docs: DataFrame, per_language: int = 4000, share: float = 0.001, dominance: float = 0.1, seed: int = 7) -> Model | None:
    """The filter learned from the labelled rows; None if there are none.

    The classifier is fitted on a bounded sample: ``per_language`` texts of each language, by a hash
    of the id. For every n-gram Spark counts the texts of each language that have it. A language
    contains an n-gram if at least ``share`` of its texts do, and that rate is at least
    ``dominance`` of the rate of the language that has it most; so a quotation or a wrong label
    does not put an n-gram into a language. A slot has a mask word for every 64 languages.
    """
    rows = training_rows(docs, per_language, seed)
    counted = (rows.mapInArrow(_document_grams, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return None
    rate = F.col("n") / _by_language({lang: float(n) for lang, n in sizes.items()})
    bit = _by_language({lang: i for i, lang in enumerate(languages)})
    # Rates of at least `share` are a bounded number of n-grams: a text has a bounded number of them on average.
    kept = (counted.select("gram", bit.alias("bit"), rate.alias("rate"))
            .where(F.col("rate") >= share)
            .groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate")).alias("has"))
            .select("gram", F.explode(F.filter("has", lambda x: x["rate"] >= F.col("top") * dominance)).alias("x"))
            .select("gram", F.floor(F.col("x.bit") / 64).alias("row"), F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), F.pmod("x.bit", F.lit(64))).alias("mask")))
    table = kept.toPandas()
    slots = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    grams, masks = table["gram"].to_numpy(np.int64).view(np.uint64), table["mask"].to_numpy(np.int64).view(np.uint64)
    rows_of = table["row"].to_numpy(np.int64)
    for place in _slots(grams):
        np.bitwise_or.at(slots, (rows_of, place), masks)
    fill = [float(np.mean((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(languages))]
    return Model(languages, slots, tuple(f ** HASHES for f in fill))


def _document_grams(batches):
    """Number of texts with each n-gram, by language, of a piece of texts at a time."""
    for batch in batches:
        for at, n in tokens.pieces(batch.column("text")):
            by: dict[str, list[np.ndarray]] = {}
            part = batch.slice(at, n)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).append(np.unique(_gram_hashes(_characters(text))))
            for lang, grams in by.items():
                h, m = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(m.astype(np.int64))],
                    ["lang", "gram", "n"])


_BLANK = re.compile(r"\s")


def _steps(text: str, chunk: int):
    """Parts of a text of about ``chunk`` characters, cut at white space only, as no n-gram holds any inside."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, min(at + chunk, len(text)))
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def predict(text: str | None, model: Model | None, chunk: int = 1 << 20) -> tuple[str, float]:
    """(language, score from 0 to 1): the share of the text's n-grams that are the language's, corrected.

    The result does not depend on ``chunk``: a long text is read in steps that end at white space.
    """
    if text is None or model is None:
        return UNKNOWN, 0.0
    total, hits = 0, np.zeros(len(model.languages))
    lettered = False
    for part in _steps(text, chunk):
        points = _characters(part)
        lettered |= bool((points != 32).any())
        h = _gram_hashes(points)
        if not len(h):
            continue
        total += len(h)
        for k, row in enumerate(np.atleast_2d(model.slots)):
            mask = np.full(len(h), ~np.uint64(0))
            for place in _slots(h):
                mask &= row[place]
            for i in range(64 * k, min(64 * k + 64, len(hits))):
                hits[i] += np.count_nonzero(mask & np.uint64(1 << i % 64))
    if not lettered:
        return UNKNOWN, 0.0
    false = np.array(model.false_rate)
    corrected = np.clip((hits - total * false) / np.maximum(total * (1 - false), 1e-9), 0, 1)
    best = int(np.argmax(corrected))
    return model.languages[best], float(corrected[best])


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null text and one without a letter are ``und`` with score 0; so is every text if nothing was
    learned. Equal counts go to the first language by name. Whole texts are read, in steps of a
    million characters and what is left of a word there. Other columns are not read. Repeated rows give repeated results.
    """
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"

    def rows(batches):
        for batch in batches:
            found = [predict(t.as_py(), model) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold_of("doc_id", 4) == 2).alias("held_out"), "text")
            .mapInArrow(rows, schema))


def op3_bitmask_language_id(docs: DataFrame) -> DataFrame:
    return annotate(docs, fit(docs))
