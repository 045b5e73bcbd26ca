"""Quality rules with risk-controlled thresholds.

Each rule compares one statistic of a text with a cutoff. Cutoffs are learned: a rule may reject at
a cutoff only if the labelled good texts of the stratum show, with an exact binomial bound, that
it rejects at most ``alpha`` of all good texts there. The bounds hold together with confidence
1 - delta, as delta is divided over all strata, rules and cutoffs tried.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import tokens
from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule -> (statistic in thousandths, whether large values are bad, cutoffs from strict to lax).
#: The cutoffs are fixed before any label is seen, which the bounds need.
RULES = {
    "symbols": ("1000 * n_symbols / greatest(1, n_words)", True, (20, 50, 100, 200, 400, 800)),
    "dup_lines": ("1000 * n_dup_lines / greatest(1, n_lines)", True, (50, 100, 200, 300, 500, 700)),
    "repeats": ("1000 * n_repeat_words / greatest(1, n_words)", True, (20, 50, 100, 150, 200, 250)),
    "long_words": ("1000 * word_chars / greatest(1, n_words)", True, (7000, 8000, 9000, 10000, 12000, 16000)),
    "short_words": ("1000 * word_chars / greatest(1, n_words)", False, (4500, 4000, 3500, 3000, 2500, 2000)),
    "few_words": ("1000 * n_words", False, (60000, 50000, 40000, 30000, 25000)),
}


def _line_repeats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray):
    """(lines with a word, of those equal to an earlier line) of each text; lines are equal byte by byte."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < n]
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.concatenate([begin[1:], [n]]), offsets[text + 1]) if len(begin) else begin
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10)) if len(begin) else end
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, text = begin[worded], end[worded], text[worded]
    texts = len(offsets) - 1
    if not len(begin):
        return np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    h = tokens.word_hashes(data, begin, end)
    order = np.lexsort((h, text))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text, minlength=texts), np.bincount(text[order][again], minlength=texts)


def measure(column) -> list[np.ndarray]:
    """STATS of each text of an Arrow column."""
    parts = []
    for at, rows in tokens.pieces(column, tokens.SMALL_PIECE):
        data, offsets = tokens.flat(column.slice(at, rows))
        starts, ends, first = tokens.words(data, offsets, tokens.SPACE)
        hashes = tokens.word_hashes(data, starts, ends)
        chars = tokens.masked_sums(((data & 0xC0) != 0x80) & ~tokens.SPACE[data], offsets)
        lines, dup = _line_repeats(data, offsets, starts)
        place, window = tokens.window_hashes(hashes, first, WINDOW)
        text = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((window, text))
        same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(place), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = place[order[twice]]
        covered = tokens.cover(found, found + WINDOW, len(starts)) if len(starts) else np.zeros(0, bool)
        parts.append([np.diff(first), chars, tokens.masked_sums(SYMBOLS[data], offsets), dup,
                      tokens.masked_sums(covered, first), lines])
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(STATS))]


@F.arrow_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATS]))
def stats(text: pa.Array) -> pa.Array:
    """STATS of a text as a struct; a null text is empty."""
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in measure(text)], names=list(STATS))


def upper_bound(failures: int, n: int, confidence: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate after ``failures`` of ``n`` trials."""
    if n == 0 or failures >= n:
        return 1.0

    def at_most(p: float) -> float:
        """P(X <= failures) for X ~ Bin(n, p)."""
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
                for k in range(failures + 1)]
        top = max(logs)
        return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs)) if top > -700 else 0.0

    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid > 0 and at_most(mid) > 1 - confidence or mid == 0 else (low, mid)
    return high


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (n_repeat_words * 100 > n_words * 30)


def _fires(rule: str, cutoff: int | Column) -> Column:
    """Whether a rule rejects a row that has the STATS as columns."""
    expr, large, _ = RULES[rule]
    return F.expr(expr) > cutoff if large else F.expr(expr) < cutoff


@dataclass(frozen=True)
class Thresholds:
    """Cutoffs as (stratum, rule, cutoff, bound); a stratum without one of its own has no learned rule. ``own`` were tried."""

    own: tuple[str, ...]
    rules: tuple[tuple[str, str, int, float], ...]


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, min_good: int = 100) -> Thresholds:
    """The strictest cutoff of each rule and stratum that keeps its promise.

    ``measured`` has doc_id, stratum and the STATS. All labelled rows are holdouts: no cutoff was
    fitted on them. Good texts are labelled quality 1 and not toxic; a document that carries
    several labels is good if all are. A stratum with fewer than ``min_good`` good texts is not tried; no
    stratum uses the cutoffs of others. Each rule may wrongly reject alpha / rules of the
    good texts, so together they reject at most alpha; each bound has confidence
    1 - delta / (strata tried x cutoffs).
    """
    fine = F.coalesce(F.col("quality") == 1, F.lit(False))
    if "toxic" in labels.columns:
        fine = fine & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(fine).alias("fine"))
            .where("fine").select("doc_id"))
    tried = [(r, c) for r, (_, _, cuts) in RULES.items() for c in cuts]
    usable = measured.join(good, "doc_id", "left_semi").where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    counts = usable.groupBy("stratum").agg(F.count("*").alias("n"), *(
        F.sum(_fires(r, c).cast("bigint")).alias(f"{r}_{c}") for r, c in tried))
    strata = counts.where(F.col("n") >= min_good).orderBy(F.desc("n"), "stratum").collect()  # one small row a stratum
    own = tuple(r["stratum"] for r in strata)
    confidence, limit = 1 - delta / (max(1, len(strata)) * len(tried)), alpha / len(RULES)
    out = []
    for name, row in zip(own, strata):
        for rule, (_, _, cuts) in RULES.items():
            for c in cuts:  # from strict to lax
                n, failures = int(row["n"]), int(row[f"{rule}_{c}"])
                if failures <= limit * n and (bound := upper_bound(failures, n, confidence)) <= limit:
                    out.append((name, rule, c, bound))
                    break
    return Thresholds(own, tuple(out))


def verdict(thresholds: Thresholds, stratum: Column) -> Column:
    """Whether a row with the STATS as columns stays: no rule of its stratum rejects it."""
    out = F.lit(True)
    for rule in RULES:
        cutoffs = [F.lit(x) for name, r, cutoff, _ in thresholds.rules if r == rule for x in (name, cutoff)]
        if cutoffs:  # a stratum that is not in the map has no cutoff
            out = out & ~F.coalesce(_fires(rule, F.try_element_at(F.create_map(*cutoffs), stratum)), F.lit(False))
    return ~base_failed(F.col("n_words"), F.col("n_repeat_words")) & out


def _stratum(docs: DataFrame, column: str) -> Column:
    return F.concat(F.lit("="), F.coalesce(F.col(column).cast("string"), F.lit(""))) if column in docs.columns else F.lit("=")


def annotate(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """doc_id, the STATS, base_failed and kept of every row.

    A null text has no words and fails. A null stratum is the empty one. Whole texts are measured,
    a piece at a time. Without labels no learned rule is used, so only the base rule rejects.
    Repeated rows get equal results. Other columns are not read.
    """
    measured = docs.select("doc_id", _stratum(docs, stratum).alias("stratum"), stats("text").alias("s"))
    # Narrow rows, written once: calibration and verdict read them.
    measured = materialize(measured.select("doc_id", "stratum", "s.*"), "quality")
    thresholds = calibrate(measured, labels, **risk)
    return measured.select("doc_id", "stratum", *STATS, base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"),
                           verdict(thresholds, F.col("stratum")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **risk) -> DataFrame:
    """The rows that :func:`annotate` keeps, with all their columns. Texts are measured for the calibration and again
    for the verdict: only narrow rows are shuffled, and no copy of the texts is written."""
    measured = docs.select("doc_id", _stratum(docs, stratum).alias("stratum"), stats("text").alias("s"))
    thresholds = calibrate(materialize(measured.select("doc_id", "stratum", "s.*"), "quality-measured"), labels, **risk)
    # The statistics stand beside the row in one struct, so no column of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), _stratum(docs, stratum).alias("stratum"), stats("text").alias("s"))
    return rows.select("row", "stratum", "s.*").where(verdict(thresholds, F.col("stratum"))).select("row.*")


def op6_risk_controlled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return annotate(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
