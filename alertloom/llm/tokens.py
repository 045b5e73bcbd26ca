"""Words and rolling hashes of whole Arrow text columns, in numpy.

A column's texts are one byte array with offsets. All steps work on that array, so their cost
follows the bytes and not the number of rows. :func:`pieces` bounds the memory of a step.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that one step works on, or one text if that is longer.
PIECE = 1 << 20
#: The same for steps that hold about ten numbers for every byte.
SMALL_PIECE = 1 << 18
#: Odd multipliers of the rolling hashes of bytes and of words, modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Bytes that no word holds: white space, or all ASCII but digits and small letters.
SPACE = _separators((0x09, 0x0D), (0x20, 0x20))
NOT_ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: ASCII capitals to small letters, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(column, limit: int = PIECE):
    """(first row, rows) of consecutive parts of a column with at most ``limit`` bytes each, one row at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    at, n = 0, len(size)
    while at < n:
        to = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at
        at = to


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """(starts, ends, first): byte ranges of all words, and for each text the index of its first word."""
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A random-looking odd number for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        held = np.multiply.accumulate(row)
        _powers.clear() if len(_powers) > 7 else None
        _powers[base] = held
    return held[:n]


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """p with p[j] - p[i] = the sum of codes[k] * base**k for i <= k < j, modulo 2**64."""
    p = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of each span of the array that ``p`` has the sums of; equal spans, equal hashes.

    For short spans of spread numbers: from 1024 on there are different spans with equal sums in any odd base."""
    inverse = powers(pow(base, -1, 1 << 64), len(p))
    return mix((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(p: np.ndarray, length: int) -> np.ndarray:
    """:func:`span_hashes` of every ``length`` consecutive places, without gathering."""
    n = max(0, len(p) - length)
    h = p[length:length + n] - p[:n]
    h *= powers(pow(BYTE_BASE, -1, 1 << 64), n)
    h += np.uint64(length)
    return mix(h)


#: Longest span, in bytes, that is hashed with others side by side; a longer one is hashed by itself.
SIDE_BY_SIDE = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, eight bytes a round, mixed after every round.

    No sum of powers: sums modulo a power of two are equal for some different spans whatever the base.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(BYTE_BASE))
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    own, at = np.flatnonzero((size > 0) & (size <= SIDE_BY_SIDE)), 0
    while len(own):
        block = words[starts[own] + at]
        left = size[own] - at
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[own] = mix((h[own] ^ block) * np.uint64(WORD_BASE) + np.uint64(BYTE_BASE))
        at += 8
        own = own[left > 8]
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), 42)
    return h


def word_hash(word: bytes) -> int:
    one = np.frombuffer(word, np.uint8)
    return int(word_hashes(one, np.array([0]), np.array([len(one)]))[0])


def window_hashes(hashes: np.ndarray, first: np.ndarray, length: int):
    """(start word, hash) of each window of ``length`` words that lies in one text."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[first[text[:n] + 1] >= at + length]
    p = prefix_sums(hashes, WORD_BASE)
    return at, span_hashes(p, at, at + length, WORD_BASE)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def ascending(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative 64-bit numbers, from one sort of numbers that hold their place in the low bits."""
    x, n = x.view(np.uint64), len(x)
    if n < 2:
        return np.arange(n)
    bits = np.uint64((n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    short = int(x.max()) >> (64 - int(bits)) == 0
    held = x << bits if short else x & ~low
    held |= np.arange(n, dtype=np.uint64)
    held.sort()
    held &= low
    order = held.view(np.int64)
    if not short:
        # Numbers that differ in the bits left out only may stand the wrong way round.
        found = x[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(x, kind="stable")
    return order


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct non-negative 64-bit numbers in order, the first place of each, and which of them each number is."""
    kind = np.int32 if len(x) < 1 << 31 else np.int64
    order = ascending(x)
    found = x[order]
    new = np.ones(len(x), bool)
    new[1:] = found[1:] != found[:-1]
    found = found[new]
    back = np.empty(len(x), kind)
    back[order] = np.cumsum(new, dtype=kind) - kind(1)
    return found, order[new], back


def masked_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
