"""Packing token sequences of one length, shortest pack first over the length histogram.

Documents become token ids once. What is longer than a sequence fills whole sequences; the rests are
only counted by length. The histogram (one number for each length below the limit) is packed on the
driver: lengths from the longest to the shortest, each put into the shortest pack that it fits, all
packs with one pattern at a time. What that gives is a table of placements: so many consecutive
ranks of a length go, so many to a pack, into consecutive packs at one offset. A piece finds its
placement by its length and its rank among the pieces of that length, so nothing but counts ever
meets in one place, however many documents have one length.

Patterns alone can leave gaps (all documents a little over half a sequence, say). As a text may be
cut anywhere, the shortest packs are dissolved and their tokens fill the gaps of the others, and the
last few packs are cut at powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .tables import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, END_ID, LEAST_GAP = 4096, 2, 16
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of ids in one batch of pieces, and words and bytes of words that a task remembers.
BATCH_BYTES, KNOWN_WORDS, KNOWN_BYTES = 4 << 20, 1 << 19, 1 << 26
_RANKS = 1 << 44

# -----------------------------------------------------------------------------------------------
# Documents to ids
# -----------------------------------------------------------------------------------------------
#: The steps before merging of the tokenizer whose words can be encoded one by one. White space only
#: separates there and nothing else looks across it, so a text is the ids of its words, and a word is encoded once.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "letters": "a-zß-öø-ÿ",
}


def encoder(vocabulary: str) -> Callable[[str | None], bytes]:
    """text -> little-endian 32-bit ids by ``tokenizers``, without special tokens; null is empty."""
    import re
    import struct

    from tokenizers import Tokenizer

    tokenizer, described = Tokenizer.from_str(vocabulary), json.loads(vocabulary)

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    before = (described.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    added = [a["content"].encode() for a in described.get("added_tokens", [])]
    by_word = (described.get("normalizer") == _BY_WORD["normalizer"] and len(before) == 2
               and before[0].get("pattern") == {"Regex": _BY_WORD["pattern"]} and before[1].get("type") == "ByteLevel"
               and described.get("post_processor") is None and described["model"].get("unk_token") is None
               and all(a.isascii() and not any(c.isspace() for c in a.decode()) for a in added))
    if not by_word:
        return lambda text: whole(text) if text else b""

    letters = _BY_WORD["letters"]
    piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\\s{letters}0-9]+")
    plain = re.compile("[!-~À-ÖØ-öø-ÿ]*")
    special = re.compile(b"|".join(map(re.escape, added)) or b"(?!)")
    # The printable character that byte-level vocabularies write for each byte.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    merged = tokenizer.model.tokenize

    class Known(dict):
        """What is missing is encoded and kept; a full one starts anew."""

        def __init__(self, encode):
            self.encode, self.held = encode, 0

        def __missing__(self, word):
            ids = self.encode(word)
            self.held += len(word) + len(ids)
            if len(self) >= KNOWN_WORDS or self.held > KNOWN_BYTES:
                self.clear()
                self.held = 0
            self[word] = ids
            return ids

    def of_piece(word: str) -> bytes:
        said = word if word.isascii() else word.encode().decode("latin-1").translate(table)
        ids = [t.id for t in merged(said)]
        return struct.pack(f"<{len(ids)}I", *ids)

    pieces = Known(of_piece)

    def of_word(word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        ascii = text.isascii()
        if not (text.isprintable() if ascii else plain.fullmatch(text)) or special.search(word):
            return whole(text)
        if ascii and text.isalpha():
            return pieces[text.lower()]
        return b"".join([pieces[p] for p in piece.findall(text.lower())])

    known = Known(of_word)
    # bytes.split parts at ASCII white space only, which every reading of \s has.
    return lambda text: b"".join([known[w] for w in text.encode("utf-8", "surrogatepass").split()]) if text else b""


def cut_documents(vocabulary: str, end_id: int, length: int):
    """mapInArrow over doc_id, text: PIECES rows. ``local`` counts the pieces of a length in the task."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
                        ("doc_tokens", pa.int64()), ("local", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]):
        encode, seen, part = encoder(vocabulary), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start:4 * (start + length)]
                    size = len(own) // 4
                    rows.append((part, doc_id, start, size, n, int(seen[size]), own))
                    seen[size] += 1
                    held += len(own) + 100
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


PIECES = "part int, doc_id bigint, start bigint, length int, doc_tokens bigint, local bigint, ids binary"

# -----------------------------------------------------------------------------------------------
# The histogram to patterns
# -----------------------------------------------------------------------------------------------


def shortest_pack_first(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple], list[tuple]]:
    """Placements (piece length, first rank, packs, pieces a pack, first pack, offset) and packs (first, number, filled).

    The same patterns as taking every piece by itself, longest first, into the shortest pack that it fits, and into
    a new pack where it fits none; packs of one pattern are handled together.
    """
    placed: list[tuple] = []
    packs = 0
    heap: list[tuple] = []  # (-room, first pack, number)
    for size in sorted((s for s in counts if counts[s] and s < length), reverse=True):
        n, rank = counts[size], 0

        def put(first, number, filled, copies):
            nonlocal rank, n
            placed.append((size, rank, number, copies, first, filled))
            rank += number * copies
            n -= number * copies
            heapq.heappush(heap, (filled + copies * size - length, first, number))

        while n and heap and -heap[0][0] >= size:
            room, first, number = heapq.heappop(heap)
            room = -room
            below = max(size, -heap[0][0] if heap else 0)
            copies = min((room - below) // size + 1, n // number)
            if copies:
                put(first, number, length - room, copies)
            else:
                heapq.heappush(heap, (-room, first + n, number - n))
                put(first, n, length - room, 1)
        if n:
            copies, opened = length // size, packs
            full, rest = divmod(n, copies)
            packs += full + bool(rest)
            if full:
                put(opened, full, 0, copies)
            if rest:
                put(opened + full, 1, 0, rest)
    return placed, sorted((first, number, length + room) for room, first, number in heap)


@dataclass(frozen=True)
class Plan:
    """Arrays that place every piece; their size follows the lengths, not the documents."""
    length: int
    key: np.ndarray       # piece length * _RANKS + first rank, ascending
    place: np.ndarray     # packs, pieces a pack, first pack, offset
    first: np.ndarray     # first pack of each group, ascending
    given: np.ndarray     # of each group: leading packs that are dissolved
    stream: np.ndarray    # of each group: place of its first dissolved token in the stream
    filled: np.ndarray    # of each group: tokens in a pack
    number: np.ndarray    # of each group: sequence id of its first pack that stays
    gaps: np.ndarray      # of each group that is filled up: stream place, count before, first pack, filled
    cuts: dict            # pack -> (starts of its parts, their sequence ids)
    sequences: int        # sequence ids below this are taken


def powers_of_two(n: int) -> list[int]:
    """Starts of parts of n tokens whose sizes are falling powers of two."""
    starts, at = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            starts.append(at)
            at += 1 << k
    return starts


def plan(counts: dict[int, int], length: int = LENGTH, least_gap: int = LEAST_GAP) -> Plan:
    """Patterns of a histogram, gaps of ``least_gap`` and more filled from the shortest packs."""
    placed, groups = shortest_pack_first(counts, length)
    placed.sort()
    by_fill = sorted(range(len(groups)), key=lambda g: (groups[g][2], groups[g][0]))
    # Each pack that is dissolved closes its own gap and fills as many tokens of others: a sequence less.
    donors = sum(n * (length - f) for _, n, f in groups if length - f >= least_gap) // length
    given, stream, tokens = [0] * len(groups), [0] * len(groups), 0
    for g in by_fill:
        given[g], stream[g] = min(donors, groups[g][1]), tokens
        donors -= given[g]
        tokens += given[g] * groups[g][2]
    gaps, cuts, at, count = [], {}, 0, 0
    for g in reversed(by_fill):
        first, n, filled = groups[g][0] + given[g], groups[g][1] - given[g], groups[g][2]
        gap = length - filled
        if gap >= least_gap and n:
            gaps.append((at, count, first, filled))
            # Packs that the stream ends before: fewer than length / least_gap of them.
            for i in range(max(0, min(n, (tokens - at) // gap)), n):
                total = filled + max(0, min(gap, tokens - at - i * gap))
                if length - total >= least_gap and total & (total - 1):
                    cuts[first + i] = powers_of_two(total)
            at, count = at + n * gap, count + n
    number, kept = [], 0
    for (_, n, _), gone in zip(groups, given):
        number.append(kept)
        kept += n - gone
    parts = {}
    for pack in sorted(cuts):
        g = max(i for i, group in enumerate(groups) if group[0] <= pack)
        own = number[g] + pack - groups[g][0] - given[g]
        parts[pack] = (cuts[pack], [own, *range(kept, kept + len(cuts[pack]) - 1)])
        kept += len(cuts[pack]) - 1
    one = lambda rows, width: np.array(rows, np.int64).reshape(-1, width)
    return Plan(length, np.array([s * _RANKS + r for s, r, *_ in placed], np.int64), one([p[2:] for p in placed], 4),
                np.array([g[0] for g in groups], np.int64), np.array(given, np.int64), np.array(stream, np.int64),
                np.array([g[2] for g in groups], np.int64), np.array(number, np.int64), one(gaps, 4), parts, kept)


def placements(p: Plan, size: np.ndarray, rank: np.ndarray):
    """(piece, its part's start and size, sequence, offset): one row for each part a piece is cut into."""
    n = len(size)
    piece, start, take = np.arange(n), np.zeros(n, np.int64), size.astype(np.int64)
    full = size == p.length
    sequence, offset = np.where(full, p.sequences + rank, 0), np.zeros(n, np.int64)
    if full.all():
        return piece, start, take, sequence, offset
    rest = np.flatnonzero(~full)
    at = np.searchsorted(p.key, take[rest] * _RANKS + rank[rest], "right") - 1
    _, copies, first, base = p.place[at].T
    order = rank[rest] - (p.key[at] - take[rest] * _RANKS)
    pack, off = first + order // copies, base + order % copies * take[rest]
    group = np.searchsorted(p.first, pack, "right") - 1
    gives = pack < p.first[group] + p.given[group]
    stays, goes = np.flatnonzero(~gives), np.flatnonzero(gives)
    # Tokens of dissolved packs, cut where one gap ends and the next begins.
    place = p.stream[group[goes]] + (pack[goes] - p.first[group[goes]]) * p.filled[group[goes]] + off[goes]
    many = take[rest[goes]]

    def gap_at(stream):
        j = np.searchsorted(p.gaps[:, 0], stream, "right") - 1
        return p.gaps[j, 1] + (stream - p.gaps[j, 0]) // (p.length - p.gaps[j, 3])

    if len(goes):
        low, high = gap_at(place), gap_at(place + many - 1)
        times = high - low + 1
        own = np.repeat(np.arange(len(goes)), times)
        which = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        j = np.searchsorted(p.gaps[:, 1], which, "right") - 1
        room = p.length - p.gaps[j, 3]
        begin = p.gaps[j, 0] + (which - p.gaps[j, 1]) * room
        a, b = np.maximum(place[own], begin), np.minimum(place[own] + many[own], begin + room)
        fill = (rest[goes][own], a - place[own], b - a, p.gaps[j, 2] + which - p.gaps[j, 1], p.gaps[j, 3] + a - begin)
    else:
        fill = tuple(np.zeros(0, np.int64) for _ in range(5))
    piece = np.concatenate([rest[stays], fill[0]])
    start = np.concatenate([np.zeros(len(stays), np.int64), fill[1]])
    take = np.concatenate([take[rest[stays]], fill[2]])
    pack = np.concatenate([pack[stays], fill[3]])
    off = np.concatenate([off[stays], fill[4]])
    group = np.searchsorted(p.first, pack, "right") - 1
    held = p.number[group] + pack - p.first[group] - p.given[group]
    rows = [np.flatnonzero(full), np.zeros(full.sum(), np.int64), size[full].astype(np.int64), sequence[full], offset[full]]
    cut = np.isin(pack, np.fromiter(p.cuts, np.int64, len(p.cuts)))
    parts = [[], [], [], [], []]
    for i in np.flatnonzero(cut):
        starts, ids = p.cuts[int(pack[i])]
        ends = [*starts[1:], p.length]
        for s, e, sequence_id in zip(starts, ends, ids):
            a, b = max(s, int(off[i])), min(e, int(off[i] + take[i]))
            if a < b:
                for column, value in zip(parts, (piece[i], start[i] + a - off[i], b - a, sequence_id, a - s)):
                    column.append(value)
    return tuple(np.concatenate([x, y[~cut], np.array(z, np.int64)]) for x, y, z in
                 zip(rows, (piece, start, take, held, off), parts))


PACKED = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def place_pieces(p: Plan):
    """mapInArrow over doc_id, start, length, doc_tokens, rank, ids: PACKED rows."""
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            piece, start, take, sequence, offset = placements(p, size, rank)
            rows = batch.take(pa.array(piece))
            ids = rows.column("ids")
            if (take != size[piece]).any():
                ids = pa.array([x.as_py()[4 * a:4 * (a + b)] for x, a, b in zip(ids, start.tolist(), take.tolist())], pa.binary())
            begin = rows.column("start").to_numpy(zero_copy_only=False) + start
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(begin), pa.array(take), ids, rows.column("doc_tokens"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, length: int = LENGTH,
         least_gap: int = LEAST_GAP) -> DataFrame:
    """PACKED rows: every token of ``docs`` (doc_id, text) in one piece of a sequence of at most ``length``.

    ``vocabulary`` is the path of a ``tokenizers`` file, read by the driver. A document's ids end with ``end_id``; a
    null or empty text is that id alone. ``ids`` are little-endian 32-bit numbers. Pieces of a sequence are gapless
    from 0; ids of sequences are gapless. A row of ``docs`` is a document of its own, whatever its id: repeated rows
    and null ids (kept as null) are packed like any other; other columns are ignored. No documents, no rows. A text of
    any length is encoded whole, in one task, and leaves it in pieces.

    Padding to ``length`` is below ``least_gap`` for every sequence whose size is no power of two. Which of the pieces
    of one length goes where follows their order in the written pieces.
    """
    with open(vocabulary, encoding="utf-8") as file:
        words = file.read()
    schema = T.StructType.fromDDL(PIECES)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(cut_documents(words, end_id, length), schema), "packing-pieces")
    counted = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    # One row a length: at most `length` of them.
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("local")).alias("rank"), "ids")
    return ranked.mapInArrow(place_pieces(plan(histogram, length, least_gap)), PACKED)


def op11_histogram_packing(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
