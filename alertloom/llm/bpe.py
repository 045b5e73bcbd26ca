"""Byte-level BPE with higher-order functions over the distinct words.

A word (a match of the pattern) is its bytes, one character for each byte (ISO 8859-1). A fold joins, again and
again, the leftmost pair of pieces whose union has the lowest rank; after a join only the two pairs
beside it are ranked anew. Ranks are a map that goes with each bucket of words, cut into small maps by a hash of the
piece, as Spark searches a map from its start. As a literal they would be in every copy of the plan that the driver
makes, prints and sends.

Documents are dealt into runs. A run cuts its texts into words and asks once for each distinct word, in one block for
each bucket of the hash space. A bucket folds each distinct word of the corpus once and answers every run in the order
it asked; the run puts the ids of its texts together. Words are equal by a 64-bit hash, as in the other operators.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import runs as R, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANKS = "byte_bpe_50k.tiktoken"
LATIN = "ISO-8859-1"
LOWEST = -(1 << 63)
#: Words that runs ask about in one bucket, for up to R.BASE bytes of text.
BUCKET_WORDS = 1 << 18
#: Bytes of the longest word that is folded by higher-order functions.
FOLD_BYTES = 512
#: The pattern that :class:`Cutter` follows without a regular expression.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def small_maps(entries: dict[bytes, int]) -> pa.Array:
    """One value of MAPS: a map as an array of small maps; a key is in the one that its hash tells."""
    size = max(1, len(entries) // 2)
    keys = [k.decode(LATIN) for k in entries]
    hashes = np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in keys], np.uint64).view(np.int64)
    at = hashes % size
    order = np.argsort(at, kind="stable")
    maps = pa.MapArray.from_arrays(
        pa.array(np.searchsorted(at[order], np.arange(size + 1)), pa.int32()),
        pa.array([keys[i] for i in order.tolist()], pa.string()),
        pa.array(np.fromiter(entries.values(), np.int32, len(entries))[order], pa.int32()))
    return pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), maps)


def look_up(maps: Column, body) -> Column:
    """``body`` of a function that looks keys up in :func:`small_maps` (null if absent)."""
    def look_in(parts):
        return body(lambda key: F.element_at(parts, (F.pmod(F.xxhash64(key), F.size(parts)) + 1).cast("int"))[key])

    return _let(maps, look_in)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(word: Column, rank) -> Column:
    """Ids of a word (one character a byte); ``rank`` looks a piece up.

    The state is the pieces, the ranks of neighbours and the place of the lowest rank, null when none is left.
    """
    n = F.length(word)
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))

    def state(p, r):
        return _let(r, lambda r: F.struct(
            p.alias("p"), r.alias("r"), F.array_position(r, F.array_min(r)).cast("int").alias("i")))

    def join(p, r, i):
        def joined(m):
            # Pieces count from 1 and lambda places from 0: the piece at i becomes the union, the next one goes.
            pieces = F.filter(F.transform(p, lambda x, j: F.when(j == i - 1, m).otherwise(x)), lambda x, j: j != i)
            pairs = F.filter(F.transform(r, lambda x, j: F.when(j == i - 2, rank(F.concat(F.element_at(p, i - 1), m)))
                                         .when(j == i, rank(F.concat(m, F.element_at(p, i + 2)))).otherwise(x)), lambda x, j: j != i - 1)
            return state(pieces, pairs)

        return _let(F.concat(F.element_at(p, i), F.element_at(p, i + 1)), joined)

    def step(acc, _):
        return F.when(acc["i"].isNull(), acc).otherwise(join(acc["p"], acc["r"], acc["i"]))

    merged = F.aggregate(F.sequence(F.lit(1), n - 1), state(pieces, pairs), step, lambda acc: acc["p"])
    parts = F.when(n > 1, merged).otherwise(F.array(word))
    return F.transform(parts, lambda p: rank(p))


def join_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word as :func:`fold` gives them: the leftmost pair of lowest rank is joined first.

    Pieces are a linked list by their first byte. A heap entry is out of date if its piece has gone or the pair has
    another end by now.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = after[at]
        if middle < n and (rank := ranks.get(word[at:after[middle]])) is not None:
            heapq.heappush(heap, (rank, at, after[middle]))

    for at in range(n - 1):
        offer(at)
    while heap:
        _, at, end = heapq.heappop(heap)
        if not alive[at] or after[at] >= n or after[after[at]] != end:
            continue
        alive[after[at]] = False
        after[at] = end
        if end < n:
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at:after[at]]])
        at = after[at]
    return ids


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """All code points as runs of one kind: length and kind of each."""
    kind = np.zeros(0x110000, np.uint8)
    place = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = place.astype("<u4").tobytes().decode("utf-32-le")
    for which, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kind[place[m.start()]:place[m.end() - 1] + 1] = which
    at = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]])
    return np.diff(at), kind[at[:-1]]


class Cutter:
    """Cuts texts into the matches of a pattern: PLAIN by the kinds of the characters, others with ``regex``."""

    def __init__(self, pattern: str):
        self.pattern, self.kinds = pattern, _kinds() if pattern == PLAIN else None
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges of all words, in order."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._by_kind(data, offsets) if self.kinds else self._by_pattern(data, offsets)

    def _by_pattern(self, data, offsets):
        starts, ends = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes().decode()
            at = np.concatenate([[0], np.cumsum(_widths(_code_points(text)))]) + a
            found = np.array([m.span() for m in regex.finditer(self.pattern, text)], np.int64).reshape(-1, 2)
            starts.append(at[found[:, 0]])
            ends.append(at[found[:, 1]])
        return np.concatenate(starts), np.concatenate(ends)

    def _by_kind(self, data, offsets):
        if self._table is None:
            self._table = np.repeat(self.kinds[1], self.kinds[0])
        points = _code_points(data.tobytes().decode())
        at = np.concatenate([[0], np.cumsum(_widths(points), dtype=np.int64)])
        n, kind = len(points), self._table[points]
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(at, offsets)] = True
        edge[n] = True
        begin = edge[:n].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # The last white space before other characters stands alone; a blank goes with what follows.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
        begin[last] = True
        begin[last + 1] = points[last] != 0x20
        # An apostrophe that begins a word takes one of the endings s t m d re ve ll.
        quote = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & ~edge[1:n])
        far = np.append(points, [0, 0])
        one, two = far[quote + 1], np.where(edge[np.minimum(quote + 2, n)], 0, far[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begin[quote[short | long] + 1] = False
        after = np.concatenate([quote[short] + 2, quote[long] + 3])
        begin[after[after < n]] = True
        starts = at[np.flatnonzero(begin)]
        return starts, np.append(starts[1:], len(data))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _widths(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)


def _take(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans ``which`` of an array that ``offsets`` (starts and ends) cuts, one after the other, and their sizes."""
    starts, ends = offsets
    size = ends[which] - starts[which]
    total = np.cumsum(size)
    return data[np.repeat(starts[which] - (total - size), size) + np.arange(total[-1] if len(total) else 0)], size


def _spans(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.cumsum(size, dtype=np.int64)
    return total - size, total


class Tokenizer:
    """Encoding and decoding. ``path`` is the rank file, ``pattern`` what cuts a text into words."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self.ranks = read_ranks(path or public_tokenizers.path(RANKS))
        self.cutter = Cutter(pattern or public_tokenizers.PATTERN)
        by_rank = {v: k for k, v in self.ranks.items()}
        #: Bytes of each id.
        self.pieces = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]


def fold_words(words: Column, maps: Column) -> Column:
    """Ids (array of arrays of int) of an array of words (binary); ``maps`` are the ranks as :func:`small_maps`."""
    def ids(rank):
        return F.transform(words, lambda word: _let(F.decode(word, LATIN), lambda w: _let(
            rank(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(fold(w, rank)))))

    return look_up(maps, ids)


def decode(ids: list[int], pieces: list[bytes]) -> bytes:
    """The bytes of ids, one piece after the other."""
    return b"".join(map(pieces.__getitem__, ids))


def _squeeze(data: np.ndarray) -> bytes:
    """Size and compressed bytes: shuffles of words and texts are this operator's disk."""
    return len(data).to_bytes(8, "little") + pa.compress(pa.py_buffer(data.tobytes()), codec="zstd", asbytes=True)


def _unsqueeze(held: bytes) -> bytes:
    return pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True)


PACKED = "run int, doc_ids binary, sizes binary, texts binary"


def _pack(batches):
    """The texts of a batch and a run as one compressed row; a null text is empty."""
    for batch in batches:
        run, doc_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "doc_id"))
        order = np.argsort(run, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(run[order])) + 1) if len(order) else ():
            data, offsets = tokens.flat(batch.column("text").take(pa.array(rows)))
            yield pa.RecordBatch.from_pydict({
                "run": pa.array([run[rows[0]]], pa.int32()), "doc_ids": pa.array([doc_ids[rows].astype(np.int64).tobytes()], pa.binary()),
                "sizes": pa.array([np.diff(offsets).astype(np.int64).tobytes()], pa.binary()),
                "texts": pa.array([_squeeze(data)], pa.binary())})


def _unpack(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts (binary) of a run."""
    doc_ids, sizes = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), np.int64) for c in ("doc_ids", "sizes"))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = b"".join(_unsqueeze(x.as_py()) for x in table.column("texts"))
    return doc_ids, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _words(column: pa.Array, cutter: Cutter):
    """Of a run: its bytes, byte ranges and hashes of its distinct words, which of them each word is, and the index of each text's first word.

    Words are made distinct piece by piece, so that ranges and hashes of all words are never held at once.
    """
    data, offsets = tokens.flat(column)
    kind = np.int32 if len(data) < 1 << 31 else np.int64   # A run has millions of words.
    starts, ends, hashes, backs, counts = [np.zeros(0, kind)], [np.zeros(0, kind)], [np.zeros(0, np.uint64)], [], [np.zeros(1, np.int64)]
    for at, rows in tokens.pieces(column, tokens.SMALL_PIECE):
        low, high = offsets[at], offsets[at + rows]
        part, edges = data[low:high], offsets[at:at + rows + 1] - low
        s, e = cutter.cut(part, edges)
        found, index, back = tokens.distinct(tokens.word_hashes(part, s, e))
        hashes.append(found)
        starts.append((s[index] + low).astype(kind))
        ends.append((e[index] + low).astype(kind))
        backs.append(back)
        counts.append(np.diff(np.searchsorted(s, edges)))
    sizes = list(map(len, hashes[1:]))
    hashes, index, back = tokens.distinct(np.concatenate(hashes))
    every = np.empty(sum(map(len, backs)), back.dtype)
    at = begin = 0
    for size, own in zip(sizes, backs):
        np.take(back[begin:begin + size], own, out=every[at:at + len(own)])
        at, begin = at + len(own), begin + size
    spans = (np.concatenate(starts)[index], np.concatenate(ends)[index])
    return data, spans, hashes, every, np.cumsum(np.concatenate(counts))


ASKED = "run int, bucket int, sizes binary, words binary"
#: ``long`` numbers the words of over FOLD_BYTES, whose ids are in ``joined``; one byte stands for each in ``words``.
MAPS = "array<map<string,int>>"
DISTINCT = f"bucket int, ranks {MAPS}, words array<binary>, runs array<int>, places array<binary>, long array<int>, joined array<binary>"
ANSWER = "run int, bucket int, sizes binary, ids binary"


def _with_ids(docs: DataFrame, tokenizer: Tokenizer, use, schema: str, run_bytes: int) -> DataFrame:
    """``use(doc_ids, sizes, ids)`` of every run: the number of ids of each text, and all ids."""
    runs = R.into_runs(docs.select("doc_id", "text"), run_bytes=run_bytes)
    # About one distinct word of a run for every 40 bytes.
    buckets = max(1, int(-(-runs.n_bytes // (40 * BUCKET_WORDS * runs.grown))))
    cutter, kind, ranks = tokenizer.cutter, np.min_scalar_type(len(tokenizer.pieces)), tokenizer.ranks

    def ask(table: pa.Table) -> pa.Table:
        run = table.column("run")[0].as_py()
        data, spans, hashes, *_ = _words(_unpack(table)[1], cutter)
        at = R.by_bucket(hashes, buckets)
        full = np.flatnonzero(np.diff(at))
        parts = [_take(data, spans, np.arange(at[b], at[b + 1])) for b in full]
        return pa.table({"run": pa.array([run] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
                         "sizes": pa.array([size.astype(np.int32).tobytes() for _, size in parts], pa.binary()),
                         "words": pa.array([_squeeze(words) for words, _ in parts], pa.binary())})

    def distinct(table: pa.Table) -> pa.Table:
        size = [np.frombuffer(x.as_py(), np.int32) for x in table.column("sizes")]
        data = np.frombuffer(b"".join(_unsqueeze(x.as_py()) for x in table.column("words")), np.uint8)
        spans = _spans(np.concatenate(size))
        _, index, back = tokens.distinct(tokens.word_hashes(data, *spans))
        starts, ends = spans[0][index], spans[1][index]
        long = np.flatnonzero(ends - starts > FOLD_BYTES)
        joined = [np.array(join_long(data[starts[i]:ends[i]].tobytes(), ranks), kind).tobytes() for i in long]
        ends[long] = starts[long] + 1
        words, sizes = _take(data, (starts, ends), np.arange(len(index)))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        every = pa.BinaryArray.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(ends), pa.py_buffer(words)])
        places = np.split(back.astype(np.int32), np.cumsum([len(s) for s in size])[:-1])
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "ranks": small_maps(ranks), "words": pa.ListArray.from_arrays([0, len(index)], every),
                         "runs": pa.array([table.column("run").to_pylist()], pa.list_(pa.int32())),
                         "places": pa.array([[p.tobytes() for p in places]], pa.list_(pa.binary())),
                         "long": pa.array([long.tolist()], pa.list_(pa.int32())), "joined": pa.array([joined], pa.list_(pa.binary()))})

    def reply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                ends = ids.offsets.to_numpy()
                flat = ids.values.to_numpy().astype(kind)
                spans = (ends[:-1].astype(np.int64), ends[1:].astype(np.int64))
                joined = [np.frombuffer(x.as_py(), kind) for x in batch.column("joined")[i]]
                size = np.array([len(x) for x in joined], np.int64)
                long = batch.column("long")[i].as_py()
                spans[1][long] = ends[-1] + np.cumsum(size)
                spans[0][long] = spans[1][long] - size
                flat = np.concatenate([flat, *joined])
                bucket = batch.column("bucket")[i].as_py()
                for run, place in zip(batch.column("runs")[i].as_py(), batch.column("places")[i]):
                    mine, size = _take(flat, spans, np.frombuffer(place.as_py(), np.int32))
                    yield pa.RecordBatch.from_pydict({
                        "run": pa.array([run], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                        "sizes": pa.array([size.astype(np.int32).tobytes()], pa.binary()),
                        "ids": pa.array([_squeeze(mine.view(np.uint8))], pa.binary())})

    def apply(documents: pa.Table, replies: pa.Table) -> pa.Table:
        doc_ids, texts = _unpack(documents)
        back, first = _words(texts, cutter)[3:]
        del texts
        replies = replies.sort_by("bucket")
        size = np.frombuffer(b"".join(x.as_py() for x in replies.column("sizes")), np.int32)
        spans, known = _spans(size), np.frombuffer(b"".join(_unsqueeze(x.as_py()) for x in replies.column("ids")), kind)
        doc_ids = [None if i == LOWEST else i for i in doc_ids.tolist()]
        return use(doc_ids, (_take(known, spans, back[a:b])[0] for a, b in zip(first[:-1].tolist(), first[1:].tolist())))

    packed = runs.rows.mapInArrow(_pack, PACKED)
    asked = packed.groupBy("run").applyInArrow(ask, ASKED)
    folded = (asked.groupBy("bucket").applyInArrow(distinct, DISTINCT)
              .select("bucket", fold_words(F.col("words"), F.col("ranks")).alias("ids"), "runs", "places", "long", "joined"))
    answers = folded.mapInArrow(reply, ANSWER)
    return packed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(apply, schema)


def encode(docs: DataFrame, tokenizer: Tokenizer | None = None, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, ids (array of int) of every row; a null or empty text has none. Other columns are not read.

    Whole texts are encoded, special tokens are ordinary text. Repeated rows give repeated results.
    A word of n bytes takes time n squared at worst up to FOLD_BYTES, n log n beyond; a word is held whole.
    """
    def use(doc_ids, texts):
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()),
                         "ids": pa.array([ids.astype(np.int32) for ids in texts], pa.list_(pa.int32()))})

    return _with_ids(docs, tokenizer or Tokenizer(), use, "doc_id bigint, ids array<int>", run_bytes)


def round_trip(docs: DataFrame, tokenizer: Tokenizer | None = None, run_bytes: int = R.RUN_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, as :func:`encode`; the ids are decoded again."""
    tokenizer = tokenizer or Tokenizer()
    pieces = tokenizer.pieces   # Only these go with the tasks.

    def use(doc_ids, texts):
        decimal = [str(i) for i in range(len(pieces))]
        rows = []
        for ids in texts:
            ids = ids.tolist()
            rows.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                         hashlib.sha256(decode(ids, pieces)).hexdigest()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                         "ids_sha256": pa.array([r[1] for r in rows], pa.string()),
                         "decoded_sha256": pa.array([r[2] for r in rows], pa.string())})

    return _with_ids(docs, tokenizer, use, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run_bytes)


def op9_hof_byte_bpe(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
