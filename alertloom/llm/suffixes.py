"""Substring dedup on bytes: a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Only suffixes that can
have a partner are sorted:

1. Every string of LENGTH bytes has an anchor: of its ANCHOR-byte grams the one with the smallest
   hash, the leftmost of equal ones. Equal strings have equal anchors at equal places. One
   exchange of anchor hashes tells each run which of its anchors other runs have too.
2. A run settles what repeats inside it. Of each string that is left, the first one is kept, and
   strings that follow each other with the same anchor are one element: the suffix at the anchor,
   as far as the last string reaches, and the bytes before it from where the first one starts.
3. A run sorts its elements by suffix and sends them front-coded (length of the prefix shared with
   the suffix before, and the rest) to the tasks that hold the ranges of the key space.
4. A task merges its sorted runs with a loser tree. Each contender carries the length of the
   prefix it shares with the last winner: if two lengths differ, the longer one wins unseen, and
   if they are equal, comparison starts behind them. So no known prefix is compared again.
5. Neighbours of the merged order that share an anchor are a group. Within it equal strings are
   found, and all but those of the earliest run are reported back to their runs.

Suffixes with one anchor are in one task, but a run sends each string once, however often it holds it.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import runs as R, tokens

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, ANCHOR = 100, 32
RUN_BYTES = 2 << 20
#: Strings that one step of a merge task compares at once, and bytes of elements that it hashes at once.
STEP, STEP_BYTES = 1 << 18, 1 << 19
LOWEST = -(1 << 63)
OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"
REPLY = "run int, bucket int, n int, answer binary"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def string_starts(offsets: np.ndarray) -> np.ndarray:
    """Start of every LENGTH-byte string inside a text."""
    n = int(offsets[-1])
    if n < LENGTH:
        return np.zeros(0, np.int64)
    inside = np.ones(n - LENGTH + 1, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1):end] = False
    return np.flatnonzero(inside)


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray):
    """(strings, place, hash) of every anchor: how many LENGTH-byte strings, by start, have it after each other."""
    n, start = len(data), string_starts(offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    grams = tokens.gram_hashes(sums, ANCHOR)
    # The place in the low bits makes the leftmost of equal hashes the least; a piece may be one long text.
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = grams & ~low
    least |= np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(least, LENGTH - ANCHOR + 1)
    least &= low
    place = least[start].view(np.int64)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    place = place[begin]
    kind = np.min_scalar_type(-n)
    # The least of many hashes is small: mixed again, anchors fill all buckets of the hash space alike.
    return np.diff(begin, append=len(start)).astype(kind), place.astype(kind), tokens.mix(grams[place])


class Run:
    """The strings of a run that repeat in it or whose anchor another run has, and its elements."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("doc_id")  # so places ascend with (id, row, start)
        self.column = table.column("text").combine_chunks()
        self.ids = table.column("doc_id").to_numpy()

    def pieces(self):
        base = row = 0
        for at, rows in tokens.pieces(self.column, tokens.SMALL_PIECE):
            data, offsets = tokens.flat(self.column.slice(at, rows))
            yield base, row, data, offsets
            base += len(data)
            row += rows

    def anchored(self):
        """For each piece: where its bytes and rows begin, its bytes and rows, and its anchors."""
        for base, row, data, offsets in self.pieces():
            yield base, row, data, offsets, *anchors(data, offsets, tokens.prefix_sums(tokens.BYTE_CODE[data], tokens.BYTE_BASE))

    def anchor_hashes(self) -> np.ndarray:
        """Sorted distinct anchor hashes."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[-1] for x in self.anchored())]))

    def study(self, elsewhere: np.ndarray) -> None:
        """``elsewhere``: for each of the run's anchor hashes, whether another run has it."""
        found = list(self.anchored())
        hashes = np.concatenate([np.zeros(0, np.uint64), *(x[-1] for x in found)])
        _, back, n = np.unique(hashes, return_inverse=True, return_counts=True)
        other = elsewhere[back]
        keep = (n > 1)[back] | other
        del hashes, back, n
        # A run has millions of strings: what is held of each is as narrow as it can be.
        strings = sum(int(x[4][keep[at:at + len(x[4])]].sum()) for x, at in zip(found, np.cumsum([0, *(len(x[4]) for x in found)])))
        kind = np.int32 if sum(len(x[2]) for x in found) < 1 << 31 else np.int64
        self.start, gap, own = np.empty(strings, kind), np.empty(strings, np.uint8), np.empty(strings, np.int32)
        h, shared, at, done = np.empty(strings, np.uint64), np.empty(strings, bool), 0, 0
        for base, row, data, offsets, size, place, _ in found:
            mine = slice(done, done + len(size))
            done += len(size)
            s = string_starts(offsets)[np.repeat(keep[mine], size)]
            size, place = size[keep[mine]], place[keep[mine]]
            part = slice(at, at + len(s))
            at += len(s)
            self.start[part] = s + base
            gap[part] = np.repeat(place, size) - s
            own[part] = row + np.searchsorted(offsets, s, "right") - 1
            h[part] = tokens.span_hashes(tokens.prefix_sums(tokens.BYTE_CODE[data], tokens.BYTE_BASE), s, s + LENGTH, tokens.BYTE_BASE)
            shared[part] = np.repeat(other[mine][keep[mine]], size)
        del found, keep, other
        # One of equal strings is first: that of the smallest id, then row, then start. Ids that are equal are not earlier.
        order = tokens.ascending(h).astype(kind)
        h = h[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        del h
        group = np.cumsum(first, dtype=kind) - kind(1)
        r = own[order]
        # Ids by rank, as they may be any numbers.
        rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)[r]
        later = rank > rank[first][group]
        del rank
        later[1:] |= ~first[1:] & (r[1:] == r[:-1])
        del r
        self.later, self.kind = np.empty(strings, bool), np.empty(strings, kind)
        self.later[order] = later
        self.kind[order] = group
        lead = np.zeros(strings, bool)
        lead[order[first]] = True
        lead &= shared
        del order, first, group, later, shared
        # Elements: leading strings that follow each other in a row with one anchor.
        at = np.flatnonzero(lead).astype(kind)
        s, own = self.start[at], own[at]
        a = s + gap[at]
        new = np.ones(len(at), bool)
        new[1:] = (s[1:] != s[:-1] + 1) | (a[1:] != a[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(new)
        #: Strings of each element: those from begin to end of ``leading``.
        self.leading, self.begin, self.end = at, begin, np.append(begin[1:], len(at))[:len(begin)]
        self.low, self.high, self.anchor = s[begin], s[self.end - 1], a[begin]

    def elements(self) -> list[tuple[bytes, bytes]]:
        """(suffix, left part) of every element."""
        text = b"".join(data.tobytes() for _, _, data, _ in self.pieces())
        return [(text[p:y + LENGTH], text[x:p]) for x, y, p in zip(self.low.tolist(), self.high.tolist(), self.anchor.tolist())]


def dealt(elements: list[tuple[bytes, bytes]], cuts: list[bytes]) -> dict[int, list[int]]:
    """Numbers of the elements of each range of the key space, in suffix order; one gram's suffixes share a range."""
    out: dict[int, list[int]] = {}
    for i in sorted(range(len(elements)), key=elements.__getitem__):
        out.setdefault(bisect_right(cuts, elements[i][0][:ANCHOR]), []).append(i)
    return out


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, which is at least ``known``."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known:known + step] == b[known:known + step]:
        known += step
    x = int.from_bytes(a[known:known + step].ljust(step, b"\0"), "big") ^ int.from_bytes(b[known:known + step].ljust(step, b"\0"), "big")
    return min(n, known + (8 * step - x.bit_length()) // 8) if x else min(n, known + step)


def front_code(elements: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted block: per element the shared prefix, the suffix's and the left part's length, then the texts."""
    lengths, texts, last = bytearray(), [], b""
    for suffix, left in elements:
        common = shared_prefix(last, suffix, 0)
        lengths += bytes((common, len(suffix), len(left)))
        texts += (suffix[common:], left)
        last = suffix
    return bytes(lengths) + b"".join(texts)


def read_front_coded(block: bytes, n: int):
    """(suffix, prefix shared with the suffix before, left part) of a block of ``n``, one at a time."""
    at, last = 3 * n, b""
    for i in range(0, 3 * n, 3):
        common, size, before = block[i], block[i + 1], block[i + 2]
        last = last[:common] + block[at:at + size - common]
        at += size - common
        yield last, common, block[at:at + before]
        at += before


def merge(blocks: list[tuple[bytes, int]]):
    """(suffix, prefix shared with the one before, left part, block, number in it) of all blocks in suffix order.

    A loser tree: an inner node holds the loser of its match with the prefix it shares with the winner.
    """
    count = len(blocks)
    size = 1
    while size < count:
        size *= 2
    source = [read_front_coded(*b) for b in blocks] + [iter(())] * (size - count)
    number = [-1] * size
    head: list = [None] * size   # suffix; None is after all others
    left: list = [b""] * size
    common = [0] * size          # with the last winner
    loser = [0] * size

    def advance(k: int) -> None:
        item = next(source[k], None)
        number[k] += 1
        if item is None:
            head[k], common[k] = None, -1
        else:
            head[k], common[k], left[k] = item

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both know their prefix shared with the last winner."""
        x, y = common[a], common[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if head[a] is None:
            return a, b
        s, t = head[a], head[b]
        n = shared_prefix(s, t, x)
        if n == len(s) and n == len(t):
            first = a < b
        else:
            first = n == len(s) or n < len(t) and s[n] < t[n]
        if first:
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    for k in range(size):
        advance(k)
    best = list(range(size))
    level, base = best, size
    while len(level) > 1:
        base //= 2
        level = [0] * base
        for j in range(base):
            level[j], loser[base + j] = match(best[2 * j], best[2 * j + 1])
        best = level
    winner = best[0]
    while head[winner] is not None:
        yield head[winner], common[winner], left[winner], winner, number[winner]
        advance(winner)
        node = (winner + size) // 2
        while node:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


def earlier_strings(group: list[tuple[int, int, bytes, bytes]], flags: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Marks in ``flags`` of a block the strings of the elements that an element of an earlier block has too.

    Those of a block are one array, with where each element's strings begin.

    ``group`` holds (block, number, suffix, left part) of whole anchor groups; blocks ascend with the
    runs. Strings are compared a few offsets from the anchor at a time, as equal strings have equal offsets.
    """
    block = np.array([x[0] for x in group])
    text = [left + suffix for _, _, suffix, left in group]
    before = np.array([len(x[3]) for x in group])
    size = np.array([len(t) for t in text])
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    total = int(strings.sum())
    mark, hashes = np.zeros(total, np.uint8), np.empty(total, np.uint64)
    first = np.cumsum(strings) - strings
    # An element may be a hundred bytes for one string, and a byte takes several numbers.
    edges = [*np.flatnonzero(np.diff(begin // STEP_BYTES, prepend=-1)).tolist(), len(group)]
    for a, b in zip(edges[:-1], edges[1:]):
        data = np.frombuffer(b"".join(text[a:b]), np.uint8)
        n = strings[a:b]
        at = np.arange(int(n.sum())) + np.repeat(begin[a:b] - begin[a] - (np.cumsum(n) - n), n)
        sums = tokens.prefix_sums(tokens.BYTE_CODE[data], tokens.BYTE_BASE)
        hashes[first[a]:first[a] + len(at)] = tokens.span_hashes(sums, at, at + LENGTH, tokens.BYTE_BASE)
    del text
    width = max(1, STEP // len(group))
    for low in range(0, LENGTH - ANCHOR + 1, width):
        # Offsets low .. low + width - 1: the anchor's distance from the string's start.
        far, near = before - low, before - np.minimum(before, low + width - 1)
        from_, to = np.maximum(near, 0), np.minimum(far, strings - 1)
        n = np.maximum(0, to - from_ + 1)
        if not n.any():
            continue
        who = np.repeat(np.arange(len(group)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + from_[who]
        at = first[who] + j
        h = hashes[at]
        order = np.lexsort((block[who], h))
        h, b = h[order], block[who][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        mark[at[order[b > b[lead]]]] = 1
    for i, (k, number, _, _) in enumerate(group):
        found, begins = flags[k]
        found[begins[number]:begins[number + 1]] = mark[first[i]:first[i] + strings[i]]


def compare(blocks: list[tuple[bytes, int]]) -> list[bytes]:
    """For each block, a flag for each string of its elements in order: whether an earlier block has it."""
    flags = []
    for b, n in blocks:
        strings = np.frombuffer(b, np.uint8, 3 * n).reshape(-1, 3)[:, 1:].sum(1, dtype=np.int64) - LENGTH + 1
        flags.append((np.zeros(int(strings.sum()), np.uint8), np.concatenate([[0], np.cumsum(strings)])))
    waiting: list = []
    group: list = []
    held = 0

    def close():
        nonlocal waiting, group, held
        if len({x[0] for x in group}) > 1:
            waiting += group
            held += sum(len(x[2]) + len(x[3]) for x in group)
        group = []

    for suffix, common, left, block, number in merge(blocks):
        if common < ANCHOR:
            close()
            if held >= STEP_BYTES:
                earlier_strings(waiting, flags)
                waiting, held = [], 0
        group.append((block, number, suffix, left))
    close()
    if waiting:
        earlier_strings(waiting, flags)
    return [np.packbits(f).tobytes() for f, _ in flags]


def _cuts(docs: DataFrame, parts: int, per_part: int = 64) -> list[bytes]:
    """Borders of the key space: ANCHOR bytes from hashed places of about ``per_part`` texts for each part."""
    if parts < 2:
        return []
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - ANCHOR))
    rows = docs.where(F.length("text") > ANCHOR)
    n = max(1, rows.count())
    share = min(1 << 30, (1 << 30) * parts * per_part // n)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    found = sorted(r["g"].encode("utf-8", "surrogatepass")[:ANCHOR] for r in some.select(
        F.substring(F.col("text"), (place + 1).cast("int"), F.lit(ANCHOR)).alias("g")).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _anchored_elsewhere(_, hashes, __):
    """For each hash of each run, whether another run has it."""
    order, _, begins = R.merged(hashes)
    n = np.diff(np.append(begins, len(order)))
    return R.split_back(np.repeat(n > 1, n).astype(np.uint8), order, hashes)


def deduplicate(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes, end exclusive) of every row.

    Texts are UTF-8 bytes; a null text is empty; a text shorter than LENGTH loses nothing. Rows with
    the same id are not earlier than each other, so repeated rows have equal results; a null id is
    smaller than all others. Other columns are not read. Equal strings are told by a 64-bit hash.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    runs = R.into_runs(docs, run_bytes=run_bytes)
    # A run sends a block to every range.
    cuts = _cuts(docs, -(-runs.runs // 2))

    # One anchor for every 35 bytes.
    blocks = R.asked(runs, runs.buckets(runs.n_bytes / 35), lambda table: (Run(table).anchor_hashes(), None))
    known = R.answered(blocks, _anchored_elsewhere)

    def flags_of(replies: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(x.as_py() for x in replies.sort_by("bucket").column("answer")), np.uint8).astype(bool)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        run = Run(table)
        run.study(flags_of(replies))
        elements = run.elements()
        del run
        parts = dealt(elements, cuts)
        # The numbers of the elements go along and come back, so the run need not sort again.
        return pa.table({
            "run": pa.array([table.column("run")[0].as_py()] * len(parts), pa.int32()), "bucket": pa.array(list(parts), pa.int32()),
            "n": pa.array([len(x) for x in parts.values()], pa.int32()),
            "answer": pa.array([R.squeezed(np.array(x, np.int32).tobytes() + front_code([elements[i] for i in x])) for x in parts.values()], pa.binary())})

    def merge_range(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        numbers, blocks = [], []
        for x, n in zip(table.column("answer"), table.column("n").to_pylist()):
            sent = R.unsqueezed(x.as_py())
            numbers.append(sent[:4 * n])
            blocks.append((sent[4 * n:], n))
        table = table.drop_columns("answer")
        found = [x + flags for x, flags in zip(numbers, compare(blocks))]
        # Ranges have negative numbers among the answers, so a run tells them from the buckets.
        return pa.table({"run": table.column("run").cast(pa.int32()),
                         "bucket": pa.array([-1 - b for b in table.column("bucket").to_pylist()], pa.int32()),
                         "n": table.column("n").cast(pa.int32()), "answer": pa.array(found, pa.binary())})

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = replies.column("bucket").to_numpy()
        run = Run(table)
        run.study(flags_of(replies.filter(pa.array(bucket >= 0))))
        gone = run.later
        known_kind = np.zeros(int(run.kind.max()) + 1 if len(run.kind) else 0, bool)
        for b, n, answer in zip(bucket.tolist(), replies.column("n").to_pylist(), replies.column("answer")):
            if b >= 0:
                continue
            elements = np.frombuffer(answer.as_py()[:4 * n], np.int32)
            size = (run.end - run.begin)[elements]
            strings = run.leading[np.arange(int(size.sum())) + np.repeat(run.begin[elements] - (np.cumsum(size) - size), size)]
            found = np.unpackbits(np.frombuffer(answer.as_py()[4 * n:], np.uint8))[:len(strings)].astype(bool)
            known_kind[run.kind[strings[found]]] = True
        start = run.start[gone | known_kind[run.kind]] if len(gone) else run.start
        out = []
        for base, _, data, offsets in run.pieces():
            mine = start[(start >= base) & (start < base + len(data))] - base
            lost = tokens.cover(mine, mine + LENGTH, len(data))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                low, high = tokens.spans_of(lost[a:b])
                out.append((b - a, int(lost[a:b].sum()), len(low),
                            hashlib.sha256(data[a:b][~lost[a:b]].tobytes()).hexdigest(), low.tolist(), high.tolist()))
        ids = [None if i == LOWEST else i for i in run.ids.tolist()]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({"doc_id": pa.array(ids, pa.int64())} | {
            n: pa.array(c, k) for n, c, k in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"), cols, kinds)})

    sent = runs.rows.groupBy("run").cogroup(known.groupBy("run")).applyInArrow(send, REPLY)
    reported = sent.groupBy("bucket").applyInArrow(merge_range, REPLY)
    return runs.rows.groupBy("run").cogroup(known.withColumn("n", F.lit(0)).select("run", "bucket", "n", "answer").unionByName(reported).groupBy("run")).applyInArrow(finish, OUT)


def op1_suffix_merge_dedup(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
