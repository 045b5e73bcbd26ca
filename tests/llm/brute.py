"""What the operators must return, computed plainly over a list of (doc_id, text)."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(i):
    return (i is not None, i or 0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def crc_fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def op1(rows, length=100):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w not in least or order(i) < least[w]:
                least[w] = order(i)
    out = []
    for i, t in rows:
        b, seen = (t or "").encode(), set()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if least[w] < order(i) or w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for key, _ in itertools.groupby(gone) if key)
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def op2_sizes(rows):
    return [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]


def op4(rows):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = []
    for i, t in rows:
        t = t or ""
        a = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[1]) >= 12]
        b = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        c = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        kinds = ["assign", "access", "hex"]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(a + b + c, key=lambda x: (x[1], kinds.index(x[0]))))
        out.append((i, len(a), len(b), len(c), sha(text)))
    return out


def weak(text, reach=200):
    """Added spans of one text: all pairs of parts, plainly."""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{14,}", text)]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    found = [("ident", m.start(), m.end()) for m in re.finditer(r"\b[A-Z][A-Z0-9]{15,31}\b", text, re.A) if re.search("[0-9]", m[0])]
    found += [("opaque", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", text)
              if len(m[0]) <= 88 and all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]"))]
    found += [("endpoint", m.start(), m.end()) for m in re.finditer(r"\b(?:https?|ftp|s3|wss?)://[^\x00-\x20\"'<>]{4,}", text, re.A)]
    found = [w for w in found if not any(w[1] < b[2] and b[1] < w[2] for b in spans)]
    near = lambda a, b: b[1] < a[2] + reach and a[1] < b[2] + reach
    every, out = spans + found, set()
    for i in (x for x in every if x[0] in ("access", "ident")):
        for p in (x for x in every if x[0] in ("assign", "hex", "opaque")):
            if not near(i, p) or not (i[2] <= p[1] or p[2] <= i[1]):
                continue
            ends = [e for e in every if e[0] == "endpoint" and near(i, e)]
            if i[0] == "access" or p[0] != "opaque" or ends:
                out |= {x for x in (i, p, *ends) if x[0] in ("ident", "opaque", "endpoint")}
    return out


def op5(rows, length=13):
    least = {}
    split = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            x = tuple(w[k:k + length])
            if x not in least or order(i) < least[x]:
                least[x] = order(i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if least[tuple(w[k:k + length])] < order(i):
                gone[k:k + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def op6(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        where = defaultdict(list)
        for k in range(len(w) - 7):
            where[tuple(w[k:k + 8])].append(k)
        hit = {p for places in where.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
                    len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    return out


def op7(rows, items, window=13):
    phrases = defaultdict(set)
    for k, t in items:
        w = ALNUM_WORD.findall(lower(t or ""))
        span = min(window, len(w))
        for p in range(len(w) - span + 1 if span else 0):
            phrases[tuple(w[p:p + span])].add(str(k))
    sizes = {len(p) for p in phrases}
    out = []
    for i, t in rows:
        w = ALNUM_WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in phrases:
                    hit |= set(range(p, p + n))
                    found |= phrases[tuple(w[p:p + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fingerprint(t):
    w = SPACE_WORD.findall(lower(t or ""))
    s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def op8(rows):
    prints = [fingerprint(t) for _, t in rows]
    kinds = sorted(set(prints))
    root = {k: k for k in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(kinds, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [(i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)]


def op9(rows, encoding):
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    return out


def op10_base(rows):
    toks = [(i, SPACE_WORD.findall(lower(t or "")) + [None]) for i, t in rows]
    c = Counter(w for i, ws in toks if crc_fold(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, crc_fold(i, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n,
             round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in toks]
