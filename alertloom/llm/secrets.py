"""Secret scans with DataFrame functions only: strong patterns, and weak parts that complement each other.

A credential has parts: an identifier, a secret and an endpoint. Strong parts are reported
wherever they are (``assign``, ``access``, ``hex``). Weak parts (``ident``: an upper-case
identifier, ``opaque``: a long mixed token, ``endpoint``: a URL) are ordinary text alone. They are
cut into rows and joined by interval within their scope, and are reported only where the parts
complement each other: an identifier and a secret of which one is strong, or two weak ones with an
endpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import fresh, materialize

ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of 16 and more are those of HEX that pass its length test; no match is lost or gained.
HEX_LONG = r"[0-9a-f]{16,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
IDENT = r"\b[A-Z][A-Z0-9]{15,}\b"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
ENDPOINT = r"\b(?:https?|ftp|s3|wss?)://[^\x00-\x20\"'<>]{4,}"

#: Code points between two parts of one credential at most: the scope of a part.
REACH = 200
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
MASK = "[REDACTED]"


#: Items of a block of :func:`_folded`.
FOLDED = 256


def _folded(items: Column, kind: str, step) -> Column:
    """What ``step`` appends over the items, as an array of ``kind``.

    ``step(at, item)`` gives the next running place and the element. Appending copies an array, so items are
    folded in blocks, and the blocks' arrays are put together at the end.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(acc, x):
        at, element = step(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], element).alias("out"))

    def across(acc, block):
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), within)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out"))), 1)

    def all_blocks(held):
        """The items are bound by a lambda, so that they are computed once and not for every block."""
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / FOLDED).cast("int"), F.lit(1)),
                           lambda b: F.slice(held, b * FOLDED + 1, F.lit(FOLDED)))

    blocks = F.element_at(F.transform(F.array(items), all_blocks), 1)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(blocks, begin, across, lambda acc: F.flatten(acc["out"]))


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """(start, end, match) of every match, in code points: matches alternate with the pieces that split() leaves."""
    def step(at, pair):
        start = at + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return end, F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))

    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("gap"), matches.alias("match"))
    return F.when(F.size(matches) > 0, _folded(pairs, "struct<start:bigint,end:bigint,match:string>", step)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


def _touched(span: Column, spans: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and apart from each other: the last that begins before its end."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(25))))
    before = F.aggregate(steps, F.lit(0), lambda n, k: F.when(
        F.get(spans, n + k - 1)["start"] < span["end"], n + k).otherwise(n))
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, before - 1)["end"] > span["start"], F.lit(False))


def _spans(located: Column, kind: str, keep=None) -> Column:
    kept = F.filter(located, keep) if keep else located
    return F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))).cast(SPANS)


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (hashes of the text), base and weak spans of every row."""
    # Scanning needs only these columns; each list of matches is computed once and located where there is one.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS_LONG, "hex": HEX_LONG, "ident": IDENT, "opaque": OPAQUE, "endpoint": ENDPOINT}
    rows = rows.select("doc_id", "text", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()))
    at = {k: _located(text, F.col(k), p) for k, p in patterns.items()}
    weak = F.concat(
        _spans(at["ident"], "ident", lambda x: x["match"].rlike("[0-9]")),
        _spans(at["opaque"], "opaque", lambda x: _mixed(x["match"])), _spans(at["endpoint"], "endpoint"))
    rows = rows.select(
        "doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"),
        _spans(at["assign"], "assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 12).alias("assign"),
        _spans(at["access"], "access").alias("access"), _spans(at["hex"], "hex").alias("hex"), weak.alias("weak"))
    # A weak span that touches a base one is that secret itself.
    apart = F.filter("weak", lambda w: ~(_touched(w, F.col("assign")) | _touched(w, F.col("access")) | _touched(w, F.col("hex"))))
    return rows.select("doc_id", "k1", "k2", F.concat("assign", "access", "hex").alias("base"),
                       F.when(F.size("weak") > 0, apart).otherwise(F.col("weak")).alias("weak"))


def linked(rows: DataFrame, reach: int = REACH) -> DataFrame:
    """k1, k2, more: the weak spans of each text that complement another part within ``reach`` code points.

    Parts meet by equality of the text and of a bin of ``reach`` code points, then by their
    intervals. Two parts of one text meet only near each other, so a long text is many small groups.
    """
    part = (rows.where(F.size("weak") > 0).select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s"))
            .select("k1", "k2", "s.*").distinct())
    ident = part.where(F.col("rank").isin(1, 3))
    secret = part.where(F.col("rank").isin(0, 2, 4))
    end = part.where(F.col("rank") == 5)

    def spread(df, name, margin):
        """The span as a struct, once in every bin that it or its margin touches."""
        low = F.greatest(F.lit(0), F.col("start") - margin)
        bins = F.sequence(F.floor(low / reach), F.floor((F.col("end") + margin) / reach))
        return df.select("k1", "k2", F.struct("start", "rank", "end").alias(name), F.explode(bins).alias("bin"))

    def near(a, b):
        a, b = F.col(a), F.col(b)
        return (b["start"] < a["end"] + reach) & (a["start"] < b["end"] + reach)

    apart = (F.col("i.end") <= F.col("p.start")) | (F.col("p.end") <= F.col("i.start"))
    at = ["k1", "k2", "bin"]
    pairs = (spread(ident, "i", reach).join(spread(secret, "p", 0), at).where(near("i", "p") & apart)
             .select("k1", "k2", "i", "p").distinct())
    around = (pairs.select("k1", "k2", "i", "p", F.explode(F.sequence(
        F.floor(F.greatest(F.lit(0), F.col("i.start") - reach) / reach), F.floor((F.col("i.end") + reach) / reach))).alias("bin")))
    met = around.join(spread(end, "e", 0), at, "left").where(F.col("e").isNull() | near("i", "e"))
    strong = (F.col("i.rank") < 3) | (F.col("p.rank") < 3)
    said = (met.where(strong | F.col("e").isNotNull())
            .select("k1", "k2", F.explode(F.array("i", "p", "e")).alias("s")).where("s.rank >= 3").distinct())
    return said.groupBy("k1", "k2").agg(F.collect_list("s").alias("more"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, k1, k2, base, spans: all reported spans of every row, ordered by start, then kind, then end.

    Positions are code points, the end exclusive. A null text is empty and has no span. Repeated
    rows have equal spans: a text's parts are linked once, by a 128-bit hash of the text. Whole
    texts are scanned; a text's spans are the only list held at once. Other columns are not read.
    """
    rows = materialize(candidates(docs, id_col, text_col), "secret-spans")
    none = F.array().cast(SPANS)
    return rows.join(linked(rows, reach), ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", F.array_sort("base").alias("base"),
        F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _listed(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column) -> Column:
    """(start, end) of the unions of spans that overlap, for spans in order of their starts.

    The fold marks each span with the furthest end before it; a span that begins at or behind that begins a union.
    """
    seen = _folded(spans, "struct<start:bigint,before:bigint>", lambda at, s: (
        F.greatest(at, s["end"]), F.struct(s["start"].alias("start"), at.alias("before"))))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))

    def unions(first):
        ends = F.concat(F.slice(F.transform(first, lambda x: x["before"]), F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), F.array(last))
        return F.arrays_zip(F.transform(first, lambda x: x["start"]).alias("start"), ends.alias("end"))

    return F.element_at(F.transform(F.array(F.filter(seen, lambda x: x["start"] >= x["before"])), unions), 1)


#: Code points of a block of a text that is cut into pieces.
CUT = 256


def _between(text: Column, spans: Column) -> Column:
    """The pieces of a text before, between and behind spans that are in order and apart.

    Finding a code point counts from the front, so the text is cut into blocks of CUT code points first.
    """
    def pieces(blocks):
        def piece(low, high):
            first, last = F.floor(low / CUT).cast("int"), F.floor(high / CUT).cast("int")
            block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
            at, to = (low % CUT).cast("int"), (high % CUT).cast("int")
            return F.when(first == last, F.substring(block(first), at + 1, to - at)).otherwise(F.concat(
                F.substring(block(first), at + 1, F.lit(CUT)),
                F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.substring(block(last), F.lit(1), to)))

        zero, n = F.array(F.lit(0).cast("bigint")), F.array(F.length(text).cast("bigint"))
        ends = F.concat(zero, F.transform(spans, lambda s: s["end"]))
        starts = F.concat(F.transform(spans, lambda s: s["start"]), n)
        return F.transform(F.arrays_zip(ends.alias("low"), starts.alias("high")), lambda x: piece(x["low"], x["high"]))

    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % CUT), F.lit(0))), pieces), 1)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every reported span replaced by MASK; a null text stays null.

    All columns stay, whatever their names. ``n_chars`` follows the text where it is a column.
    """
    found = scan(docs, id_col, text_col).where(F.size("spans") > 0).select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    a, b, c = (fresh(docs, n) for n in ("_k1", "_k2", "_spans"))
    # A text is in `found` under its hashes only; rows without a span leave the join as they came.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(1), text)})
    joined = keyed.join(found.toDF(a, b, c), [a, b], "left")
    source = F.col(text_col)
    clean = F.array_join(_between(source, _apart(F.col(c))), MASK)
    out = {text_col: F.when(F.col(c).isNull() | source.isNull(), source).otherwise(clean)}
    masked_rows = joined.withColumns(out)
    if "n_chars" in docs.columns:
        masked_rows = masked_rows.withColumn("n_chars", F.when(F.col(c).isNull(), F.col("n_chars")).otherwise(
            F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType)))
    return masked_rows.select(*docs.columns)


def op4_multipart_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")
    return found.select(
        F.col("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
