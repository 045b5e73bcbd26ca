"""Header parsing and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import plain_ascii, rx
from ..functions.times import build_inner_ts, inner_ts_parts
from .once import compute_once

# Fixed value: the syslog header. Groups: ip, hostname, location, inner time, facility,
# subfacility, severity, mnemonic, message.
HEADER = (
    r"^\w+\s+\d+\s+\d{2}:\d{2}:\d{2}\s+(\d+\.\d+\.\d+\.\d+)\s+\d+:"
    r"(?:\s+([A-Z][A-Z0-9_-]+))?"
    r"\s+((?:RP|LC)/\d+/[A-Z0-9]+/[A-Z0-9]+|0/RP\d+/ADMIN\d+)"
    r":(.+?):\s+\S+\[\d+\]:\s+"
    r"%([A-Z][A-Z0-9_]*)-([A-Z][A-Z0-9_]*)-(\d)-([A-Z0-9_]+)\s+:\s+(.+)\n?\z"
)
_FIELDS = ["source_ip", "hostname", "rp_location", "inner_ts", "facility", "subfacility",
           "severity", "mnemonic", "message"]
_SEP = "\x1f"
_MARK = "\x1eHDR"


def _header(raw: Column) -> Column:
    """``[mark, fields...]`` from one regex pass, or an array without the mark when nothing matches.

    The pass rewrites the line to ``mark|field|...``. Lines that are not plain ASCII, or that hold
    the separator, take one extraction per field with the Unicode pattern instead, so no input can
    forge a field.
    """
    groups = _SEP.join([_MARK] + [f"${i}" for i in range(1, 10)])
    fast = F.split(F.regexp_replace(raw, rx(HEADER, ascii_only=True), groups), _SEP, 10)
    exact = rx(HEADER)
    slow = F.when(
        raw.rlike(exact), F.array(F.lit(_MARK), *[F.regexp_extract(raw, exact, i) for i in range(1, 10)])
    )
    return F.when(plain_ascii(raw), fast).otherwise(slow)


def _reason(raw: Column, matched: Column, ts: Column, max_length: int) -> Column:
    return (
        F.when(raw.isNull() | ~raw.rlike(r"(?U)\S"), "empty")
        .when(F.length(raw) > max_length, "too_long")
        .when(~F.coalesce(matched, F.lit(False)), "no_match")
        .when(ts.isNull(), "bad_timestamp")
    )


def parse_lines(lines: DataFrame, as_of, raw: str = "raw", max_length: int = fixed.MAX_LINE_LEN) -> DataFrame:
    """Every line with its header columns and ``reject_reason`` (NULL for a good line).

    ``as_of`` is a moment or a Column (the ingest time of each row in a stream). A line of more than
    ``max_length`` characters is not parsed but kept whole, with its reason.
    """
    guarded = F.when(F.length(raw) <= max_length, _header(F.col(raw)))
    df = compute_once(lines, {"_h": guarded})
    matched = F.get("_h", F.lit(0)) == _MARK
    df = compute_once(df, {"_t": F.when(matched, inner_ts_parts(F.get("_h", F.lit(4))))})
    df = compute_once(df, {"timestamp": build_inner_ts(F.col("_t"), as_of)})
    cols = [F.get("_h", F.lit(i)).alias(n) for i, n in enumerate(_FIELDS, 1)]
    df = df.select("*", *cols, _reason(F.col(raw), matched, F.col("timestamp"), max_length).alias("reject_reason"))
    return df.withColumn("severity_level", F.col("severity").try_cast("int")).drop(
        "_h", "_t", "inner_ts", "severity"
    )


def parse(lines: DataFrame, as_of, raw: str = "raw") -> DataFrame:
    """P1+P2: the lines that parse."""
    return parse_lines(lines, as_of, raw).where("timestamp IS NOT NULL").drop("reject_reason")


def quarantine(lines: DataFrame, as_of, raw: str = "raw") -> DataFrame:
    """The lines that do not parse, with the reason."""
    return parse_lines(lines, as_of, raw).where("reject_reason IS NOT NULL").select(
        *lines.columns, "reject_reason"
    )
