"""Filtered, newest-first reads. Limits here are the feature: a page or a top list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed
from ..functions.times import in_period


def period_filter(alerts: DataFrame, period: str, as_of) -> DataFrame:
    """P22."""
    return in_period(alerts, period, as_of)


def search_alerts(alerts: DataFrame, query: str = "", tab: str = "all") -> DataFrame:
    """Case-insensitive literal substring over the text fields, and one class."""
    out = alerts if tab == "all" else alerts.where(F.col("classification") == tab)
    if not query:
        return out
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("device_name", "mnemonic", "message", "as_name", "client_name")]
    return out.where(F.lower(F.concat_ws(" ", *parts)).contains(query.lower()))


def newest(df: DataFrame, ts: str, tie: str, n: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(F.desc(ts), F.desc(tie))
    return (out.offset(offset) if offset else out).limit(n)


def alerts_page(alerts: DataFrame, as_of, severity: str | None = None, device: str | None = None,
                period: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Q1: conjunctive filters, newest first, one page."""
    if severity is not None and severity not in fixed.CLASSES:
        raise ValueError(f"invalid severity {severity!r}, expected one of {fixed.CLASSES}")
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    if offset < 0:
        raise ValueError("offset must not be negative")
    out = alerts
    if severity is not None:
        out = out.where(F.col("classification") == severity)
    if device is not None:
        out = out.where(F.col("device_name") == device)
    if period is not None:
        out = in_period(out, period, as_of)
    return newest(out, "timestamp", "alert_id", limit, offset)


def alerts_by(alerts: DataFrame, column: str, value: str, n: int = 100) -> DataFrame:
    """Q2: newest alerts by ``classification``, ``device_name`` or ``incident_id``."""
    if column not in ("classification", "device_name", "incident_id"):
        raise ValueError(f"cannot read alerts by {column!r}")
    return newest(alerts.where(F.col(column) == value), "timestamp", "alert_id", n)


def incidents_by_status(incidents: DataFrame, status: str, n: int = 100) -> DataFrame:
    """Q3."""
    return newest(incidents.where(F.col("status") == status), "created_at", "id", n)


def ack_trail(acks: DataFrame, incident_id: str, n: int = 100) -> DataFrame:
    """Q4: acknowledgements of one incident, newest first."""
    return newest(acks.where(F.col("incident_id") == incident_id), "created_at", "operator_name", n)


def handoffs(notes: DataFrame, n: int = 10) -> DataFrame:
    """Q4: newest shift notes."""
    return newest(notes, "created_at", "id", n)
