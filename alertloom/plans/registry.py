"""Every operator as a named query, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import classify, enrich, parse
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def ts(col, name: str | None = None):
    """A timestamp as text, so both sides compare the same characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or col)


def parsed(spark, sf) -> DataFrame:
    return parse.parse(fx.lines(spark, sf).drop("us"), fx.AS_OF_LINES)


def classified(spark, sf) -> DataFrame:
    return classify.classify(parsed(spark, sf))


def fields(spark, sf) -> DataFrame:
    return enrich.extract_fields(classified(spark, sf))


def enriched(spark, sf) -> DataFrame:
    from ..functions.times import to_us

    df = enrich.enrich(classified(spark, sf), fx.dim(spark, "device"), fx.dim(spark, "iface"), fx.dim(spark, "as_dim"))
    return df.withColumns({"seq": F.col("event_id"), "us": to_us(F.col("timestamp"))})


def events(spark, sf) -> DataFrame:
    """Correlation input."""
    return enrich.with_recovery(
        enrich.event_bundle(enriched(spark, sf), fx.dim(spark, "topo"), fx.dim(spark, "bgp_bundle")))


def alerts(spark, sf) -> DataFrame:
    return fx.alerts(spark, sf)


def shared(spark, sf, name: str, **frames) -> DataFrame:
    return fx.derive(spark, sf, getattr(fx, name), **frames)
